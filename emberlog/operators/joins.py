"""Joins between tables of a case: missing rows, snapshots, intervals, near times, processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog import functions as fn
from emberlog.fixed import endpoint as fx
from emberlog.operators.common import small
from emberlog.operators.intel import literal


# --- scan against list ---------------------------------------------------------------------------

def hidden_rows(scanned: DataFrame, listed: DataFrame, key) -> DataFrame:
    """Rows of a scan whose key the list lacks; nothing when the list itself is empty."""
    some = listed.agg((F.count("*") > 0).alias("some")).scalar()
    return scanned.join(listed.select(*key).distinct(), list(key), "left_anti").filter(some)


def unlinked_modules(modules: DataFrame) -> DataFrame:
    """Modules present in memory but taken out of the load list."""
    def yes(c):
        return F.lower(F.col(c).cast("string")).isin("true", "1", "yes")
    return modules.filter(~F.coalesce(yes("in_load"), F.lit(False))
                          & F.coalesce(yes("in_mem"), F.lit(False)))


# --- snapshots -------------------------------------------------------------------------------------

def snapshot_diff(live: DataFrame, snapshot: DataFrame, key=("path",)) -> DataFrame:
    """Files that vanished, shrank or changed on the live side."""
    a = live.select(*key, F.col("size").alias("live_size"), F.col("sha256").alias("live_sha"))
    b = snapshot.select(*key, F.col("size").alias("snap_size"), F.col("sha256").alias("snap_sha"))
    both = a.join(b, list(key), "full_outer")
    severity = (F.when(F.col("live_sha").isNull() & F.col("snap_sha").isNotNull(),
                       "deleted_in_live")
                .when(F.col("snap_sha").isNull() | (F.col("live_sha") == F.col("snap_sha")), None)
                .when(F.col("live_size") < F.col("snap_size"), "shrunk_in_live")
                .otherwise("changed"))
    delta = F.coalesce(F.col("snap_size") - F.col("live_size"), F.lit(0))
    return both.withColumn("severity", severity).filter(F.col("severity").isNotNull()).select(
        *key, "severity", delta.alias("delta_bytes"))


def pre_clearing_snapshot(live: DataFrame, snaps: DataFrame, key: str, ratio: float,
                          min_delta: int) -> DataFrame:
    """Newest snapshot of each log that is much larger than the live one."""
    sizes = live.select(key, F.col("size").alias("live_size"))
    grown = (F.col("size") >= F.col("live_size") * ratio) & (
        F.col("size") - F.col("live_size") >= min_delta)
    return snaps.join(sizes, key).filter(grown).groupBy(key).agg(
        F.max("number").alias("snapshot"), F.max_by("size", "number").alias("snapshot_size"))


def snapshot_progress(items: DataFrame) -> DataFrame:
    """Per snapshot: items new against the first one, and new or gone against the one before.

    Columns snapshot (ordered) and item. Every distinct (item, snapshot) pair is looked at once
    with its neighbour snapshots, so no snapshot is ever collected into one set.
    """
    pairs = items.select("snapshot", "item").distinct()
    order = pairs.select("snapshot").distinct().withColumn(
        "n", F.row_number().over(W.orderBy("snapshot")))
    seen = pairs.join(small(order), "snapshot")
    w = W.partitionBy("item").orderBy("n")
    rows = seen.withColumn("prev_n", F.lag("n").over(w)).withColumn(
        "next_n", F.lead("n").over(w)).withColumn(
        "in_first", F.min("n").over(W.partitionBy("item")) == 1)
    here = rows.groupBy("n").agg(
        F.count("*").alias("items"), F.count_if(~F.col("in_first")).alias("new_vs_baseline"),
        F.count_if(F.coalesce(F.col("prev_n") != F.col("n") - 1, F.lit(True))).alias("_new"))
    gone = rows.filter(F.coalesce(F.col("next_n") != F.col("n") + 1, F.lit(True))).groupBy(
        (F.col("n") + 1).alias("n")).agg(F.count("*").alias("_gone"))
    return here.join(gone, "n", "left").join(order, "n").select(
        "snapshot", "items", "new_vs_baseline",
        F.when(F.col("n") > 1, F.col("_new")).otherwise(0).alias("new_vs_previous"),
        F.coalesce("_gone", F.lit(0)).alias("gone_vs_previous"))


# --- intervals and near times --------------------------------------------------------------------------

#: Bucket widths grow by this factor; an interval is entered at the first width it fits into.
WIDTH_STEP, WIDTHS = 64, 3


def covering_intervals(points: DataFrame, intervals: DataFrame, key: str, t: str, start: str,
                       end: str, bucket_s: int = 7 * 86400) -> DataFrame:
    """Intervals of the same device that cover a point in time.

    Buckets come in three widths. An interval is entered, at the first width at which it touches at most
    65 of them (an open one at the last), and a point looks into its bucket of each width, so the join
    key is (device, width, bucket): a busy device spreads, and a long interval makes few rows.
    """
    def bucket(c: Column, width: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / width)

    widths = [bucket_s * WIDTH_STEP ** i for i in range(WIDTHS)]
    length = F.unix_seconds(F.col(end).cast("timestamp")) - F.unix_seconds(F.col(start).cast("timestamp"))
    chosen = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        chosen = F.when(length <= w * WIDTH_STEP, F.lit(w)).otherwise(chosen)
    right = intervals.filter(F.col(start) <= F.col(end)).withColumn("_w", chosen.cast("bigint")).withColumn(
        "_b", F.explode(F.sequence(bucket(F.col(start), F.col("_w")), bucket(F.col(end), F.col("_w")))))
    left = points.withColumn("_w", F.explode(F.array(*[F.lit(w).cast("bigint") for w in widths]))).withColumn(
        "_b", bucket(F.col(t), F.col("_w")))
    return left.join(right, [key, "_w", "_b"]).filter(
        (F.col(start) <= F.col(t)) & (F.col(t) <= F.col(end))).drop("_w", "_b")


def near_times(points: DataFrame, fixes: DataFrame, key: str, t: str, at: str,
               window_s: int = 60) -> DataFrame:
    """Fixes within a window around a point of the same device.

    Times are cut into buckets of one window; a point looks into its own and both neighbour
    buckets, so the join is an equi join on (device, bucket) and a busy device spreads over tasks.
    """
    def bucket(c: Column) -> Column:
        return F.floor(F.unix_micros(c.cast("timestamp")) / (window_s * 1_000_000))
    left = points.withColumn("_b", F.explode(F.sequence(bucket(F.col(t)) - 1,
                                                       bucket(F.col(t)) + 1)))
    right = fixes.withColumn("_b", bucket(F.col(at)))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(t).cast("timestamp"))
    return left.join(right, [key, "_b"]).withColumn("gap_seconds", gap / 1_000_000).filter(
        F.abs("gap_seconds") <= window_s).drop("_b")


# --- processes --------------------------------------------------------------------------------------------

def with_parents(processes: DataFrame, by=("host",)) -> DataFrame:
    """Processes with their parent's name, looked up by process id on the same host."""
    p = processes.filter(F.col("pid").isNotNull() & (F.coalesce("name", F.lit("")) != "")
                         ).withColumn("name", F.lower("name"))
    parent = p.groupBy(*by, F.col("pid").alias("ppid")).agg(F.min("name").alias("parent_name"))
    return p.join(parent, [*by, "ppid"], "left")


def process_profile(processes: DataFrame, by=("host",)) -> DataFrame:
    """Deviations from the expected process table, one reason per host and name at most.

    A wrong count hides the parent test of that name; a missing parent is ignored.
    """
    rows = with_parents(processes, by)
    names = list(fx.PROCESS_PROFILE)
    profile = literal({n: {"parents": p["parents"], "exact": p.get("exact"), "min": p.get("min"),
                           "max": p.get("max")} for n, p in fx.PROCESS_PROFILE.items()},
                      "map<string,struct<parents:array<string>,exact:int,min:int,max:int>>")
    want = F.try_element_at(profile, F.col("name"))
    bad_parent = F.col("parent_name").isNotNull() & (F.size(want["parents"]) > 0) & ~F.exists(
        want["parents"], lambda x: x == F.col("parent_name"))
    counted = rows.filter(F.col("name").isin(names)).groupBy(*by, "name").agg(
        F.count("*").alias("n"), F.count_if(bad_parent).alias("wrong_parents"),
        F.min(F.when(bad_parent, F.col("parent_name"))).alias("sample_parent"))
    hosts = rows.select(*by).distinct().withColumn(
        "name", F.explode(F.array(*[F.lit(n) for n in names])))
    full = hosts.join(counted, [*by, "name"], "left").na.fill(0, ["n", "wrong_parents"])
    n = F.col("n")
    reason = (F.when(want["exact"].isNotNull() & (n == 0), "process_missing")
              .when(n > want["exact"], "count_high").when(n < want["exact"], "count_low")
              .when(n > want["max"], "count_high").when((n < want["min"]) & (n > 0), "count_low")
              .when(F.col("wrong_parents") > 0, "unexpected_parent"))
    return full.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def shell_children(processes: DataFrame, parents=None, shells=None, by=("host",)) -> DataFrame:
    """Shells started by office-like programs."""
    return with_parents(processes, by).filter(
        F.col("parent_name").isin(parents or fx.OFFICE_PARENTS)
        & F.col("name").isin(shells or fx.SHELL_CHILDREN))


def orphans(processes: DataFrame, by=("host",)) -> DataFrame:
    """Processes whose parent id is not listed (0 and 4 excepted)."""
    known = processes.select(*by, F.col("pid").alias("ppid")).distinct()
    return processes.filter(F.col("ppid").isNotNull() & ~F.col("ppid").isin(0, 4)).join(
        known, [*by, "ppid"], "left_anti")


def shared_names(processes: DataFrame) -> DataFrame:
    """Program names on several hosts, with the number of hosts, the first and the last one.

    A name is reduced to its hosts before anything is counted, so no host pairs are formed.
    """
    per = processes.select("name", "host").distinct()
    return per.groupBy("name").agg(
        F.count("*").alias("hosts"), F.min("host").alias("host_a"),
        F.max("host").alias("host_b")).filter(F.col("hosts") > 1)


def short_lived(processes: DataFrame, seconds: int = 5) -> DataFrame:
    """Processes that exited within seconds of their creation, noisy names excepted."""
    life = fn.epoch_seconds(F.col("exited")) - fn.epoch_seconds(F.col("created"))
    return processes.withColumn("lifetime", life).filter(
        F.col("lifetime").between(0, seconds) & ~F.lower("name").isin(fx.NOISY_SHORT_LIVED))


# --- devices -------------------------------------------------------------------------------------------------

def removable_staging(opened: DataFrame, drives: DataFrame, fragments) -> DataFrame:
    """Documents opened from a removable drive whose path holds a project fragment."""
    letter = F.upper(F.substring("path", 1, 1))
    hit = fn.first_match([(F.lower("path").contains(x.lower()), x) for x in fragments])
    return opened.filter(F.col("path").rlike("^[A-Za-z]:")).withColumn("drive", letter).join(
        drives.select("host", "drive").distinct(), ["host", "drive"]).withColumn(
        "fragment", hit).filter(F.col("fragment").isNotNull())


def paired_captures(devices: DataFrame) -> DataFrame:
    """Captures of one device: same size and name root, different head; oldest and newest pair up.

    Columns name, size, mtime, head, has_sidecar. The side with a sidecar is the authoritative one;
    otherwise the older one is.
    """
    d = devices.filter(F.col("size") > 0).withColumn("root", fn.name_root(F.col("name")))
    side = F.struct("name", "mtime", "head", "has_sidecar")
    order = F.struct("mtime", "name")
    g = d.groupBy("size", "root").agg(F.count("*").alias("members"),
                                      F.min_by(side, order).alias("a"),
                                      F.max_by(side, order).alias("b"))
    swap = F.col("b.has_sidecar") & ~F.col("a.has_sidecar")
    return g.filter((F.col("members") >= 2) & (F.col("a.head") != F.col("b.head"))).select(
        "root", "size", "members",
        F.when(swap, F.col("b.name")).otherwise(F.col("a.name")).alias("authoritative"),
        F.when(swap, F.col("a.name")).otherwise(F.col("b.name")).alias("baseline"))


def role_grants(principals: DataFrame, grants: DataFrame, privileged) -> DataFrame:
    """Principals with privileged roles, from stand-alone grants and embedded memberships."""
    low = [r.lower() for r in privileged]
    embedded = principals.select(F.col("id").alias("principal_id"),
                                 F.explode("member_of").alias("role"))
    both = grants.select("principal_id", "role").unionByName(embedded).filter(
        F.lower("role").isin(low)).distinct()
    who = principals.select(F.col("id").alias("principal_id"), "name", F.coalesce(
        F.lower("user_type") == "guest", F.lit(False)).alias("is_guest"))
    return both.join(who, "principal_id", "left")


def risky_scopes(grants: DataFrame, scopes) -> DataFrame:
    """OAuth grants that hold risky scopes (scopes written as one space-separated text)."""
    have = F.transform(F.split(F.trim("scope"), r"\s+"), F.lower)
    risky = F.array_intersect(have, F.array(*[F.lit(s.lower()) for s in scopes]))
    return grants.withColumn("risky", F.sort_array(risky)).filter(F.size("risky") > 0)
