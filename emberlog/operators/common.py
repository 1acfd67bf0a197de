"""Building blocks shared by the detectors: top lists, hits, skew-safe lags and medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HIT_COLUMNS = ["rule_id", "case_id", "entity", "event_count", "first_seen", "last_seen",
               "confidence", "hypotheses", "techniques", "top", "facts"]


def strings(values) -> Column:
    """A constant array of strings (empty allowed)."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def to_hits(df: DataFrame, rule_id: str, *, entity, count="event_count", first="first_seen",
            last="last_seen", confidence="medium", hypotheses=(), techniques=(), facts=(),
            case_id=None, top=None) -> DataFrame:
    """Bring the rows of any detector to the common hit schema."""
    def column(x, default):
        if x is None:
            return default
        return F.col(x) if isinstance(x, str) and x in df.columns else default

    fact_map = F.create_map(
        *[part for name in facts for part in (F.lit(name), F.col(name).cast("string"))]
    ) if facts else F.create_map().cast("map<string,string>")
    return df.select(
        F.lit(rule_id).alias("rule_id"),
        (F.col(case_id) if case_id else F.lit(None)).cast("string").alias("case_id"),
        (F.col(entity) if isinstance(entity, str) else entity).cast("string").alias("entity"),
        column(count, F.lit(1)).cast("bigint").alias("event_count"),
        column(first, F.lit(None)).cast("timestamp").alias("first_seen"),
        column(last, F.lit(None)).cast("timestamp").alias("last_seen"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"),
        strings(hypotheses).alias("hypotheses"),
        strings(techniques).alias("techniques"),
        (F.col(top) if top else F.array().cast("array<struct<key:string,n:bigint>>")).alias("top"),
        fact_map.alias("facts"))


def top_per_group(counts: DataFrame, group, key: str, n: str, k: int) -> DataFrame:
    """The k largest counts of each group; ties go to the smaller key.

    `row_number() <= k` lets Spark cut each map task's rows to k per group before the shuffle, so a
    group that holds a third of all keys still sends only k rows per task.
    """
    w = W.partitionBy(*group).orderBy(F.desc(n), F.asc(key))
    return counts.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)


def top_list(counts: DataFrame, group, key: str, n: str, k: int, name: str = "top") -> DataFrame:
    """One array of at most k (key, n) structs per group, largest first."""
    ranked = top_per_group(counts, group, key, n, k)
    packed = F.sort_array(F.collect_list(F.struct("_rank", F.col(key).cast("string").alias("key"),
                                                  F.col(n).cast("bigint").alias("n"))))
    return ranked.groupBy(*group).agg(F.transform(
        packed, lambda s: F.struct(s["key"].alias("key"), s["n"].alias("n"))).alias(name))


def top_overall(counts: DataFrame, key: str, n: str, k: int, name: str = "top") -> DataFrame:
    """One row with the k largest counts of the whole table (a distributed top-k, then k rows)."""
    best = counts.orderBy(F.desc(n), F.asc(key)).limit(k)
    packed = F.sort_array(F.collect_list(F.struct((-F.col(n)).alias("neg"), F.col(key).cast(
        "string").alias("key"))))
    return best.agg(F.transform(packed, lambda s: F.struct(
        s["key"].alias("key"), (-s["neg"]).cast("bigint").alias("n"))).alias(name))


def show_top(top: Column) -> Column:
    """A top list as text: key=n;key=n."""
    return F.array_join(F.transform(top, lambda s: F.concat(s["key"], F.lit("="), s["n"])), ";")


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate by a scalar subquery (no join)."""
    names = totals.columns
    packed = totals.select(F.struct(*names).alias("t")).scalar()
    return rows.withColumn("_t", packed).select("*", "_t.*").drop("_t")


def explode_rows(df: DataFrame, array: Column, name: str, *keep) -> DataFrame:
    """One row per element of a computed array; rows with an empty one drop out.

    A plain `explode` makes Catalyst add a test that the array is not empty and push it down, which
    computes the array twice with all columns below it inlined; the outer form does not.
    """
    return df.select(*(keep or df.columns), F.explode_outer(array).alias(name)).filter(
        F.col(name).isNotNull())


def size_of(df: DataFrame) -> int:
    """Bytes Catalyst expects of this DataFrame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Broadcast hint when the expected size is under the limit; a shuffle join otherwise."""
    return F.broadcast(df) if size_of(df) <= limit else df


#: A large key is cut at so many quantiles of its times.
PIECES = 256


def split_lag(df: DataFrame, keys, ts: str, tie: str, columns, piece_rows: int = 1_000_000):
    """`lag` of several columns per key in time order without one task per key.

    A key with more than `piece_rows` rows is cut at quantiles of its times, so that a burst makes as
    many pieces as a quiet year of equal size, and the lag window sorts (key, piece) and not the whole
    key; other keys stay whole. The first row of a piece takes its values from the last row of the key's
    previous piece, found in a table of one row per piece of the large keys. Adds `prev_<column>` for
    every listed column. Results don't depend on `piece_rows`.
    """
    cols, keys = list(columns), list(keys)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > piece_rows).select(*keys)
    # quantile sketches are merged map-side; only the large keys' rows are read for them
    cuts = df.join(large, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(
        us, [i / PIECES for i in range(1, PIECES)], F.lit(10_000)).alias("_cuts"))
    piece_no = F.size(F.filter("_cuts", lambda c: c < us))
    rows = df.join(cuts, keys, "left").withColumn(
        "_b", F.when(F.col("_cuts").isNotNull(), piece_no).otherwise(F.lit(0))).withColumn(
        "_large", F.col("_cuts").isNotNull()).drop("_cuts")
    piece = W.partitionBy(*keys, "_b").orderBy(ts, tie)
    lagged = rows.withColumn("_first", F.row_number().over(piece) == 1)
    for c in cols:
        lagged = lagged.withColumn(f"prev_{c}", F.lag(c).over(piece))
    ends = rows.filter("_large").groupBy(*keys, "_b").agg(
        F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("_end"))
    carried = ends.withColumn(
        "_carry", F.lag("_end").over(W.partitionBy(*keys).orderBy("_b"))).select(
        *keys, "_b", "_carry")
    # the window already hashed the rows by (keys, _b), so only the small side moves here
    stitched = lagged.join(carried, [*keys, "_b"], "left")
    return stitched.select(
        *[F.col(c) for c in df.columns],
        *[F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(f"prev_{c}")).alias(
            f"prev_{c}") for c in cols])


def spread_around_median(df: DataFrame, keys, value: str, shift: int = 20) -> DataFrame:
    """Exact median and mean absolute deviation from it, per key, by counting instead of sorting.

    Values are BIGINT. Equal values are merged first (map-side), then counted per range of
    2**shift values; the range that holds the middle ranks is found on those counts, and only its
    values are ranked. No task sees more than one row per range, or more than 2**shift rows.
    Rows left and right of the median range enter the deviation through their sums.
    """
    v = F.col("_v")
    merged = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    merged = merged.withColumn("_r", F.shiftright("_v", shift))
    ranges = merged.groupBy(*keys, "_r").agg(
        F.sum("_n").alias("_rn"), F.sum(v * F.col("_n")).alias("_rs"))
    up_to = W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
    ranges = ranges.withColumn("_cum", F.sum("_rn").over(up_to)).withColumn(
        "_total", F.sum("_rn").over(W.partitionBy(*keys)))
    low_rank = F.floor((F.col("_total") + 1) / 2)
    high_rank = F.floor(F.col("_total") / 2) + 1
    before = F.col("_cum") - F.col("_rn")
    middle = ranges.filter(((low_rank > before) & (low_rank <= F.col("_cum")))
                           | ((high_rank > before) & (high_rank <= F.col("_cum"))))
    inside = merged.join(middle.select(*keys, "_r", F.col("_cum").alias("_rc"), "_rn", "_total"),
                         [*keys, "_r"])
    within = W.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    inside = inside.withColumn("_c", F.col("_rc") - F.col("_rn") + F.sum("_n").over(within))
    start = F.col("_c") - F.col("_n")
    medians = inside.groupBy(*keys).agg(
        F.min(F.when((low_rank > start) & (low_rank <= F.col("_c")), v)).alias("_lo"),
        F.min(F.when((high_rank > start) & (high_rank <= F.col("_c")), v)).alias("_hi"))
    medians = medians.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))
    spread = merged.join(medians, list(keys)).groupBy(*keys).agg(
        F.first("median").alias("median"),
        (F.sum(F.abs(v - F.col("median")) * F.col("_n")) / F.sum("_n")).alias("mad"))
    return spread
