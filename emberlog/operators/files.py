"""File-listing detectors: mirrors, hoards, wiped and back-dated files, inventories, seals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlog import functions as fn
from emberlog.fixed import detectors as fd, endpoint as fx
from emberlog.operators.common import explode_rows, top_list
from emberlog.operators.intel import lookup

DAY = 86400


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def mirrored_files(files: DataFrame, min_providers: int = 3) -> DataFrame:
    """Contents kept under several sync providers (columns provider, sha256, size, path)."""
    name = fn.win_basename(F.col("path"))
    kept = files.filter((F.col("size") >= fx.MIRROR_MIN_BYTES) & ~name.isin(fx.SYNC_NOISE)
                        & F.col("provider").isNotNull())
    per = kept.groupBy("sha256", "provider").agg(F.count("*").alias("n"),
                                                 F.min("path").alias("p"))
    return per.groupBy("sha256").agg(
        F.count("*").alias("providers"), F.sum("n").alias("copies"),
        F.min("p").alias("sample_path")).filter(F.col("providers") >= min_providers)


def sync_provider(path: Column) -> Column:
    """Provider whose sync directory a path lies in, by the directory's name."""
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    return F.get(F.filter(F.transform(parts, lambda p: lookup(fx.SYNC_DIRECTORIES, p)),
                          lambda p: p.isNotNull()), F.lit(0))


def dot_directories(files: DataFrame) -> DataFrame:
    """Unusual hidden directories of a home that hold documents, archives, media or programs."""
    home = r"^(?:.*/)?home/([^/]+)/(\.[^/]+)/"
    f = files.withColumn("user", F.regexp_extract("path", home, 1)).withColumn(
        "dot_dir", F.regexp_extract("path", home, 2)).filter(
        (F.col("dot_dir") != "") & ~F.lower("dot_dir").isin(fx.USUAL_DOT_DIRECTORIES))
    ext = f.withColumn("ext", extension(F.col("path")))
    per = ext.groupBy("user", "dot_dir", "ext").agg(F.count("*").alias("n"))
    bad = F.col("ext").isin(fx.HOARD_EXTENSIONS)
    totals = per.groupBy("user", "dot_dir").agg(
        F.sum("n").alias("total_files"),
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("suspicious_files")).filter(
        F.col("suspicious_files") > 0)
    return totals.join(top_list(per.filter(bad), ["user", "dot_dir"], "ext", "n", 5),
                       ["user", "dot_dir"])


def wipe_verdict(files: DataFrame) -> DataFrame:
    """State of a file from its metadata and whether its content reads as zeros."""
    zero = F.coalesce("content_zero", F.lit(False))
    init = F.coalesce("init_size", F.lit(0))
    deep = F.coalesce("non_resident", F.lit(False))
    status = (F.when(F.col("is_placeholder") & zero, "cloud_placeholder")
              .when(F.col("allocated") & deep & zero & ~F.col("is_placeholder")
                    & (init >= fx.MIN_WIPED_BYTES), "wiped_in_place")
              .when(~F.col("allocated") & ((F.coalesce("data_size", F.lit(0)) > 0) | deep),
                    "deleted_recoverable")
              .when(zero & (init == 0), "empty_stub").otherwise("intact"))
    return files.withColumn("status", status).withColumn(
        "confidence", F.when(F.col("status") == "wiped_in_place", "high").when(
            F.col("status") == "deleted_recoverable", "medium").otherwise("insufficient")
    ).withColumn("priority", path_priority(F.col("path")))


def path_priority(path: Column) -> Column:
    """Rank of a path among the valued ones; the number of patterns when it is none."""
    return fn.first_match([(path.rlike("(?i)" + p), i) for i, p in enumerate(fx.VALUED_PATHS)],
                          len(fx.VALUED_PATHS))


def zeroed_system_files(listing: DataFrame) -> DataFrame:
    """System programs of size zero, or with all four times zero."""
    low = slashed(F.col("path"))
    system = low.rlike(fd.SYSTEM_PROGRAMS)
    usual = low.contains("windows.old") | low.contains("($file_name)")
    timeless = ((F.col("atime") == 0) & (F.col("mtime") == 0) & (F.col("ctime") == 0)
                & (F.col("crtime") == 0))
    kind = F.when(F.col("size") == 0, "zero_size").when(timeless, "zero_times")
    return listing.filter(system & ~usual).withColumn("kind", kind).filter(
        F.col("kind").isNotNull())


def backdated_files(listing: DataFrame, min_days: int = 7) -> DataFrame:
    """Files in staging places created at least a week before their modification.

    Only places and file kinds count where such a gap tells of planted files; caches, logs and
    updaters rewrite theirs in place.
    """
    skew = F.col("mtime") - F.col("crtime")
    every = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in
                                        ("atime", "mtime", "ctime", "crtime")])
    return listing.filter(
        every & slashed(F.col("path")).rlike("|".join(fd.BACKDATE_PLACES)) & ~F.lower("path").contains("($file_name)")
        & ~F.coalesce(F.col("mode").startswith("d"), F.lit(False)) & (skew >= min_days * DAY)
    ).withColumn("skew_days", F.floor(skew / DAY))


def slashed(path: Column) -> Column:
    """A path in lower case with forward slashes."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def usual_paths(path: Column) -> dict[str, Column]:
    """For some patterns, the paths that match them on a clean system.

    A program folder exempts only what lies directly in it; backup and component trees exempt all below.
    """
    low = slashed(path)
    parent = F.regexp_extract(low, r"([^/]+)/(?:svchost|lsass)\.exe", 1)
    program = (parent.isin(fd.PROGRAM_FOLDERS) | fn.any_contains(low, fd.BACKUP_TREES)
               | low.rlike(fd.COMPONENT_FOLDER))
    return {"SVCHOST_OUTSIDE_SYSTEM32": program, "LSASS_OUTSIDE_SYSTEM32": program,
            "EXE_IN_TEMP": low.rlike(fd.INSTALLER_FOLDER),
            "SCHEDULED_TASK_NONMS": fn.any_contains(low, fd.STOCK_TASKS)}


def path_patterns(listing: DataFrame, patterns: dict, by=()) -> DataFrame:
    """Listing rows per path pattern with count, earliest and latest row time and a sample.

    Usual paths don't count, nor do unpack folders that anywhere hold a marker of a known product (told
    apart by the `by` columns of the listing, such as the host).
    """
    path, usual = F.col("path"), usual_paths(F.col("path"))
    tests = {name: path.rlike(p) & ~usual.get(name, F.lit(False)) for name, p in patterns.items()}
    found = F.filter(F.array(*[F.when(t, n) for n, t in tests.items()]), lambda x: x.isNotNull())
    folder = F.regexp_extract(slashed(path), r"_mei([0-9]{2,8})/", 1)
    hits = explode_rows(listing.withColumn("_folder", folder), found, "pattern")
    known = listing.filter((folder != "") & fn.any_contains(slashed(path), fd.UNPACK_MARKERS)).select(
        *by, folder.alias("_folder"), F.lit("PYINSTALLER_TEMP_DIR").alias("pattern")).distinct()
    return hits.join(known, [*by, "_folder", "pattern"], "left_anti").groupBy(*by, "pattern").agg(
        F.count("*").alias("event_count"), F.min("mtime").alias("earliest"),
        F.max("mtime").alias("latest"), F.min("path").alias("sample_path"))


def markers_present(listing: DataFrame, markers: dict) -> DataFrame:
    """Known paths or packages found in a listing: marker kind, files and a sample."""
    found = F.filter(F.array(*[F.when(fn.any_contains(F.lower("path"), paths), kind)
                               for kind, paths in markers.items()]), lambda x: x.isNotNull())
    return explode_rows(listing, found, "kind").groupBy("kind").agg(
        F.count("*").alias("files"), F.min("path").alias("sample_path"))


def magic_mismatches(files: DataFrame) -> DataFrame:
    """Files whose extension does not belong to the type of their first bytes (column head)."""
    first = F.hex("head")
    kind = fn.first_match([(first.startswith(m), t) for m, t in fx.MAGIC_TYPES.items()])
    ext = F.regexp_replace(extension(F.col("path")), r"^\.", "")
    allowed = fn.first_match([(F.col("detected") == t, F.lit(e))
                              for t, e in fx.TYPE_EXTENSIONS.items()])
    return files.withColumn("detected", kind).withColumn("extension", ext).filter(
        F.col("detected").isNotNull() & (F.col("extension") != "")
        & ~F.array_contains(F.split(allowed, " "), F.col("extension")))


def inventory_counts(files: DataFrame, by) -> DataFrame:
    """Files, bytes and database files per group."""
    return files.groupBy(*by).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"),
        F.count_if(extension(F.col("path")).isin(".db", ".sqlite", ".sqlite3", ".sqlitedb"))
        .alias("databases"))


def changed_settings(rows: DataFrame, by, columns) -> DataFrame:
    """Groups in which a setting takes more than one value."""
    out = rows.groupBy(*by).agg(*[F.count_distinct(c).alias(f"{c}_values") for c in columns])
    test = reduce(lambda a, b: a | b, [F.col(f"{c}_values") > 1 for c in columns])
    return out.filter(test)


def execution_corroboration(hits: DataFrame, min_sources: int = 2) -> DataFrame:
    """Program names seen by several execution sources (columns path, source, last_seen)."""
    name = fn.win_basename(F.col("path"))
    per = hits.withColumn("name", name).filter(F.col("name") != "").groupBy("name", "source").agg(
        F.count("*").alias("n"), F.max("last_seen").alias("last_seen"),
        F.bool_or(fn.is_user_writable(F.col("path"))).alias("w"), F.min("path").alias("p"))
    return per.groupBy("name").agg(
        F.count("*").alias("sources"), F.sum("n").alias("hits"),
        F.max("last_seen").alias("last_seen"), F.bool_or("w").alias("user_writable"),
        F.min("p").alias("sample_path"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "last_seen")))).alias(
            "last_per_source")).filter(F.col("sources") >= min_sources)


# --- seals -------------------------------------------------------------------------------------------

def seal(manifest: DataFrame) -> DataFrame:
    """Root digest of a manifest (columns path, sha256), built as a three-level digest tree.

    Files fall into 65,536 leaves by the digest of their path, leaves into 256 branches, branches
    into the root; every level is digested in order. A billion files put some 15,000 lines in a leaf,
    so no task holds the whole manifest.
    """
    def digest(items):
        return F.sha2(F.array_join(F.transform(F.sort_array(items), lambda s: s["v"]), "\n"), 256)
    key = F.sha2("path", 256)
    leaves = manifest.groupBy(F.substring(key, 1, 4).alias("leaf")).agg(
        digest(F.collect_list(F.struct("path", F.concat_ws(" ", "path", "sha256").alias("v"))))
        .alias("v"), F.count("*").alias("n"))
    branches = leaves.groupBy(F.substring("leaf", 1, 2).alias("branch")).agg(
        digest(F.collect_list(F.struct("leaf", "v"))).alias("v"), F.sum("n").alias("n"))
    return branches.agg(digest(F.collect_list(F.struct("branch", "v"))).alias("root"),
                        F.sum("n").alias("files"))


def verify_seal(sealed: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that changed, went missing or were added since the seal."""
    a = sealed.select("path", F.col("sha256").alias("old"))
    b = current.select("path", F.col("sha256").alias("new"))
    state = (F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added")
             .when(F.col("old") != F.col("new"), "changed"))
    return a.join(b, "path", "full_outer").withColumn("state", state).filter(
        F.col("state").isNotNull()).select("path", "state")
