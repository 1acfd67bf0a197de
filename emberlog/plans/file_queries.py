"""Queries over files that are written from the driver's tables and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.operators.files import magic_mismatches
from emberlog.plans.adapters import EVENT_K, events, table
from emberlog.plans.registry import query
from emberlog.session import scratch_path, ship
from emberlog.sources import files as sf_

#: Pages, or lines of a log, in one file.
PER_FILE = 50


def _folder_name(name: str | None) -> str:
    """The folder that Spark's writers give a value of the column `name`."""
    if not name:
        return "name=__HIVE_DEFAULT_PARTITION__"
    return "name=" + "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in name)


def _write_files(files: DataFrame, folder: str) -> None:
    """Each row's value as a file in a folder named after it, below a folder that the driver and all executors see."""
    os.makedirs(folder)
    ship(files.sparkSession)

    def work(rows):
        for name, value in rows:
            at = f"{folder}/{_folder_name(name)}"
            os.makedirs(at, exist_ok=True)
            part = f"{at}/.part-{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                out.write(value)
                out.write(b"\n")
            # the same from each attempt of a task; empty and null names share a folder
            os.replace(part, f"{at}/part-{int(name == '')}.txt")
    files.select("name", F.col("value").cast("binary")).foreachPartition(work)


def written(spark, rows: DataFrame, name: Column, order: str, line: Column, sf_name: str) -> str:
    """Folder of text files, one per name, in a folder named after it; a file's rows are bounded by its name."""
    path = scratch_path(spark, sf_name)
    files = rows.groupBy(name.alias("name")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct(order, line.alias("line")))), lambda s: s["line"]), "\n").alias("value"))
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getScheme() == "file":  # there Spark's writer starts a process for the rights of each file
        _write_files(files, store.makeQualified(to).toUri().getPath())
    else:
        files.write.partitionBy("name").text(path)
    return path


def named(listing: DataFrame) -> DataFrame:
    """The listing with the names that `written` was given as paths."""
    return listing.withColumn("path", F.regexp_extract("path", "name=([^/]+)/", 1))


def page_files(spark, sf) -> DataFrame:
    n = F.floor(F.col("page_id") / PER_FILE)
    name = F.concat(F.lit("doc"), n, F.element_at(F.array(*map(F.lit, (".pdf", ".gif", ".txt"))), (n % 3 + 1).cast("int")))
    magic = F.when(F.col("page_id") % PER_FILE == 0, F.element_at(
        F.array(*map(F.lit, ("%PDF-1.4", "GIF89a", "MZ", "PK\x03\x04"))), (n % 4 + 1).cast("int"))).otherwise("")
    html = F.concat(magic, F.coalesce("html", F.lit("")))
    return named(sf_.read_file_listing(spark, written(
        spark, table(spark, sf, "pages"), name, "page_id", html, "pages")))


PAGE_FILES = f"""p AS (SELECT page_id, page_id // {PER_FILE} AS n, coalesce(html, '') AS html FROM pages),
  f AS (SELECT n, 'doc' || n || ['.pdf', '.gif', '.txt'][n % 3 + 1] AS path, string_agg(CASE WHEN page_id % {PER_FILE} = 0
    THEN ['%PDF-1.4', 'GIF89a', 'MZ', 'PK' || chr(3) || chr(4)][n % 4 + 1] ELSE '' END || html, chr(10) ORDER BY page_id)
    || chr(10) AS content, min(page_id % {PER_FILE}) = 0 AS marked FROM p GROUP BY n)"""


@query("file_listing", f"""WITH {PAGE_FILES}
SELECT path, strlen(content)::BIGINT AS size, sha256(content) AS sha256, '.txt' AS extension FROM f""")
def file_listing(spark, sf):
    return page_files(spark, sf).select("path", "size", "sha256", "extension")


@query("magic_mismatch_files", f"""WITH {PAGE_FILES},
d AS (SELECT path, ['pdf', 'gif', 'exe', 'zip'][n % 4 + 1] AS detected, ['pdf', 'gif', 'txt'][n % 3 + 1] AS extension FROM f
      WHERE marked) SELECT * FROM d WHERE detected <> extension""")
def magic_mismatch_files(spark, sf):
    return magic_mismatches(page_files(spark, sf)).select("path", "detected", "extension")


LOG_NAMES = ("fw.log", "access.log", "cloud.json", "snort.log", "audit.txt", "notes.txt")
LOG_LINES = ("'x %ASA-4-106023: Deny tcp src outside:198.51.100.' || k", "'#Fields: date c-ip ' || k",
             "'{\"Records\": [{\"eventName\": \"e' || k || '\"}]}'", "'01/02 [**] [1:' || k || ':2] scan'",
             "'type=SYSCALL msg=audit(' || k || '): x'", "'plain note ' || k")
LOG_KINDS = ("'asa'", "'w3c'", "'cloudtrail'", "'snort'", "'auditd'", "NULL")


def by_six(values) -> str:
    return "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("routed_files", f"""WITH e AS (SELECT *, {EVENT_K} FROM events),
l AS (SELECT event_id, (event_id // {PER_FILE * 6}) || '-' || {by_six(f"'{n}'" for n in LOG_NAMES)} AS path, {by_six(LOG_LINES)} AS line,
  {by_six(LOG_KINDS)} AS kind FROM e)
SELECT path, kind, strlen(string_agg(line, chr(10) ORDER BY event_id))::BIGINT + 1 AS size FROM l GROUP BY path, kind""")
def routed_files(spark, sf):
    rows = events(spark, sf).selectExpr(
        "event_id", f"concat(event_id div {PER_FILE * 6}, '-', {by_six(repr(n) for n in LOG_NAMES)}) AS name",
        f"{by_six(LOG_LINES)} AS line")
    path = written(spark, rows, F.col("name"), "event_id", F.col("line"), "logs")
    return sf_.route_files(named(sf_.read_file_listing(spark, path, digest=False))).select("path", "kind", "size")


@query("csv_profile", f"""WITH e AS (SELECT *, {EVENT_K}, date_trunc('second', ts) AS t FROM events WHERE event_id % 50 > 0)
SELECT 'part' || event_id // 1000 % 7 AS artifact, count(*) AS rows, min(t) AS first_seen, max(t) AS last_seen, 3::BIGINT AS columns
FROM e GROUP BY ALL""")
def csv_profile(spark, sf):
    row = ("CASE WHEN event_id % 50 = 0 THEN 'id,EventTime,\"na\"\"me, quoted\"' ELSE concat(event_id, ',', "
           "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), ',\"', event_type, ', \"\"x\"\"\"') END AS line")
    rows = events(spark, sf).selectExpr("event_id", f"concat(event_id div 1000 % 7, '-', event_id div {PER_FILE}) AS name", row)
    path = written(spark, rows, F.col("name"), "event_id", F.col("line"), "csv")
    artifact = F.concat(F.lit("part"), F.regexp_extract("path", "name=([0-9]+)-", 1))
    return sf_.csv_profile(spark, path, artifact).withColumns({
        c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})
