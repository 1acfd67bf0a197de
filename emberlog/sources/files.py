"""File inventories, routing of files to parsers, and profiles of collected results."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from emberlog import functions as fn
from emberlog.operators.files import extension
from emberlog.session import ship


#: Bytes read at once from a file, and of those kept as its head.
CHUNK, HEAD = 1 << 20, 4096


def open_uri(uri: str) -> BinaryIO:
    """A byte stream of a file in any store pyarrow knows (local, HDFS, S3, GCS)."""
    from pyarrow import fs
    if uri.startswith("file:"):  # Spark spells local paths without escapes
        return fs.LocalFileSystem().open_input_stream(re.sub(r"^file:/+", "/", uri))
    store, path = fs.FileSystem.from_uri(quote(uri, safe="/:@"))
    return store.open_input_stream(path)


def list_files(spark: SparkSession, path) -> DataFrame:
    """Inventory of a tree without reading a file: path, size, modification time and extension.

    Spark's file scan leaves out files without a byte.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).withColumn(
        "extension", extension(F.col("path")))


def read_file_listing(spark: SparkSession, path, digest: bool = True,
                      opener: Callable[[str], BinaryIO] = open_uri) -> DataFrame:
    """Inventory of a tree: path, size, modification time, extension, first bytes and, with `digest`, sha256.

    Files of any size: a task reads one file after another in chunks, and only the head gets into a row;
    without `digest` no more than the head is read. Files are dealt out by their path. `opener` opens a
    path as Spark spells it, on the executors; a file that it can't open fails the job.
    """
    ship(spark)
    files = list_files(spark, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, digests = [], []
            for uri in batch.column("path").to_pylist():
                with opener(uri) as stream:
                    first = b""
                    while len(first) < HEAD and (more := stream.read(CHUNK if digest else HEAD - len(first))):
                        first += more
                    heads.append(first[:HEAD])
                    if digest:
                        sha = hashlib.sha256(first)
                        while chunk := stream.read(CHUNK):
                            sha.update(chunk)
                        digests.append(sha.hexdigest())
            columns = {**{c: batch.column(c) for c in batch.schema.names}, "head": pa.array(heads, pa.binary())}
            if digest:
                columns["sha256"] = pa.array(digests, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.repartition("path").mapInArrow(work, f"{kind}, head binary" + (", sha256 string" if digest else ""))


def log_kind(path: Column, head: Column) -> Column:
    """Parser for a file, from its name and first characters; null when none fits."""
    name = fn.win_basename(path)
    log = name.endswith(".log") | name.endswith(".log.gz")
    return fn.first_match([
        (name.endswith(".xml") & (head.contains("<Events") | head.contains("win/2004/08/events")
                                  | name.startswith("windows_event")), "event_xml"),
        (name.endswith(".json") & head.contains('"object"') & head.contains('"action"'), "ecar"),
        (head.contains('"Records"') & head.contains("eventName"), "cloudtrail"),
        (head.contains("userPrincipalName") & head.contains("createdDateTime"), "signin"),
        (head.contains("operationName") & head.contains("caller"), "activity"),
        (head.contains("protoPayload"), "gcp_audit"),
        (head.contains("Operation") & head.contains("AuditData"), "ual"),
        (head.contains("audit.k8s.io"), "k8s_audit"),
        (log & (head.contains("%ASA-") | name.contains("asa")), "asa"),
        (log & (head.contains("[**]") | name.contains("snort")), "snort"),
        (log & name.contains("access") & (head.contains("#Fields:") | head.contains(
            "#Software:") | head.startswith("#Version")), "w3c"),
        (log & name.contains("access"), "web_access"),
        (head.rlike(r"(?m)^type=\S+ msg=audit\("), "auditd"),
        (head.rlike(r"(?m)^<\d{1,3}>") | name.contains("syslog") | (name == "messages"),
         "syslog"),
    ])


def route_files(listing: DataFrame) -> DataFrame:
    """Files of a listing (columns path, head) with the parser each one goes to."""
    return listing.withColumn("kind", log_kind(F.col("path"), F.decode("head", "UTF-8")))


TIME_FIELDS = ["_ts", "Timestamp", "timestamp", "TimeCreated", "Mtime", "ModTime", "EventTime"]


def _samples(per: DataFrame, sample: int) -> DataFrame:
    """For each _artifact the `sample` different values of _row with the least hashes."""
    least = W.partitionBy("_artifact").orderBy("_h", "_row")
    few = per.select("_artifact", F.xxhash64("_row").alias("_h"), "_row").withColumn(
        "_r", F.dense_rank().over(least)).filter(F.col("_r") <= sample).dropDuplicates(["_artifact", "_r"])
    return few.groupBy("_artifact").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_r", "_row"))), lambda s: s["_row"]).alias("sample"))


def _profiled(rows: DataFrame, artifact: str, time: Column, keys: Column, row: Column, sample: int) -> DataFrame:
    """Rows, columns, time range and a sample per artifact, of which all counts are combined map-side.

    The sample holds the rows with the least hashes, so it is the same however the rows are partitioned;
    tasks pass on no more than `sample` rows per artifact. Equal rows count as one in it.
    """
    per = rows.select(F.col(artifact).alias("_artifact"), time.alias("_t"), keys.alias("_k"), row.alias("_row"))
    totals = per.groupBy("_artifact").agg(F.count("*").alias("rows"), F.min("_t").alias("first_seen"),
                                          F.max("_t").alias("last_seen"))
    cols = per.select("_artifact", F.explode("_k").alias("_c")).distinct().groupBy("_artifact").agg(
        F.count("*").alias("columns"))
    out = totals.join(cols, "_artifact", "left")
    if sample:
        out = out.join(_samples(per, sample), "_artifact", "left")
    return out.withColumnRenamed("_artifact", artifact)


def collection_profile(rows: DataFrame, artifact: str = "artifact", sample: int = 0) -> DataFrame:
    """Rows, columns, time range and, if asked for, sample rows per artifact of collected JSON rows (column value)."""
    doc = F.try_parse_json("value")
    when = F.coalesce(*[fn.parse_iso(F.try_variant_get(doc, f"$.{c}", "string"))
                        for c in TIME_FIELDS])
    return _profiled(rows.filter(doc.isNotNull()), artifact, when, F.json_object_keys("value"), F.col("value"), sample)


def _text_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of all files of a tree, whose folders are listed by a few tasks a core; Spark's own way is a task a folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, 4 * spark.sparkContext.defaultParallelism)
    try:
        return spark.read.text(path, recursiveFileLookup=True)
    finally:
        spark.conf.set(name, before)


def csv_profile(spark: SparkSession, path, artifact: Column | None = None, sample: int = 0) -> DataFrame:
    """Rows, columns, time range and sample per artifact of collected CSV files.

    An artifact is a file (its name) unless `artifact`, a column of the file's path, says otherwise. A file
    whose first row is its header is read in splits: the header of a file is found once, by its place, and
    joined to the file's rows. The time column is the first of TIME_FIELDS that the header names. Rows
    with fewer fields than the header have nulls at the end; quoted fields hold no line feeds. Sample rows
    are maps of column to value as JSON, values cut at 200 characters.
    """
    lines = _text_lines(spark, path).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value")

    def values(line):
        fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
        return F.transform(fields, lambda f: F.when(f.startswith('"'), F.replace(
            F.regexp_replace(f, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f))
    # a header is taken apart once for its file, not with every line
    heads = lines.groupBy("path").agg(F.min_by(F.struct("at", "value"), F.struct("start", "at")).alias("head")).select(
        "path", F.col("head.at").alias("head_at"), values(F.col("head.value")).alias("names"))
    names = F.col("names")
    both = lines.join(heads, "path").filter(F.col("at") != F.col("head_at")).select(
        "path", "names", values(F.col("value")).alias("values"))
    time = F.coalesce(*[F.when(F.array_contains(names, c), F.get("values", F.array_position(names, c) - 1))
                        for c in TIME_FIELDS])
    files = both.groupBy("path", "names").agg(F.count("*").alias("_n"), F.min(fn.parse_iso(time)).alias("_first"),
                                              F.max(fn.parse_iso(time)).alias("_last"))
    of = (fn.win_basename(F.col("path")) if artifact is None else artifact).alias("artifact")
    # a file's rows count with the first of its columns
    columns = files.select(of, F.posexplode("names").alias("_i", "_c"), "_n", "_first", "_last").groupBy(
        "artifact", "_c").agg(F.sum(F.when(F.col("_i") == 0, F.col("_n")).otherwise(0)).alias("_n"),
                              F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    out = columns.groupBy("artifact").agg(F.sum("_n").alias("rows"), F.min("_first").alias("first_seen"), F.max(
        "_last").alias("last_seen"), F.count("*").alias("columns"))
    if sample:
        row = F.map_from_arrays(names, F.transform(names, lambda n, i: F.get("values", i)))
        shown = F.to_json(F.transform_values(row, lambda k, v: F.substring(v, 1, 200)))
        kept = _samples(both.select(of.alias("_artifact"), shown.alias("_row")), sample)
        out = out.join(kept.withColumnRenamed("_artifact", "artifact"), "artifact", "left")
    return out
