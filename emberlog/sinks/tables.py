"""Ledgers and registries kept as Parquet tables, and exported files.

Ledgers are append-only: a replaced row is a newer row of the same key, and readers take the
newest. That needs no table format with row updates and survives lost executors, because every
write is one commit (`commits`), whoever else writes at the same time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from emberlog.sinks import commits


# --- findings --------------------------------------------------------------------------------

def latest(rows: DataFrame, key, version: str) -> DataFrame:
    """The newest row of every key; of rows of one version, that with the largest content.

    The second order makes the choice the same in every run, even for rows written by one job.
    """
    w = W.partitionBy(*key).orderBy(F.desc(version), F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("_v", F.row_number().over(w)).filter(F.col("_v") == 1).drop("_v")


def insert_findings(findings: DataFrame, path: str) -> int:
    """Insert or replace findings by id in one commit, partitioned by case; returns the version."""
    return commits.append(findings, path, partition_by=["case_id"])["version"]


def list_findings(spark: SparkSession, path: str, case_id: str | None = None) -> DataFrame:
    """Current findings in order of creation; a case filter prunes partitions.

    Of a finding that came again the latest commit counts; `version` says which.
    """
    rows = commits.read(spark, path, commits.manifests(spark, path))
    if case_id is not None:
        rows = rows.filter(F.col("case_id") == case_id)
    return latest(rows, ["finding_id"], "version").orderBy("created", "finding_id")


# --- registries ----------------------------------------------------------------------------------

def without_known(rows: DataFrame, known: DataFrame, key) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return rows.join(known.select(*key), list(key), "left_anti")


def insert_new(observed: DataFrame, path: str, key) -> DataFrame:
    """Insert or ignore: commit the rows whose key the registry at `path` lacks; their number per type.

    Of several rows of one key the smallest stays. Rows with a null or empty part of the key are no
    observations. New rows are written once and counted from what was written, and rows that another
    writer commits at the same time are taken out before ours are tried again, so no key is lost or
    stored twice.
    """
    spark, key = observed.sparkSession, list(key)
    named = F.lit(True)
    for k in key:
        named = named & F.coalesce(F.col(k).cast("string") != "", F.lit(False))
    others = [c for c in observed.columns if c not in key]
    fresh = observed.filter(named).groupBy(*key).agg(F.min(F.struct(*others)).alias("_row")).select(
        *key, "_row.*") if others else observed.filter(named).distinct()
    made = commits.append(fresh.select(*observed.columns), path, settle=lambda rows, known: without_known(
        rows, known, key))
    return commits.read(spark, path, [made]).groupBy(key[0]).agg(F.count("*").alias("new_rows"))


def seal_cases(cases: DataFrame, path: str) -> int:
    """Seal what the registry holds of these cases (column case_id); returns the number of their rows.

    Rows that are inserted for a case later on are open until it is sealed again.
    """
    spark = cases.sparkSession
    made = commits.append(cases.select("case_id").distinct(), path, kind="seal")
    now = read_registry(spark, path, made["version"])
    return now.join(commits.read(spark, path, [made]).select("case_id"), "case_id", "left_semi").count()


def read_registry(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of a registry, or those up to a version, with their version and whether they are sealed."""
    held = [m for m in commits.manifests(spark, path) if version is None or m["version"] <= version]
    rows = commits.read(spark, path, [m for m in held if m["kind"] == "rows"])
    seals = [m for m in held if m["kind"] == "seal"]
    if not seals:
        return rows.withColumn("sealed", F.lit(False))
    last = commits.read(spark, path, seals).groupBy("case_id").agg(F.max("version").alias("_sealed"))
    return rows.join(last, "case_id", "left").withColumn(
        "sealed", F.coalesce(F.col("version") <= F.col("_sealed"), F.lit(False))).drop("_sealed")


def family_attributions(hits: DataFrame, agent: str) -> DataFrame:
    """One row per family and case from matches (case_id, family, snippet), with the smallest snippet.

    Insert them by the key (family, case_id).
    """
    return hits.groupBy("family", "case_id").agg(F.min("snippet").alias("snippet")).withColumn(
        "agent", F.lit(agent))


# --- indicator bundles -----------------------------------------------------------------------------

STIX_NAMESPACE = "00abedb4aa4249798f7a7de6cd9a4a52"  # hex of the namespace ids are derived from


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based UUID (version 5) from SHA-1, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(
        3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


PATTERN_PATHS = {
    "ipv4": "ipv4-addr:value", "ipv6": "ipv6-addr:value", "domain": "domain-name:value",
    "url": "url:value", "email": "email-addr:value", "md5": "file:hashes.MD5",
    "sha1": "file:hashes.'SHA-1'", "sha256": "file:hashes.'SHA-256'",
}


def stix_objects(iocs: DataFrame, namespace_hex: str = STIX_NAMESPACE) -> DataFrame:
    """Indicator objects with deterministic ids and a recurrence label.

    Columns ioc_type, value, case_id. Every indicator is exported; write the result as partitioned files.
    """
    per = iocs.filter(F.col("ioc_type").isin(list(PATTERN_PATHS))).select(
        "ioc_type", "value", "case_id").distinct().groupBy("ioc_type", "value").agg(
        F.count("*").alias("cases"))
    paths = F.create_map(*[F.lit(x) for kv in PATTERN_PATHS.items() for x in kv])
    return per.select(
        F.concat(F.lit("indicator--"), uuid5(namespace_hex, F.concat_ws(
            ":", "ioc_type", "value"))).alias("id"), "ioc_type", "value",
        F.concat(F.lit("["), F.element_at(paths, F.col("ioc_type")), F.lit(" = '"),
                 F.replace("value", F.lit("'"), F.lit("\\'")), F.lit("']")).alias("pattern"),
        F.when(F.col("cases") > 1, "recurring").otherwise("single-case").alias("label"))


def write_stix(objects: DataFrame, path: str) -> None:
    """One JSON object per line; readers that want one bundle concatenate the parts."""
    objects.select(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), "id",
                   "pattern", F.lit("stix").alias("pattern_type"), F.array("label").alias(
                       "labels")).write.mode("overwrite").json(path)


# --- execution log -------------------------------------------------------------------------------------

def execution_events(findings: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit lines and findings as one ordered stream (audit columns ts, case_id, action, detail)."""
    f = findings.select(F.col("created").alias("ts"), "case_id", F.lit("finding").alias("kind"),
                        F.col("agent").alias("actor"), F.col("finding_id").alias("detail"))
    a = audit.select("ts", "case_id", F.lit("audit").alias("kind"), F.col("action").alias("actor"),
                     "detail")
    return reduce(lambda x, y: x.unionByName(y), [f, a]).orderBy("ts", "case_id", "kind", "detail")


def traceability(findings: DataFrame) -> DataFrame:
    """One row per finding and tool run behind it."""
    return findings.select("case_id", "finding_id", "agent", F.explode("tools").alias("tool")
                           ).filter(F.col("tool") != "")


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)
