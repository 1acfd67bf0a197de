"""Reputation of client fingerprints: JA3 hashes, JA4 fingerprints and DHCP option lists.

Every fingerprint has keys in stages, the exact one first; a table row has the same keys. One equi join on
(kind, stage, key) meets all of them, and the earliest stage that is known decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberlog.fixed import fingerprints as fx
from emberlog.operators.common import small

STAGES = {"ja3": ("exact",), "ja4": ("exact", "first_and_last", "first_and_middle", "middle_and_last"),
          "dhcp": ("exact", "any_order")}


def option_list(options: Column) -> Column:
    """A DHCP option list, separated by commas or spaces, with single commas."""
    return F.array_join(F.filter(F.split(F.coalesce(options, F.lit("")), "[ ,]"), lambda x: x != ""), ",")


def fingerprint_keys(kind: str, value: Column) -> Column:
    """Keys of a fingerprint, in the order of the kind's stages; none if it has not the shape of the kind."""
    none = F.array().cast("array<string>")
    if kind == "ja3":
        return F.when(F.lower(value).rlike("^[0-9a-f]{32}$"), F.array(F.lower(value))).otherwise(none)
    if kind == "ja4":
        exact = F.trim(value)
        p = F.split(exact, "_")
        parts = F.array(exact, F.concat(p[0], F.lit("_*_"), p[2]), F.concat(p[0], F.lit("_"), p[1], F.lit("_*")),
                        F.concat(F.lit("*_"), p[1], F.lit("_"), p[2]))
        return F.when(exact.rlike("^[^_]+_[^_]+_[^_]+$"), parts).when(
            exact != "", F.array(exact)).otherwise(none)
    exact = option_list(value)
    return F.when(exact != "", F.array(exact, F.array_join(F.array_sort(F.split(exact, ",")), ","))).otherwise(none)


def known_fingerprints(spark: SparkSession) -> DataFrame:
    """The published JA3 hashes and option lists; add JA4 rows of the same columns by union."""
    rows = [("ja3", *r) for r in fx.JA3] + [("dhcp", key, "known_os", os, None) for key, os in fx.DHCP]
    return spark.createDataFrame(rows, "kind string, value string, class string, label string, source string")


def table_keys(table: DataFrame) -> DataFrame:
    """One row per kind, stage and key of a fingerprint table (kind, value, class, label, source).

    A key of a later stage that stands for several labels tells nothing and is left out; of several rows of
    an exact key the smallest counts.
    """
    parts = []
    for kind in STAGES:
        parts.append(table.filter(F.col("kind") == kind).select(
            "kind", "class", "label", "source", F.posexplode(fingerprint_keys(kind, F.col("value"))).alias(
                "stage", "key")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("kind", "stage", "key").agg(
        F.min(F.struct("label", "class", "source")).alias("known"),
        (F.min("label") != F.max("label")).alias("split")).filter(
        "stage = 0 OR NOT coalesce(split, false)").drop("split")


def reputations(rows: DataFrame, kind: str, column: str, table: DataFrame) -> DataFrame:
    """Rows with class, label, source and the stage that matched; class `unknown` without a match.

    Fingerprints are looked up once per distinct value, so a value that most rows share costs one row in
    the joins; null and malformed ones are unknown. Columns of the four names are replaced.
    """
    stages = F.array(*[F.lit(s) for s in STAGES[kind]])
    known = table_keys(table.filter(F.col("kind") == kind)).drop("kind")
    values = rows.select(F.col(column).alias("_value")).filter(F.col("_value").isNotNull()).distinct()
    keyed = values.select("_value", F.posexplode(fingerprint_keys(kind, F.col("_value"))).alias("stage", "key"))
    best = keyed.join(small(known), ["stage", "key"]).groupBy("_value").agg(
        F.min_by(F.struct("known", F.element_at(stages, F.col("stage") + 1).alias("stage")), "stage").alias("_best"))
    return rows.join(small(best), rows[column] == best["_value"], "left").select(
        *[c for c in rows.columns if c not in ("class", "label", "source", "stage")], F.coalesce(F.col("_best.known.class"), F.lit("unknown")).alias("class"),
        F.col("_best.known.label").alias("label"), F.col("_best.known.source").alias("source"),
        F.col("_best.stage").alias("stage"))


def dhcp_clients(leases: DataFrame, table: DataFrame) -> DataFrame:
    """One row per (mac, ip, option list) with the operating system its options point to."""
    clean = leases.withColumn("params_list", option_list(F.col("params_list"))).groupBy(
        "mac", "ip", "params_list").agg(F.min("host_name").alias("host_name"))
    return reputations(clean, "dhcp", "params_list", table).select(
        "mac", "ip", "params_list", "host_name", F.col("label").alias("likely_os"), "stage")
