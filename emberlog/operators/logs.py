"""Roll-ups shared by all log families: counts, searches, ranges, valued events, host signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog import functions as fn
from emberlog.fixed import endpoint as fx
from emberlog.operators.intel import lookup


def rollup(rows: DataFrame, by, ts: str = "ts") -> DataFrame:
    """Rows per group with the time range."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"),
                                 F.max(ts).alias("last_seen"))


def top_values(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values of a column; ties go to the smaller value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), column).limit(n)


def containing(rows: DataFrame, column: str, needle: str) -> DataFrame:
    return rows.filter(F.lower(column).contains(needle.lower()))


def with_address(rows: DataFrame, columns, address: str) -> DataFrame:
    """Rows that name an address in any of the columns."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c) == address, F.lit(False))
    return rows.filter(test)


def valued_events(events: DataFrame) -> DataFrame:
    """Counts of the event ids worth a look, with their labels."""
    return events.filter(F.col("event_id").isin(list(fx.VALUED_EVENTS))).groupBy("event_id").agg(
        F.count("*").alias("n")).withColumn("label", lookup(
            fx.VALUED_EVENTS, F.col("event_id").cast("int")))


def host_signals(rows: DataFrame, stage: str, minimum: int, ip: str | None = None) -> DataFrame:
    """Hosts with enough rows of one signal: count and number of external addresses behind it.

    Addresses are counted in full; each is one (host, address) row before it is counted.
    """
    if ip is None:
        return rows.groupBy("host").agg(F.count("*").alias("event_count")).filter(
            F.col("event_count") >= minimum).select(
            "host", F.lit(stage).alias("stage"), "event_count",
            F.lit(0).cast("bigint").alias("external_ips"))
    per = rows.groupBy("host", F.col(ip).alias("ip")).agg(F.count("*").alias("n"))
    return per.groupBy("host").agg(
        F.sum("n").alias("event_count"), F.count_if(fn.is_external(F.col("ip"))).alias(
            "external_ips")).filter(F.col("event_count") >= minimum).select(
        "host", F.lit(stage).alias("stage"), "event_count", "external_ips")
