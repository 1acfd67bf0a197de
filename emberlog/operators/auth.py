"""Sign-in detectors: failure bursts, sprays, legacy and risky sign-ins, impossible travel.

Input columns: event_id, principal, source, failed, country, client_app, ts (others optional).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from emberlog.fixed import network as fx
from emberlog.operators.common import split_lag, top_overall, with_totals


def _failures(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce("failed", F.lit(False)))


def failure_bursts(rows: DataFrame, min_failures: int = 10, by=("principal",)) -> DataFrame:
    """Principals (or any key) with many failures."""
    keep = F.lit(True)
    for c in by:
        keep = keep & (F.coalesce(F.col(c), F.lit("")) != "")
    return _failures(rows).filter(keep).groupBy(*by).agg(
        F.count("*").alias("failures"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen")).filter(F.col("failures") >= min_failures)


def sprays(rows: DataFrame, min_principals: int = 5) -> DataFrame:
    """Sources that fail against many distinct principals."""
    pairs = _failures(rows).filter(
        (F.coalesce("source", F.lit("")) != "") & (F.coalesce("principal", F.lit("")) != "")
    ).groupBy("source", "principal").agg(F.count("*").alias("n"))
    return pairs.groupBy("source").agg(
        F.count("*").alias("principals"), F.sum("n").alias("failures")).filter(
        F.col("principals") >= min_principals)


def burst_summary(rows: DataFrame, min_failures: int = 10, k: int = 10) -> DataFrame:
    """One row: failures of the flagged principals, times over all failures, top principals."""
    flagged = failure_bursts(rows, min_failures)
    span = _failures(rows).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    totals = flagged.agg(F.count("*").alias("principals"), F.sum("failures").alias("event_count"))
    best = top_overall(flagged, "principal", "failures", k)
    return with_totals(with_totals(best, totals), span).filter(F.col("principals") > 0)


def spray_summary(rows: DataFrame, min_principals: int = 5, k: int = 10) -> DataFrame:
    """One row: all failures, flagged sources and the widest of them."""
    flagged = sprays(rows, min_principals)
    span = _failures(rows).agg(F.count("*").alias("event_count"), F.min("ts").alias("first_seen"),
                               F.max("ts").alias("last_seen"))
    best = top_overall(flagged, "source", "principals", k)
    return with_totals(with_totals(best, flagged.agg(F.count("*").alias("sources"))),
                       span).filter(F.col("sources") > 0)


def legacy_signins(rows: DataFrame) -> DataFrame:
    """Successful sign-ins over a protocol without modern authentication, per principal."""
    return rows.filter(~F.coalesce("failed", F.lit(False))
                       & F.lower(F.trim("client_app")).isin(fx.LEGACY_CLIENTS)).groupBy(
        "principal").agg(F.count("*").alias("event_count"), F.min("ts").alias("first_seen"),
                         F.max("ts").alias("last_seen"))


def risky_signins(rows: DataFrame) -> DataFrame:
    """Sign-ins the identity provider rated as high risk, per principal."""
    def low(c):
        return F.lower(F.coalesce(F.col(c), F.lit("")))
    risky = (low("risk_aggregated").isin(fx.HIGH_RISK_LEVELS)
             | low("risk_signin").isin(fx.HIGH_RISK_LEVELS)
             | low("risk_state").isin(fx.RISK_STATES))
    return rows.filter(risky).groupBy("principal").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"))


def impossible_travel(rows: DataFrame, minutes: int = 60) -> DataFrame:
    """First pair per principal of adjacent successes from two countries within the window.

    Principals seen in one country only, nearly all, go before anything is sorted.
    """
    good = rows.filter(~F.coalesce("failed", F.lit(False))
                       & (F.coalesce("principal", F.lit("")) != "")
                       & (F.trim(F.coalesce("country", F.lit(""))) != "")
                       & F.col("ts").isNotNull()).select(
        F.lower("principal").alias("principal"), F.upper(F.trim("country")).alias("country"),
        "ts", "event_id")
    travellers = good.groupBy("principal").agg(
        F.min("country").alias("a"), F.max("country").alias("b")).filter("a != b").select("principal")
    good = good.join(travellers, "principal", "left_semi")
    pairs = split_lag(good, ["principal"], "ts", "event_id", ["ts", "country"])
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(
        F.col("prev_ts").cast("timestamp"))
    hits = pairs.filter((F.col("country") != F.col("prev_country"))
                        & (gap <= minutes * 60_000_000))
    first = hits.groupBy("principal").agg(F.min_by(
        F.struct("prev_ts", "ts", "prev_country", "country"), F.struct("ts", "event_id")
    ).alias("p"))
    return first.select("principal", F.col("p.prev_ts").alias("first_seen"),
                        F.col("p.ts").alias("last_seen"),
                        F.col("p.prev_country").alias("country_from"),
                        F.col("p.country").alias("country_to"))


def source_diversity(rows: DataFrame, min_sources: int = 1) -> DataFrame:
    """Distinct sources of successful sign-ins per principal."""
    return rows.filter(~F.coalesce("failed", F.lit(False)) & F.col("source").isNotNull()).select(
        "principal", "source").distinct().groupBy("principal").agg(
        F.count("*").alias("sources")).filter(F.col("sources") >= min_sources)


def root_direct_logins(rows: DataFrame) -> DataFrame:
    """Direct remote logins of the root account: rows with a remote source."""
    local = F.coalesce("source", F.lit("")).isin("", ":0", "localhost", "127.0.0.1", "::1")
    return rows.filter((F.col("principal") == "root") & ~local)


def first_last_seen(rows: DataFrame, keys, ts: str = "ts") -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
                                   F.count("*").alias("event_count"))


def first_per_group(rows: DataFrame, keys, order, n: int) -> DataFrame:
    """The first n rows of every group in a stated order (samples of a hit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
