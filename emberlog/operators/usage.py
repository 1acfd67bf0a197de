"""Usage of devices: foreground time of apps, totals per sample type, and the network timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Microseconds in a slice of time.
SLICE = 86_400_000_000


def foreground_seconds(usage: DataFrame, keys, start: str = "start", end: str = "end") -> DataFrame:
    """Seconds per key that at least one interval covers, the sum of all intervals, and their number.

    Overlapping and repeated intervals count once in `seconds`; `raw_seconds` adds them up. Intervals are cut
    at the bounds of days, so that the union of a key's intervals is a sum over days that are swept
    apart: a key with a third of all rows is as many groups as it has days, and of intervals that start
    together only the longest enters a sweep. Rows without both times take no part, those that end before
    they start count as zero seconds.
    """
    keys = list(keys)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = usage.select(*keys, us(start).alias("_s"), us(end).alias("_e")).filter(
        "_s IS NOT NULL AND _e IS NOT NULL")
    first, last = (F.expr(f"({t} - pmod({t}, {SLICE})) div {SLICE}") for t in ("_s", "(_e - 1)"))
    day = rows.withColumn("_d", F.explode(F.sequence(first, F.greatest(first, last))))
    cut = day.select(*keys, "_d", F.greatest("_s", F.col("_d") * SLICE).alias("_from"), F.least(
        "_e", (F.col("_d") + 1) * SLICE).alias("_to"), (F.col("_d") == first).alias("_own"), F.greatest(
        F.lit(0), F.col("_e") - F.col("_s")).alias("_raw"))
    starts = cut.groupBy(*keys, "_d", "_from").agg(
        F.max("_to").alias("_to"), F.count_if("_own").alias("_n"), F.sum(F.when(F.col("_own"), F.col("_raw"))).alias(
            "_raw"))
    before = W.partitionBy(*keys, "_d").orderBy("_from").rowsBetween(W.unboundedPreceding, -1)
    reached = F.coalesce(F.max("_to").over(before), F.col("_from"))
    swept = starts.withColumn("_new", F.greatest(F.lit(0), F.col("_to") - F.greatest("_from", reached)))
    return swept.groupBy(*keys).agg((F.sum("_new") / 1e6).alias("seconds"), (F.sum("_raw") / 1e6).alias(
        "raw_seconds"), F.sum("_n").alias("intervals"))


def in_focus_at(usage: DataFrame, at: Column, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that cover a point in time, both ends included."""
    return usage.filter((F.col(start) <= at) & (F.col(end) >= at))


def sample_totals(samples: DataFrame, keys, value: str) -> DataFrame:
    """Sum, number, least and largest value per key; null values only count as rows."""
    return samples.groupBy(*keys).agg(
        F.round(F.sum(value), 2).alias("total"), F.count("*").alias("n"), F.min(value).alias("lo"),
        F.max(value).alias("hi"))


def network_timeline(leases: DataFrame, networks: DataFrame) -> DataFrame:
    """Leases and the moments networks were added or joined as (ts, event, detail), by time.

    Leases: ssid, interface, router_mac, lease_start. Networks: ssid, added, joined_by_user,
    joined_by_system. Events without a time drop out.
    """
    name = F.when(F.coalesce("ssid", F.lit("")) != "", F.col("ssid")).otherwise(F.coalesce("interface", F.lit("")))
    leased = leases.select(F.col("lease_start").alias("ts"), F.lit("dhcp_lease").alias("event"), F.concat(
        name, F.lit(" via router "), F.coalesce("router_mac", F.lit(""))).alias("detail"))
    kinds = F.array(*[F.struct(F.col(c).alias("ts"), F.lit(e).alias("event")) for c, e in (
        ("added", "wifi_added"), ("joined_by_user", "wifi_joined_by_user"),
        ("joined_by_system", "wifi_joined_by_system"))])
    joined = networks.select(F.coalesce("ssid", F.lit("")).alias("detail"), F.explode(kinds).alias("k")).select(
        "k.ts", "k.event", "detail")
    return leased.unionByName(joined).filter(F.col("ts").isNotNull()).orderBy("ts", "event", "detail")


def networks_joined_on(networks: DataFrame, day: Column) -> DataFrame:
    """Networks that were added, joined or updated on a day."""
    times = [F.to_date(c) == day for c in ("added", "joined_by_user", "joined_by_system", "updated")]
    return networks.filter(F.exists(F.array(*[F.coalesce(t, F.lit(False)) for t in times]), lambda x: x))
