"""Summaries of intrusion-detector events: counts per facet and clusters of alerts.

All figures come from one count of facet values: each event gives one row per facet it has, counts are
combined before they are shuffled, and everything else works on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from emberlog import functions as fn
from emberlog.operators.common import explode_rows

#: Facets whose values are few; the others are cut to the most frequent ones.
WHOLE = ("event_type", "anomaly")


def _facet(name: str, value: Column, test: Column | None = None) -> Column:
    text = value.cast("string")
    there = text.isNotNull() & (text != "")
    return F.when(there if test is None else there & test, F.struct(F.lit(name).alias("facet"), text.alias("value")))


def facet_counts(events: DataFrame) -> DataFrame:
    """facet, signature_id, signature, value, n, first_seen, last_seen, severity and category of events.

    The facets are event_type, src_ip, dest_ip, http_host, http_agent, dns_query, tls_sni and anomaly, and
    per signature alert, alert_src, alert_dst, alert_port and alert_technique. Severity (3 if none or 0 is given) and
    category are those of the signature's first event; equal times go to the smaller pair.
    """
    kind = F.col("event_type")
    alert, dns = kind == "alert", kind == "dns"
    asked = dns & ((F.col("dns.type") == "query") | F.col("dns.query").isNotNull())
    none = F.array().cast("array<string>")
    techniques = F.array_distinct(F.concat(
        F.coalesce("alert.metadata.mitre_technique_id", none),
        F.coalesce("alert.metadata.mitre_attack_technique_id", none)))
    facets = [
        F.struct(F.lit("event_type").alias("facet"), kind.alias("value")),
        _facet("src_ip", F.col("src_ip")), _facet("dest_ip", F.col("dest_ip")),
        F.when(alert, F.struct(F.lit("alert").alias("facet"), F.lit("").alias("value"))),
        _facet("alert_src", F.col("src_ip"), alert), _facet("alert_dst", F.col("dest_ip"), alert),
        _facet("alert_port", F.col("dest_port").try_cast("bigint"), alert),
        _facet("http_host", F.col("http.hostname"), kind == "http"),
        _facet("http_agent", F.col("http.http_user_agent"), kind == "http"),
        _facet("dns_query", F.coalesce(F.nullif(F.col("dns.rrname"), F.lit("")), "dns.query"), asked),
        _facet("tls_sni", F.col("tls.sni"), kind == "tls"),
        _facet("anomaly", F.coalesce(F.nullif(F.col("anomaly.event"), F.lit("")), "anomaly.type"), kind == "anomaly")]
    named = F.transform(F.when(alert, techniques).otherwise(none), lambda t: F.struct(
        F.lit("alert_technique").alias("facet"), t.alias("value")))
    found = F.concat(F.filter(F.array(*facets), lambda f: f.isNotNull()), named)
    given = F.coalesce(F.nullif(F.col("alert.severity").try_cast("int"), F.lit(0)), F.lit(3))
    # fields are taken out of their structs first; the rows then hold nothing nested but the facets
    flat = events.select(
        found.alias("_found"), fn.parse_iso(F.col("timestamp")).alias("_ts"),
        F.coalesce(F.col("alert.signature_id").try_cast("bigint"), F.lit(0)).alias("_sid"),
        F.coalesce("alert.signature", F.lit("")).alias("_sig"), given.alias("_severity"),
        F.coalesce("alert.category", F.lit("")).alias("_category"))
    rows = explode_rows(flat, F.col("_found"), "_f", "_ts", "_sid", "_sig", "_severity", "_category")
    of_alert = F.col("_f.facet").startswith("alert")
    head = F.min(F.when(of_alert, F.struct(F.col("_ts").isNull(), "_ts", "_severity", "_category")))
    return rows.groupBy(
        F.col("_f.facet").alias("facet"), F.when(of_alert, F.col("_sid")).alias("signature_id"),
        F.when(of_alert, F.col("_sig")).alias("signature"), F.col("_f.value").alias("value")).agg(
        F.count("*").alias("n"), F.min("_ts").alias("first_seen"), F.max("_ts").alias("last_seen"),
        head.alias("_head")).select("*", "_head._severity", "_head._category").withColumnsRenamed(
        {"_severity": "severity", "_category": "category"}).drop("_head")


def top_facets(counts: DataFrame, k: int = 50) -> DataFrame:
    """The `k` most frequent values of each facet, ties to the smaller; all event types and anomalies."""
    order = W.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.filter(~F.col("facet").startswith("alert")).select(
        "facet", F.row_number().over(order).alias("rank"), "value", "n").filter(
        (F.col("rank") <= k) | F.col("facet").isin(*WHOLE))


def signature_clusters(counts: DataFrame, k: int = 10) -> DataFrame:
    """One row per signature: events, severity, category, times, and its `k` least sources, destinations and ports.

    Techniques are all listed. Ports are ordered as numbers.
    """
    key = ["signature_id", "signature"]
    number = F.when(F.col("facet") == "alert_port", F.col("value").cast("bigint"))
    alerts = counts.filter(F.col("facet").startswith("alert")).withColumn("_number", number)
    rank = F.row_number().over(W.partitionBy(*key, "facet").orderBy("_number", "value"))
    few = alerts.withColumn("_rank", rank).filter((F.col("_rank") <= k) | (F.col("facet") == "alert_technique"))

    def of(facet: str, column: str) -> Column:
        return F.max(F.when(F.col("facet") == facet, F.col(column)))

    def listed(facet: str) -> Column:
        packed = F.sort_array(F.collect_list(F.when(F.col("facet") == facet, F.struct("_rank", "value"))))
        return F.transform(packed, lambda s: s["value"])
    return few.groupBy(*key).agg(
        of("alert", "n").alias("event_count"), of("alert", "severity").alias("severity"),
        of("alert", "category").alias("category"), of("alert", "first_seen").alias("first_seen"),
        of("alert", "last_seen").alias("last_seen"), listed("alert_src").alias("src_ips"),
        listed("alert_dst").alias("dest_ips"), listed("alert_port").alias("dest_ports"),
        listed("alert_technique").alias("techniques"))
