"""Flow, connection, HTTP, DNS and SMB detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog import functions as fn
from emberlog.fixed import network as fx
from emberlog.operators.common import (
    split_lag, spread_around_median, top_overall, with_totals)

FLOW_KEY = ["src", "dst", "dport", "proto"]


# --- periodic connections ----------------------------------------------------------------

def connection_intervals(flows: DataFrame, keys=FLOW_KEY, tie="flow_id") -> DataFrame:
    """Microseconds between consecutive connections of a key."""
    lagged = split_lag(flows.select(*keys, "ts", tie), keys, "ts", tie, ["ts"])
    return lagged.filter(F.col("prev_ts").isNotNull()).select(
        *keys, (F.unix_micros(F.col("ts").cast("timestamp"))
                - F.unix_micros(F.col("prev_ts").cast("timestamp"))).alias("gap_us"))


def _sizes():
    return [F.count("*").alias("connections"), F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen")]


def _small_key_spreads(rows: DataFrame, keys, min_connections: int) -> DataFrame:
    """Interval statistics of keys with a bounded number of rows: one shuffle, arrays per key."""
    times = rows.groupBy(*keys).agg(*_sizes(), F.array_sort(F.collect_list(F.unix_micros(
        F.col("ts").cast("timestamp")))).alias("_t")).filter(
        F.col("connections") >= min_connections)
    gaps = times.withColumn("_g", F.array_sort(F.zip_with(
        F.slice("_t", 2, F.size("_t")), F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))),
        lambda later, earlier: later - earlier)))
    n = F.size("_g")
    mid = F.when(n > 0, (F.get("_g", F.floor((n - 1) / 2).cast("int")) + F.get(
        "_g", F.floor(n / 2).cast("int"))) / 2)

    def mean(f):
        return F.try_divide(F.aggregate("_g", F.lit(0.0), lambda acc, g: acc + f(g)), n)
    with_mid = gaps.withColumns({"_m": mid, "_mean": mean(lambda g: g)})
    var = F.try_divide(F.aggregate("_g", F.lit(0.0), lambda acc, g: acc + (
        g - F.col("_mean")) * (g - F.col("_mean"))), n - 1)
    return with_mid.select(
        *keys, "connections", "first_seen", "last_seen", n.cast("bigint").alias("_intervals"), (F.col("_mean") / 1e6).alias(
            "mean_interval"), (F.sqrt(var) / 1e6).alias("stdev_interval"),
        mean(lambda g: F.abs(g - F.col("_m"))).alias("mad"))


def _large_key_spreads(rows: DataFrame, keys, tie: str) -> DataFrame:
    """The same for keys of any size: intervals by pieces, median and deviation by counting."""
    gaps = connection_intervals(rows, keys, tie)
    moments = gaps.groupBy(*keys).agg(
        F.count("*").alias("_intervals"), (F.avg("gap_us") / 1e6).alias("mean_interval"),
        (F.stddev_samp("gap_us") / 1e6).alias("stdev_interval"))
    return rows.groupBy(*keys).agg(*_sizes()).join(moments, keys).join(
        spread_around_median(gaps, keys, "gap_us").drop("median"), keys)


def beacon_scores(flows: DataFrame, min_connections: int = 10, min_intervals: int = 5,
                  keys=FLOW_KEY, tie: str = "flow_id", large_key: int = 200_000) -> DataFrame:
    """Score of every key with enough connections; 1 is perfectly periodic.

    The time score is one minus the mean absolute deviation from the median interval over the mean
    interval, the dispersion score one minus the sample deviation over the mean; both lie in [0, 1].
    Keys with more than `large_key` rows take a way that never gathers a key in one task; there are
    few of them by arithmetic (rows / large_key), and with none AQE drops that branch.
    """
    keys = list(keys)
    clean = flows.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()
                         & F.col("dport").isNotNull() & F.col("ts").isNotNull())
    large = clean.groupBy(*keys).agg(F.count("*").alias("n")).filter(
        F.col("n") > max(large_key, min_connections)).select(*keys)
    rows = clean.select(*keys, "ts", tie)
    spreads = _small_key_spreads(rows.join(large, keys, "left_anti"), keys, min_connections
                                 ).unionByName(_large_key_spreads(
                                     rows.join(large, keys, "left_semi"), keys, tie))
    scorable = (F.col("_intervals") >= min_intervals) & (F.col("mean_interval") > 0)

    def clamp(ratio):
        return F.when(scorable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio))).otherwise(
            0.0)

    return (spreads.withColumn("ts_score", clamp(F.try_divide(F.col("mad") / 1e6, "mean_interval")))
            .withColumn("dispersion_score", clamp(F.try_divide(
                "stdev_interval", "mean_interval")))
            .withColumn("score", (F.col("ts_score") + F.col("dispersion_score")) / 2)
            .withColumn("duration_seconds", fn.epoch_seconds(F.col("last_seen"))
                        - fn.epoch_seconds(F.col("first_seen")))
            .select(*keys, "connections", "first_seen", "last_seen", "duration_seconds",
                    "mean_interval", "stdev_interval", "ts_score", "dispersion_score", "score"))


def beacons(flows: DataFrame, threshold: float = 0.85, **kw) -> DataFrame:
    return beacon_scores(flows, **kw).filter(F.col("score") >= threshold)


# --- flow roll-ups ---------------------------------------------------------------------------

def repeated_flows(flows: DataFrame, min_count: int = 10) -> DataFrame:
    return flows.groupBy("src", "dst", "dport").agg(
        F.count("*").alias("flows"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"), F.sum("bytes").alias("total_bytes"),
    ).filter(F.col("flows") >= min_count)


def port_scans(flows: DataFrame, min_ports: int = 30, port: str = "dport") -> DataFrame:
    """Source and destination pairs that touch many distinct ports."""
    per_port = flows.groupBy("src", "dst", port).agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per_port.groupBy("src", "dst").agg(
        F.count(port).alias("distinct_ports"), F.min("a").alias("first_seen"),
        F.max("b").alias("last_seen")).filter(F.col("distinct_ports") >= min_ports)


def top_talkers(flows: DataFrame, n: int = 20) -> DataFrame:
    return flows.groupBy("src").agg(
        F.count("*").alias("flows"), F.sum("bytes").alias("total_bytes")
    ).orderBy(F.desc("total_bytes"), "src").limit(n)


# --- cloud flow logs ---------------------------------------------------------------------------

def rejected_scans(flows: DataFrame, min_ports: int = 20, port: str = "dport") -> DataFrame:
    """External sources rejected on many distinct ports."""
    rejected = flows.filter((F.upper("action") == "REJECT") & ~fn.is_private(F.col("src"))
                            & F.col("src").isNotNull() & F.col(port).isNotNull())
    per_port = rejected.groupBy("src", port).agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per_port.groupBy("src").agg(
        F.count("*").alias("distinct_ports"), F.sum("n").alias("event_count"),
        F.min("a").alias("first_seen"), F.max("b").alias("last_seen"),
    ).filter(F.col("distinct_ports") >= min_ports)


def _outbound(flows: DataFrame) -> DataFrame:
    return flows.filter((F.upper("action") == "ACCEPT") & fn.is_private(F.col("src"))
                        & ~fn.is_private(F.col("dst")))


def bulk_uploads(flows: DataFrame, min_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Internal to external pairs that moved at least `min_bytes`."""
    return _outbound(flows).groupBy("src", "dst").agg(
        F.sum("bytes").alias("total_bytes"), F.count("*").alias("event_count"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    ).filter(F.col("total_bytes") >= min_bytes)


def outbound_admin_sessions(flows: DataFrame) -> DataFrame:
    return _outbound(flows).filter(F.col("dport").isin(fx.FLOW_ADMIN_PORTS)).groupBy(
        "src", "dst", "dport").agg(
        F.count("*").alias("event_count"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"))


# --- endpoint tables of a memory capture ---------------------------------------------------------

def _endpoints(rows: DataFrame) -> DataFrame:
    addr = F.trim(F.coalesce(F.col("foreign_addr"), F.lit("")))
    return rows.withColumn("foreign_addr", addr).withColumn(
        "foreign_port", F.col("foreign_port").try_cast("int")).filter(
        ~fn.is_bogon(addr) & (F.col("foreign_port") != 0))


def repeat_endpoints(rows: DataFrame, min_count: int = 4) -> DataFrame:
    """Endpoints seen repeatedly outside admin ports and internal directory chatter.

    A cluster is weak when it is ordinary web traffic: a provider range, or a public web endpoint
    with fewer than ten rows and no live session.
    """
    port = F.col("foreign_port")
    kept = _endpoints(rows).filter(
        ~port.isin(list(fx.ADMIN_PORTS))
        & ~(port.isin(fx.INTERNAL_DIRECTORY_PORTS) & fn.is_rfc1918(F.col("foreign_addr"))))
    key = ["foreign_addr", "foreign_port"]
    by_state = kept.groupBy(*key, F.coalesce("state", F.lit("")).alias("state")).agg(
        F.count("*").alias("n"), F.min("proto").alias("proto"),
        F.collect_set(F.col("local_port").try_cast("int")).alias("lp"),
        F.collect_set(F.col("pid").try_cast("int")).alias("pp"))
    live = F.col("state").isin("ESTABLISHED", "SYN_SENT", "SYN_RCVD")
    out = by_state.groupBy(*key).agg(
        F.sum("n").alias("event_count"), F.min("proto").alias("proto"),
        F.sum(F.when(live, F.col("n")).otherwise(0)).alias("live_sessions"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "n")))).alias("states"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("lp")))).alias("local_ports"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("pp")))).alias("pids"),
    ).filter(F.col("event_count") >= min_count)
    weak = (F.col("foreign_port").isin(fx.CLOUD_WEB_PORTS) & (F.col("event_count") < 10)
            & fn.is_external(F.col("foreign_addr")) & (F.col("live_sessions") == 0))
    return (out.withColumn("provider", fn.provider(F.col("foreign_addr"), F.col("foreign_port")))
            .withColumn("low_signal", F.col("provider").isNotNull() | weak)
            .withColumn("port_label", fn.port_annotation(F.col("foreign_port")))
            .withColumn("port_category", fn.port_category(F.col("foreign_port"))))


def admin_port_sessions(rows: DataFrame) -> DataFrame:
    """Sessions per address and admin port, with the live ones counted apart."""
    return _endpoints(rows).filter(F.col("foreign_port").isin(list(fx.ADMIN_PORTS))).groupBy(
        "foreign_addr", "foreign_port").agg(
        F.count("*").alias("event_count"),
        F.count_if(F.upper("state") == "ESTABLISHED").alias("established"),
    ).withColumn("service", fn.port_service(F.col("foreign_port")))


def rdp_clusters(rows: DataFrame, min_count: int = 10) -> DataFrame:
    """Inbound remote-desktop connections per external address: cluster and breach flags."""
    state = F.upper(F.trim(F.coalesce(F.col("state"), F.lit(""))))
    inbound = rows.filter((F.col("local_port").try_cast("int") == 3389)
                          & F.upper("proto").startswith("TCP") & ~state.isin("LISTENING", "")
                          & fn.is_external(F.col("foreign_addr")))
    out = inbound.groupBy(F.trim("foreign_addr").alias("foreign_addr")).agg(
        F.count("*").alias("event_count"), F.count_if(state == "CLOSED").alias("closed"),
        F.count_if(state == "SYN_RCVD").alias("syn_rcvd"),
        F.count_if(state == "ESTABLISHED").alias("established"),
        F.min("created").alias("first_seen"), F.max("created").alias("last_seen"))
    seconds = fn.epoch_seconds(F.col("last_seen")) - fn.epoch_seconds(F.col("first_seen"))
    cluster = F.col("event_count") >= min_count
    return out.withColumn("duration_seconds", F.coalesce(seconds, F.lit(0.0))).withColumn(
        "is_cluster", cluster).withColumn("is_breach", cluster & (F.col("established") > 0))


# --- HTTP --------------------------------------------------------------------------------------

def http_post_ratio(http: DataFrame, min_requests: int = 30, min_share: float = 0.5) -> DataFrame:
    """One row when posts dominate the requests."""
    method = F.upper(F.coalesce("method", F.lit("")))
    n = http.agg(F.count("*").alias("total"), F.count_if(method == "GET").alias("gets"),
                 F.count_if(method == "POST").alias("posts"))
    share = F.try_divide("posts", "total")
    return n.filter((F.col("total") >= min_requests) & (F.col("posts") > 0) & (share >= min_share)
                    & (F.col("posts") > F.col("gets"))).withColumn(
        "post_share", F.round(share, 3))


def http_error_ratio(http: DataFrame, min_requests: int = 20, min_share: float = 0.3,
                     min_errors: int = 10) -> DataFrame:
    """One row when many responses are client or server errors."""
    code = F.col("status_code").try_cast("int")
    n = http.agg(F.count("*").alias("rows"), F.count(code).alias("total_responses"),
                 F.count_if(code.between(400, 499)).alias("count_4xx"),
                 F.count_if(code.between(500, 599)).alias("count_5xx"))
    errors = F.col("count_4xx") + F.col("count_5xx")
    share = errors / F.nullif(F.col("total_responses"), F.lit(0))
    return n.filter((F.col("rows") >= min_requests) & (share >= min_share)
                    & (errors >= min_errors)).select(
        "count_4xx", "count_5xx", "total_responses", F.round(share, 3).alias("error_share"))


def _agents(http: DataFrame) -> DataFrame:
    ua = F.trim(F.coalesce("user_agent", F.lit("")))
    return http.select(ua.alias("user_agent")).filter((ua != "") & (ua != "-")).groupBy(
        "user_agent").agg(F.count("*").alias("n"))


def scripted_agents(http: DataFrame) -> DataFrame:
    """Requests per scripted-client marker; an agent counts for its first marker only."""
    low = F.lower("user_agent")
    marker = fn.first_match([(low.contains(m), m) for m in fx.SCRIPTED_AGENTS])
    return _agents(http).withColumn("marker", marker).filter(F.col("marker").isNotNull()).groupBy(
        "marker").agg(F.sum("n").alias("event_count"))


def dominant_agent(http: DataFrame, min_requests: int = 30, min_share: float = 0.9) -> DataFrame:
    """The most used agent when it is no browser and makes nearly all requests."""
    counts = _agents(http)
    top = counts.orderBy(F.desc("n"), "user_agent").limit(1)
    out = with_totals(top, counts.agg(F.sum("n").alias("total")))
    browser = fn.any_contains(F.lower("user_agent"), fx.BROWSER_AGENTS)
    return out.filter((F.col("total") >= min_requests) & ~browser
                      & (F.col("n") / F.col("total") >= min_share)).withColumn(
        "share", F.round(F.col("n") / F.col("total"), 3))


# --- DNS ---------------------------------------------------------------------------------------

def _query():
    return F.trim(F.coalesce("query", F.lit("")))


def short_ttl_names(dns: DataFrame, max_ttl: float = 60.0) -> DataFrame:
    """Answers per name whose smallest TTL is at or below the limit."""
    ttls = F.transform(F.split(F.coalesce("ttls", F.lit("")), ","),
                       lambda t: F.trim(t).try_cast("double"))
    q = _query()
    return dns.withColumn("query", q).filter(
        (q != "") & (q != "-") & (F.array_min(ttls) <= max_ttl)).groupBy("query").agg(
        F.count("*").alias("event_count"))


def dns_short_ttl(dns: DataFrame, max_ttl: float = 60.0, min_names: int = 3) -> DataFrame:
    """One row with the ten busiest names when at least three names resolve with a short TTL."""
    names = short_ttl_names(dns, max_ttl)
    totals = names.agg(F.count("*").alias("domain_count"), F.sum("event_count").alias(
        "event_count"))
    return with_totals(top_overall(names, "query", "event_count", 10), totals).filter(
        F.col("domain_count") >= min_names)


def dns_domain_skew(dns: DataFrame, min_share: float = 0.5, min_queries: int = 30) -> DataFrame:
    """The most queried name when it makes up at least the given share of all queries."""
    q = _query()
    counts = dns.select(q.alias("query")).filter((q != "") & (q != "-")).groupBy("query").agg(
        F.count("*").alias("event_count"))
    out = with_totals(counts.orderBy(F.desc("event_count"), "query").limit(1),
                      counts.agg(F.sum("event_count").alias("total_queries")))
    share = F.col("event_count") / F.col("total_queries")
    return out.filter((F.col("total_queries") >= min_queries) & (share >= min_share)).withColumn(
        "share", F.round(share, 3))


def dga_labels(dns: DataFrame, min_entropy: float = 3.8, min_length: int = 10) -> DataFrame:
    """Queries per name whose first label is long and random-looking, outside CDN names."""
    names = dns.select(F.lower(_query()).alias("query")).filter(
        F.col("query").contains(".")).groupBy("query").agg(F.count("*").alias("event_count"))
    label = F.substring_index("query", ".", 1)
    return names.filter(~fn.ends_with_any(F.col("query"), fx.DGA_BENIGN_SUFFIXES)
                        & (F.length(label) >= min_length)).withColumn(
        "entropy", fn.shannon_entropy(label)).filter(F.col("entropy") >= min_entropy)


def dns_dga(dns: DataFrame, min_rows: int = 3, **kw) -> DataFrame:
    """One row with the count of random-looking queries; rows count, not distinct names."""
    flagged = dga_labels(dns, **kw)
    return flagged.agg(F.sum("event_count").alias("flagged_count"),
                       F.count("*").alias("distinct_names"),
                       F.max("entropy").alias("max_entropy")).filter(
        F.col("flagged_count") >= min_rows)


def dns_parents(dns: DataFrame) -> DataFrame:
    """Per parent (last two labels): distinct prefixes and failed lookups.

    Names are merged before they are counted per parent, so a parent that holds a third of all
    queries costs one row per distinct name.
    """
    names = dns.withColumn("query", F.lower(_query())).filter(F.col("query") != "").groupBy(
        "query").agg(F.count_if(F.upper("rcode_name").contains("NXDOMAIN")).alias("nx"))
    parts = F.split("query", r"\.")
    deep = F.size(parts) > 2
    prefix = F.when(deep, F.expr("substring(query, 1, length(query) - length(_parent) - 1)")
                    ).otherwise(F.element_at(parts, 1))
    rows = names.withColumn("_parent", F.substring_index("query", ".", -2)).select(
        F.col("_parent").alias("parent"), "nx",
        F.when(F.size(parts) >= 2, prefix).alias("prefix"))
    return rows.groupBy("parent", "prefix").agg(F.sum("nx").alias("nx")).groupBy("parent").agg(
        F.count("prefix").alias("distinct_prefixes"), F.sum("nx").alias("nxdomain"))


def dns_tunneling(dns: DataFrame, min_prefixes: int = 50, min_nxdomain: int = 50,
                  long_query: int = 100, min_rare: int = 20) -> DataFrame:
    """One row with the tunnelling signals found; two or more signals give high confidence."""
    q = F.lower(_query())
    totals = dns.filter(q != "").agg(
        F.count_if(F.length(q) >= long_query).alias("oversized"),
        F.count_if(F.upper("qtype_name").isin(fx.RARE_QTYPES)).alias("rare_qtypes"))
    parents = dns_parents(dns).agg(
        F.count_if(F.col("distinct_prefixes") >= min_prefixes).alias("wide_parents"),
        F.count_if(F.col("nxdomain") >= min_nxdomain).alias("nxdomain_parents"))
    signals = ((F.col("wide_parents") > 0).cast("int") + (F.col("nxdomain_parents") > 0).cast("int")
               + (F.col("oversized") > 0).cast("int")
               + (F.col("rare_qtypes") >= min_rare).cast("int"))
    return with_totals(totals, parents).withColumn("signals", signals).filter(
        F.col("signals") > 0).withColumn(
        "confidence", F.when(F.col("signals") >= 2, "high").otherwise("medium"))


def disposable_subdomains(hosts: DataFrame, host: str = "host", min_entropy: float = 3.0,
                          min_length: int = 10, min_count: int = 3) -> DataFrame:
    """Parents with several random-looking first labels below them, CDN parents excepted."""
    h = F.regexp_replace(F.lower(F.col(host)), r":[^:]*$", "")
    named = hosts.filter(F.col(host).contains(".")).select(h.alias("h"), fn.registered_parent(
        F.col(host)).alias("parent")).distinct()
    label = F.substring_index("h", ".", 1)
    kept = named.filter(
        ~fn.ends_with_any(F.col("parent"), fx.CDN_PARENTS)
        & F.col("h").endswith(F.concat(F.lit("."), "parent")) & (F.length(label) >= min_length)
        & (fn.shannon_entropy(label) >= min_entropy))
    return kept.groupBy("parent").agg(F.count("*").alias("host_count"), F.min("h").alias(
        "sample_host")).filter(F.col("host_count") >= min_count)


# --- SMB ---------------------------------------------------------------------------------------

def smb_writes(smb: DataFrame) -> DataFrame:
    action = F.upper(F.coalesce("action", F.lit("")))
    full = F.replace(F.concat(F.upper(F.coalesce("path", F.lit(""))), F.lit("\\"),
                              F.coalesce("name", F.lit(""))), F.lit("\\\\"), F.lit("\\"))
    return smb.filter(action.contains("WRITE") | action.contains("MODIFY")).withColumn(
        "full_path", full).withColumn(
        "admin_share", fn.any_contains(F.upper("full_path"), fx.ADMIN_SHARES))


def smb_admin_writes(smb: DataFrame) -> DataFrame:
    """Writes to admin shares per client."""
    return smb_writes(smb).filter("admin_share").groupBy("src").agg(
        F.count("*").alias("event_count"), F.min("full_path").alias("sample_path"))


def smb_write_fan_in(smb: DataFrame, min_writes: int = 25) -> DataFrame:
    """Clients with many writes to shares that are not their own."""
    client = F.trim(F.coalesce("src", F.lit("")))
    return smb_writes(smb).filter((client != "") & ~F.upper(F.coalesce(
        "path", F.lit(""))).startswith(F.upper(client))).groupBy(client.alias("src")).agg(
        F.count("*").alias("event_count")).filter(F.col("event_count") >= min_writes)


def smb_write_rows(smb: DataFrame, min_count: int = 1) -> DataFrame:
    """Write rows of (client, server) pairs with enough writes."""
    writes = smb_writes(smb)
    busy = writes.groupBy("src", "dst").agg(F.count("*").alias("pair_writes")).filter(
        F.col("pair_writes") >= min_count)
    return writes.join(busy, ["src", "dst"])
