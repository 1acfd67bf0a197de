"""Queries over flows, HTTP, DNS, SMB and sign-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import auth, network as net, web
from emberlog.operators.common import show_top
from emberlog.plans.adapters import adapter, sql
from emberlog.plans.registry import query

# SQL forms of the address tests, for the equivalent queries
PRIVATE = ("regexp_matches({c}, '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|127\\."
           "|169\\.254\\.|100\\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\\.)')")


def private(c):
    return PRIVATE.format(c=c)


# --- flows -----------------------------------------------------------------------------------

BEACON_SQL = """
WITH gaps AS (
  SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (
    PARTITION BY src, dst, dport, proto ORDER BY ts, flow_id) AS gap FROM flows),
med AS (
  SELECT src, dst, dport, proto, count(*) AS connections, min(ts) AS first_seen,
    max(ts) AS last_seen, count(gap) AS n, avg(gap) AS mean, median(gap) AS m,
    stddev_samp(gap) AS sd FROM gaps GROUP BY ALL HAVING count(*) >= 10),
dev AS (
  SELECT g.src, g.dst, g.dport, g.proto, avg(abs(gap - m)) AS mad FROM gaps g
  JOIN med USING (src, dst, dport, proto) WHERE gap IS NOT NULL GROUP BY ALL),
scored AS (
  SELECT *, CASE WHEN n >= 5 AND mean > 0 THEN greatest(0, least(1, 1 - mad / mean))
    ELSE 0 END AS a, CASE WHEN n >= 5 AND mean > 0 THEN greatest(0, least(1, 1 - sd / mean))
    ELSE 0 END AS b FROM med JOIN dev USING (src, dst, dport, proto))
SELECT src, dst, dport, proto, connections, first_seen, last_seen,
  round(mean / 1e6, 3) AS mean_interval, round(sd / 1e6, 3) AS stdev_interval,
  round(a, 6) AS ts_score, round(b, 6) AS dispersion_score, round((a + b) / 2, 6) AS score
FROM scored
"""


@query("beacon_score", sql("flows", BEACON_SQL))
def beacon_score(spark, sf):
    s = net.beacon_scores(adapter(spark, sf, "flows"))
    return s.select("src", "dst", "dport", "proto", "connections", "first_seen", "last_seen",
                    F.round("mean_interval", 3).alias("mean_interval"),
                    F.round("stdev_interval", 3).alias("stdev_interval"),
                    F.round("ts_score", 6).alias("ts_score"),
                    F.round("dispersion_score", 6).alias("dispersion_score"),
                    F.round("score", 6).alias("score"))


@query("flow_repeated", sql("flows", """
SELECT src, dst, dport, count(*) AS flows, min(ts) AS first_seen, max(ts) AS last_seen,
  CAST(sum(bytes) AS BIGINT) AS total_bytes FROM flows GROUP BY ALL HAVING count(*) >= 10"""))
def flow_repeated(spark, sf):
    return net.repeated_flows(adapter(spark, sf, "flows"))


@query("flow_port_scans", sql("flows", """
SELECT src, dst, count(DISTINCT wide_port) AS distinct_ports, min(ts) AS first_seen,
  max(ts) AS last_seen FROM flows GROUP BY ALL HAVING count(DISTINCT wide_port) >= 30"""))
def flow_port_scans(spark, sf):
    return net.port_scans(adapter(spark, sf, "flows"), port="wide_port")


@query("flow_top_talkers", sql("flows", """
SELECT src, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM flows GROUP BY src
ORDER BY total_bytes DESC, src LIMIT 20"""))
def flow_top_talkers(spark, sf):
    return net.top_talkers(adapter(spark, sf, "flows"))


# the driver's sources are internal, so the reversed flow gives external sources
@query("vpc_rejected_scans", sql("flows", f"""
SELECT dst AS src, count(DISTINCT wide_port) AS distinct_ports, count(*) AS event_count,
  min(ts) AS first_seen, max(ts) AS last_seen FROM flows
WHERE action = 'REJECT' AND NOT {private('dst')} GROUP BY dst
HAVING count(DISTINCT wide_port) >= 20"""))
def vpc_rejected_scans(spark, sf):
    flows = adapter(spark, sf, "flows").withColumn("src", F.col("dst"))
    return net.rejected_scans(flows, port="wide_port")


@query("vpc_bulk_uploads", sql("flows", f"""
SELECT src, dst, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS event_count,
  min(ts) AS first_seen, max(ts) AS last_seen FROM flows
WHERE action = 'ACCEPT' AND {private('src')} AND NOT {private('dst')}
GROUP BY src, dst HAVING sum(bytes) >= 4000000"""))
def vpc_bulk_uploads(spark, sf):
    return net.bulk_uploads(adapter(spark, sf, "flows"), min_bytes=4_000_000)


@query("vpc_outbound_admin", sql("flows", f"""
SELECT src, dst, dport, count(*) AS event_count, min(ts) AS first_seen, max(ts) AS last_seen
FROM flows WHERE action = 'ACCEPT' AND {private('src')} AND NOT {private('dst')}
  AND dport IN (22, 3389, 5985, 5986) GROUP BY ALL"""))
def vpc_outbound_admin(spark, sf):
    return net.outbound_admin_sessions(adapter(spark, sf, "flows"))


# --- endpoint tables ----------------------------------------------------------------------------

@query("netscan_repeat_endpoints", sql("netscan", """
WITH kept AS (
  SELECT * FROM netscan WHERE NOT starts_with(foreign_addr, '127.')
    AND foreign_port NOT IN (22, 23, 135, 139, 445, 3389, 5900, 5985, 5986)
    AND NOT (foreign_port IN (88, 389, 636, 3268, 3269, 808) AND starts_with(foreign_addr, '10.'))),
g AS (
  SELECT foreign_addr, foreign_port, count(*) AS event_count, min(proto) AS proto,
    count(*) FILTER (state = 'ESTABLISHED') AS live_sessions,
    list_sort(list(DISTINCT local_port)) AS lp, list_sort(list(DISTINCT pid)) AS pp
  FROM kept GROUP BY ALL HAVING count(*) >= 4)
SELECT foreign_addr, foreign_port, event_count, proto, live_sessions,
  array_to_string(lp, ',') AS local_ports, array_to_string(pp, ',') AS pids,
  CASE WHEN starts_with(foreign_addr, '20.40.') AND foreign_port IN (80, 443, 8443)
    THEN 'Microsoft' END AS provider,
  (starts_with(foreign_addr, '20.40.') AND foreign_port IN (80, 443, 8443))
    OR (foreign_port IN (80, 443, 8443) AND event_count < 10
        AND NOT starts_with(foreign_addr, '10.') AND live_sessions = 0) AS low_signal,
  CASE foreign_port WHEN 443 THEN 'https' WHEN 8080 THEN 'http_alt' WHEN 389 THEN 'ldap'
    WHEN 22233 THEN 'unregistered service (registered range)' ELSE 'ephemeral' END AS port_label,
  CASE WHEN foreign_port IN (443, 8080, 389) THEN 'known' WHEN foreign_port = 22233
    THEN 'registered' ELSE 'ephemeral' END AS port_category
FROM g"""))
def netscan_repeat_endpoints(spark, sf):
    r = net.repeat_endpoints(adapter(spark, sf, "netscan")).drop("states")
    return r.withColumn("local_ports", F.array_join("local_ports", ",")).withColumn(
        "pids", F.array_join("pids", ","))


@query("netscan_admin_sessions", sql("netscan", """
SELECT foreign_addr, foreign_port, count(*) AS event_count,
  count(*) FILTER (state = 'ESTABLISHED') AS established,
  CASE foreign_port WHEN 3389 THEN 'rdp' ELSE 'smb' END AS service FROM netscan
WHERE NOT starts_with(foreign_addr, '127.') AND foreign_port IN (3389, 445) GROUP BY ALL"""))
def netscan_admin_sessions(spark, sf):
    return net.admin_port_sessions(adapter(spark, sf, "netscan"))


@query("netscan_rdp_clusters", sql("netscan", """
SELECT foreign_addr, count(*) AS event_count, count(*) FILTER (state = 'CLOSED') AS closed,
  count(*) FILTER (state = 'SYN_RCVD') AS syn_rcvd,
  count(*) FILTER (state = 'ESTABLISHED') AS established, min(created) AS first_seen,
  max(created) AS last_seen,
  CAST((epoch_us(max(created)) - epoch_us(min(created))) / 1e6 AS DOUBLE) AS duration_seconds,
  count(*) >= 10 AS is_cluster,
  count(*) >= 10 AND count(*) FILTER (state = 'ESTABLISHED') > 0 AS is_breach
FROM netscan WHERE local_port = 3389 AND NOT starts_with(foreign_addr, '127.')
  AND NOT starts_with(foreign_addr, '10.') GROUP BY foreign_addr"""))
def netscan_rdp_clusters(spark, sf):
    return net.rdp_clusters(adapter(spark, sf, "netscan"))


# --- HTTP --------------------------------------------------------------------------------------

@query("http_method_ratio", sql("http", """
SELECT count(*) AS total, count(*) FILTER (method = 'GET') AS gets,
  count(*) FILTER (method = 'POST') AS posts,
  round(count(*) FILTER (method = 'POST') / count(*), 3) AS post_share
FROM http WHERE status <> '200' HAVING count(*) >= 30
  AND count(*) FILTER (method = 'POST') / count(*) >= 0.5
  AND count(*) FILTER (method = 'POST') > count(*) FILTER (method = 'GET')"""))
def http_method_ratio(spark, sf):
    http = adapter(spark, sf, "http")
    return net.http_post_ratio(http.filter(F.col("status") != "200"))


@query("http_error_rate", sql("http", """
SELECT count(*) FILTER (CAST(status AS INT) BETWEEN 400 AND 499) AS count_4xx,
  count(*) FILTER (CAST(status AS INT) BETWEEN 500 AND 599) AS count_5xx,
  count(status) AS total_responses,
  round(count(*) FILTER (CAST(status AS INT) >= 400) / count(status), 3) AS error_share
FROM http HAVING count(*) FILTER (CAST(status AS INT) >= 400) >= 10
  AND count(*) FILTER (CAST(status AS INT) >= 400) / count(status) >= 0.1"""))
def http_error_rate(spark, sf):
    return net.http_error_ratio(
        adapter(spark, sf, "http").withColumnRenamed("status", "status_code"), min_share=0.1)


@query("http_scripted_agents", sql("http", """
SELECT CASE WHEN user_agent LIKE 'curl/%' THEN 'curl/' ELSE 'python-requests/' END AS marker,
  count(*) AS event_count FROM http
WHERE user_agent LIKE 'curl/%' OR user_agent LIKE 'python-requests/%' GROUP BY ALL"""))
def http_scripted_agents(spark, sf):
    return net.scripted_agents(adapter(spark, sf, "http"))


@query("http_dominant_agent", sql("http", """
WITH ua AS (SELECT user_agent, count(*) AS n FROM http WHERE user_agent <> '-'
  AND user_agent NOT LIKE 'Mozilla%' GROUP BY ALL),
t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM ua)
SELECT user_agent, n, total, round(n / total, 3) AS share FROM ua, t
WHERE n / total >= 0.3 ORDER BY n DESC, user_agent LIMIT 1"""))
def http_dominant_agent(spark, sf):
    http = adapter(spark, sf, "http").filter(~F.col("user_agent").startswith("Mozilla"))
    return net.dominant_agent(http, min_share=0.3)


def _web_oracle(names, tokens, admin, exts, prefix, recon):
    def lst(xs):
        return ", ".join(f"'{x}'" for x in xs)
    flags = f"""
WITH r AS (SELECT src, method, path, lower(path) AS low, lower(query) AS q, status,
    lower(user_agent) AS ua, ts FROM http),
offensive AS (SELECT *, ua LIKE '%sqlmap%' AS bad,
    ua LIKE '%curl/%' OR ua LIKE '%python-requests%' OR ua LIKE '%requests%' AS gen FROM r),
f AS (
  SELECT '{prefix}_WEBSHELL_URI_SHAPE' AS rule_id, src, ts FROM offensive
   WHERE regexp_extract(low, '([^/]*)$', 1) IN ({lst(names)}) OR contains(q, 'cmd=')
  UNION ALL SELECT '{prefix}_SCRIPTED_CLIENT_OFFENSIVE', src, ts FROM offensive WHERE bad
  UNION ALL SELECT '{prefix}_SCRIPTED_CLIENT_GENERIC', src, ts FROM offensive
   WHERE NOT bad AND gen AND status LIKE '2%'
  UNION ALL SELECT '{prefix}_ADMIN_URI_HIT', src, ts FROM offensive
   WHERE starts_with(low, '/wp-admin/') AND (status LIKE '2%' OR status LIKE '3%')
     AND src NOT LIKE '10.%'),
hits AS (SELECT rule_id, src AS entity, count(*) AS event_count, min(ts) AS first_seen,
    max(ts) AS last_seen FROM f GROUP BY ALL
  UNION ALL SELECT '{prefix}_UPLOAD_POST_BURST', src || ' ' || path, count(*), min(ts), max(ts)
   FROM r WHERE method = 'POST' AND regexp_matches(low, '\\.(php|jsp)$') GROUP BY src, path
   HAVING count(*) >= 3 AND count(*) FILTER (status LIKE '2%') > 0
  UNION ALL SELECT '{prefix}_VERB_TUNNEL', 'all', count(*), min(ts), max(ts) FROM r
   WHERE method = 'PROPFIND' HAVING count(*) >= 50
"""
    if recon:
        flags += f"""  UNION ALL SELECT '{prefix}_4XX_RECON_BURST', src, count(*), min(ts), max(ts)
   FROM r WHERE status LIKE '4%' AND src NOT LIKE '10.%' GROUP BY src
   HAVING count(*) >= 30 AND count(DISTINCT path) >= 10
"""
    return flags + ") SELECT * FROM hits"


@query("web_access_hits", sql("http", _web_oracle(
    web.UNIX.names, web.UNIX.tokens, web.UNIX.admin_paths, web.UNIX.script_extensions, "WEB", True)))
def web_access_hits(spark, sf):
    return web.web_hits(adapter(spark, sf, "http"))


@query("w3c_access_hits", sql("http", _web_oracle(
    web.WINDOWS.names, web.WINDOWS.tokens, web.WINDOWS.admin_paths,
    web.WINDOWS.script_extensions, "W3C", False)))
def w3c_access_hits(spark, sf):
    return web.web_hits(adapter(spark, sf, "http"), web.WINDOWS)


# --- DNS ---------------------------------------------------------------------------------------

@query("dns_short_ttl", sql("dns", """
WITH n AS (SELECT query, count(*) AS event_count FROM dns
  WHERE least(CAST(split_part(ttls, ',', 1) AS DOUBLE), CAST(split_part(ttls, ',', 2) AS DOUBLE))
    <= 60 GROUP BY query),
best AS (SELECT * FROM n ORDER BY event_count DESC, query LIMIT 10)
SELECT (SELECT string_agg(query || '=' || event_count, ';' ORDER BY event_count DESC, query)
    FROM best) AS top, count(*) AS domain_count, CAST(sum(event_count) AS BIGINT) AS event_count
FROM n HAVING count(*) >= 3"""))
def dns_short_ttl(spark, sf):
    return net.dns_short_ttl(adapter(spark, sf, "dns")).withColumn("top", show_top(F.col("top")))


@query("dns_domain_skew", sql("dns", """
WITH n AS (SELECT query, count(*) AS event_count FROM dns GROUP BY query),
t AS (SELECT CAST(sum(event_count) AS BIGINT) AS total_queries FROM n)
SELECT query, event_count, total_queries, round(event_count / total_queries, 3) AS share
FROM n, t WHERE total_queries >= 30 AND event_count / total_queries >= 0.001
ORDER BY event_count DESC, query LIMIT 1"""))
def dns_domain_skew(spark, sf):
    return net.dns_domain_skew(adapter(spark, sf, "dns"), min_share=0.001)


ENTROPY_SQL = """CASE WHEN length({s}) = 0 THEN 0.0 ELSE abs(list_sum(list_transform(
  list_distinct(string_split({s}, '')), lambda c: (length({s}) - length(replace({s}, c, '')))
  / length({s}) * log2((length({s}) - length(replace({s}, c, ''))) / length({s}))))) END"""


@query("dns_dga_labels", sql("dns", f"""
WITH n AS (SELECT query, count(*) AS event_count, split_part(query, '.', 1) AS l FROM dns
  WHERE contains(query, '.') GROUP BY query),
e AS (SELECT query, event_count, {ENTROPY_SQL.format(s='l')} AS h FROM n WHERE length(l) >= 10)
SELECT query, event_count, round(h, 6) AS entropy FROM e WHERE h >= 3.5"""))
def dns_dga_labels(spark, sf):
    return net.dga_labels(adapter(spark, sf, "dns"), min_entropy=3.5).withColumn(
        "entropy", F.round("entropy", 6))


@query("dns_dga", sql("dns", f"""
WITH n AS (SELECT query, count(*) AS event_count, split_part(query, '.', 1) AS l FROM dns
  WHERE contains(query, '.') GROUP BY query),
e AS (SELECT query, event_count, {ENTROPY_SQL.format(s='l')} AS h FROM n WHERE length(l) >= 10)
SELECT CAST(sum(event_count) AS BIGINT) AS flagged_count, count(*) AS distinct_names,
  round(max(h), 6) AS max_entropy FROM e WHERE h >= 3.5 HAVING sum(event_count) >= 3"""))
def dns_dga(spark, sf):
    return net.dns_dga(adapter(spark, sf, "dns"), min_entropy=3.5).withColumn(
        "max_entropy", F.round("max_entropy", 6))


@query("dns_parents", sql("dns", """
WITH r AS (SELECT regexp_extract(query, '([^.]+[.][^.]+)$', 1) AS parent, query,
  rcode_name = 'NXDOMAIN' AS nx FROM dns)
SELECT parent, count(DISTINCT substr(query, 1, length(query) - length(parent) - 1))
  AS distinct_prefixes, count(*) FILTER (nx) AS nxdomain FROM r GROUP BY parent"""))
def dns_parents(spark, sf):
    return net.dns_parents(adapter(spark, sf, "dns"))


@query("dns_tunneling", sql("dns", """
WITH r AS (SELECT regexp_extract(query, '([^.]+[.][^.]+)$', 1) AS parent, query,
  rcode_name = 'NXDOMAIN' AS nx FROM dns),
p AS (SELECT parent, count(DISTINCT substr(query, 1, length(query) - length(parent) - 1)) AS d,
  count(*) FILTER (nx) AS n FROM r GROUP BY parent),
a AS (SELECT count(*) FILTER (length(query) >= 100) AS oversized,
  count(*) FILTER (qtype_name = 'TXT') AS rare_qtypes FROM dns),
b AS (SELECT count(*) FILTER (d >= 50) AS wide_parents, count(*) FILTER (n >= 50)
  AS nxdomain_parents FROM p),
s AS (SELECT *, CAST(wide_parents > 0 AS INT) + CAST(nxdomain_parents > 0 AS INT)
  + CAST(oversized > 0 AS INT) + CAST(rare_qtypes >= 20 AS INT) AS signals FROM a, b)
SELECT *, CASE WHEN signals >= 2 THEN 'high' ELSE 'medium' END AS confidence
FROM s WHERE signals > 0"""))
def dns_tunneling(spark, sf):
    return net.dns_tunneling(adapter(spark, sf, "dns"))


@query("disposable_subdomains", sql("dns", f"""
WITH h AS (SELECT DISTINCT query AS h, regexp_extract(query, '([^.]+[.][^.]+)$', 1) AS parent,
  split_part(query, '.', 1) AS l FROM dns),
k AS (SELECT *, {ENTROPY_SQL.format(s='l')} AS e FROM h WHERE length(l) >= 10 AND h <> parent)
SELECT parent, count(*) AS host_count, min(h) AS sample_host FROM k WHERE e >= 3.0
GROUP BY parent HAVING count(*) >= 3"""))
def disposable_subdomains(spark, sf):
    return net.disposable_subdomains(adapter(spark, sf, "dns"), host="query")


# --- SMB ---------------------------------------------------------------------------------------

SMB_WRITES = "action IN ('SMB::FILE_WRITE', 'SMB::FILE_MODIFY')"


@query("smb_admin_writes", sql("smb", f"""
SELECT src, count(*) AS event_count, min(replace(upper(path) || chr(92) || name, chr(92) || chr(92),
  chr(92))) AS sample_path FROM smb WHERE {SMB_WRITES} AND path LIKE '%C$' GROUP BY src"""))
def smb_admin_writes(spark, sf):
    return net.smb_admin_writes(adapter(spark, sf, "smb"))


@query("smb_write_fan_in", sql("smb", f"""
SELECT src, count(*) AS event_count FROM smb WHERE {SMB_WRITES} GROUP BY src
HAVING count(*) >= 25"""))
def smb_write_fan_in(spark, sf):
    return net.smb_write_fan_in(adapter(spark, sf, "smb"))


@query("smb_write_rows", sql("smb", f"""
WITH w AS (SELECT src, dst, action, path, name, ts, count(*) OVER (PARTITION BY src, dst)
  AS pair_writes FROM smb WHERE {SMB_WRITES})
SELECT src, dst, action, name, pair_writes, ts FROM w WHERE pair_writes >= 20"""))
def smb_write_rows(spark, sf):
    return net.smb_write_rows(adapter(spark, sf, "smb"), min_count=20).select(
        "src", "dst", "action", "name", "pair_writes", "ts")


# --- sign-ins -----------------------------------------------------------------------------------

@query("signin_failure_burst", sql("authn", """
SELECT principal, count(*) AS failures, min(ts) AS first_seen, max(ts) AS last_seen FROM authn
WHERE failed GROUP BY principal HAVING count(*) >= 10"""))
def signin_failure_burst(spark, sf):
    return auth.failure_bursts(adapter(spark, sf, "authn"))


@query("signin_failure_burst_by_source", sql("authn", """
SELECT principal, source, count(*) AS failures, min(ts) AS first_seen, max(ts) AS last_seen
FROM authn WHERE failed GROUP BY ALL HAVING count(*) >= 5"""))
def signin_failure_burst_by_source(spark, sf):
    return auth.failure_bursts(adapter(spark, sf, "authn"), 5, by=("principal", "source"))


@query("signin_burst_summary", sql("authn", """
WITH b AS (SELECT principal, count(*) AS n FROM authn WHERE failed GROUP BY principal
  HAVING count(*) >= 10),
best AS (SELECT * FROM b ORDER BY n DESC, principal LIMIT 10)
SELECT (SELECT string_agg(principal || '=' || n, ';' ORDER BY n DESC, principal) FROM best) AS top,
  count(*) AS principals, CAST(sum(n) AS BIGINT) AS event_count,
  (SELECT min(ts) FROM authn WHERE failed) AS first_seen,
  (SELECT max(ts) FROM authn WHERE failed) AS last_seen FROM b HAVING count(*) > 0"""))
def signin_burst_summary(spark, sf):
    return auth.burst_summary(adapter(spark, sf, "authn")).withColumn("top", show_top(F.col("top")))


@query("signin_spray", sql("authn", """
SELECT source, count(DISTINCT principal) AS principals, count(*) AS failures FROM authn
WHERE failed GROUP BY source HAVING count(DISTINCT principal) >= 5"""))
def signin_spray(spark, sf):
    return auth.sprays(adapter(spark, sf, "authn"))


@query("signin_spray_summary", sql("authn", """
WITH b AS (SELECT source, count(DISTINCT principal) AS n FROM authn WHERE failed GROUP BY source
  HAVING count(DISTINCT principal) >= 5),
best AS (SELECT * FROM b ORDER BY n DESC, source LIMIT 10)
SELECT (SELECT string_agg(source || '=' || n, ';' ORDER BY n DESC, source) FROM best) AS top,
  (SELECT count(*) FROM b) AS sources, count(*) AS event_count, min(ts) AS first_seen,
  max(ts) AS last_seen FROM authn WHERE failed"""))
def signin_spray_summary(spark, sf):
    return auth.spray_summary(adapter(spark, sf, "authn")).withColumn("top", show_top(F.col("top")))


@query("signin_legacy", sql("authn", """
SELECT principal, count(*) AS event_count, min(ts) AS first_seen, max(ts) AS last_seen FROM authn
WHERE NOT failed AND client_app IN ('IMAP4', 'Other clients') GROUP BY principal"""))
def signin_legacy(spark, sf):
    return auth.legacy_signins(adapter(spark, sf, "authn"))


@query("signin_risky", sql("authn", """
SELECT principal, count(*) AS event_count, min(ts) AS first_seen, max(ts) AS last_seen FROM authn
WHERE risk_aggregated = 'high' OR risk_signin = 'High' OR risk_state = 'atRisk'
GROUP BY principal"""))
def signin_risky(spark, sf):
    return auth.risky_signins(adapter(spark, sf, "authn"))


@query("signin_source_diversity", sql("authn", """
SELECT principal, count(DISTINCT source) AS sources FROM authn WHERE NOT failed
GROUP BY principal HAVING count(DISTINCT source) >= 3"""))
def signin_source_diversity(spark, sf):
    return auth.source_diversity(adapter(spark, sf, "authn"), 3)


@query("signin_root_remote", sql("authn", """
SELECT principal, source, ts FROM authn WHERE principal = 'user7' AND NOT failed"""))
def signin_root_remote(spark, sf):
    rows = adapter(spark, sf, "authn").filter(~F.col("failed")).withColumn(
        "name", F.col("principal")).withColumn(
        "principal", F.when(F.col("name") == "user7", "root").otherwise(F.col("name")))
    return auth.root_direct_logins(rows).select(F.col("name").alias("principal"), "source", "ts")


@query("impossible_travel", sql("authn", """
WITH s AS (SELECT *, lag(ts) OVER w AS pts, lag(country) OVER w AS pc FROM authn WHERE NOT failed
  WINDOW w AS (PARTITION BY principal ORDER BY ts, event_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY principal ORDER BY ts, event_id) AS rn FROM s
  WHERE country <> pc AND epoch_us(ts) - epoch_us(pts) <= 36000000000)
SELECT principal, pts AS first_seen, ts AS last_seen, pc AS country_from, country AS country_to
FROM h WHERE rn = 1"""))
def impossible_travel(spark, sf):
    return auth.impossible_travel(adapter(spark, sf, "authn"), minutes=600)


@query("first_last_seen", sql("authn", """
SELECT principal, source, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS event_count
FROM authn GROUP BY ALL"""))
def first_last_seen(spark, sf):
    return auth.first_last_seen(adapter(spark, sf, "authn"), ["principal", "source"])


@query("top_n_per_group", sql("authn", """
WITH c AS (SELECT source, principal, count(*) AS n FROM authn GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, principal) AS rank FROM c)
SELECT source, principal, n, rank FROM r WHERE rank <= 5"""))
def top_n_per_group(spark, sf):
    counts = adapter(spark, sf, "authn").groupBy("source", "principal").agg(
        F.count("*").alias("n"))
    return auth.first_per_group(counts, ["source"], [F.desc("n"), F.asc("principal")], 5)
