"""Queries over intrusion-detector events, written as JSON lines from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberlog.operators import ids
from emberlog.plans.adapters import EVENT_K, events
from emberlog.plans.registry import query
from emberlog.sources import json_logs as js

LINE = r"""concat('{"timestamp": "', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '", "event_type": "',
  element_at(array('alert', 'HTTP', 'dns', 'tls', 'anomaly', 'fileinfo'), CAST(event_id % 6 + 1 AS INT)),
  '", "src_ip": "198.51.100.', k, '", "dest_ip": "10.0.0.', user_id % 250, '", "dest_port": ', CASE WHEN k % 2 = 0
  THEN CAST(80 + k % 40 AS STRING) ELSE concat('"', 80 + k % 40, '"') END, CASE event_id % 6
  WHEN 0 THEN concat(', "alert": {"signature_id": ', 2000 + k % 9, ', "signature": "sig ', k % 9, '", "severity": ',
    k % 4, ', "category": "c', k % 3, '", "metadata": {"mitre_technique_id": ["T10', k % 3, '0", "T1100"]}}')
  WHEN 1 THEN concat(', "http": {"hostname": "h', k % 60, '.example", "http_user_agent": "agent/', k % 5, '"}')
  WHEN 2 THEN concat(', "dns": {"type": "', CASE WHEN k % 3 = 0 THEN 'answer' ELSE 'query' END, '", "rrname": "d', k,
    '.example"}')
  WHEN 3 THEN concat(', "tls": {"sni": "s', k % 70, '.example"}')
  WHEN 4 THEN CASE WHEN k % 2 = 0 THEN concat(', "anomaly": {"event": "e', k % 6, '"}')
    ELSE ', "anomaly": {"type": "stream"}' END
  ELSE ', "fileinfo": {"sha256": "00"}' END, CASE WHEN k % 10 = 7 THEN '' ELSE '}' END)"""
#: Lines without their closing brace are no JSON.
ROWS = f"e AS (SELECT *, {EVENT_K}, date_trunc('second', ts) AS t FROM events), v AS (SELECT * FROM e WHERE k % 10 <> 7)"


def facets(spark, sf) -> DataFrame:
    return ids.facet_counts(js.eve_rows(events(spark, sf).selectExpr(f"{LINE} AS value")))


@query("ids_event_facets", f"""WITH {ROWS}, f AS (
  SELECT 'event_type' AS facet, ['alert', 'http', 'dns', 'tls', 'anomaly', 'fileinfo'][event_id % 6 + 1] AS value FROM v
  UNION ALL SELECT 'src_ip', '198.51.100.' || k FROM v
  UNION ALL SELECT 'dest_ip', '10.0.0.' || user_id % 250 FROM v
  UNION ALL SELECT 'http_host', 'h' || k % 60 || '.example' FROM v WHERE event_id % 6 = 1
  UNION ALL SELECT 'http_agent', 'agent/' || k % 5 FROM v WHERE event_id % 6 = 1
  UNION ALL SELECT 'dns_query', 'd' || k || '.example' FROM v WHERE event_id % 6 = 2 AND k % 3 <> 0
  UNION ALL SELECT 'tls_sni', 's' || k % 70 || '.example' FROM v WHERE event_id % 6 = 3
  UNION ALL SELECT 'anomaly', CASE WHEN k % 2 = 0 THEN 'e' || k % 6 ELSE 'stream' END FROM v WHERE event_id % 6 = 4),
c AS (SELECT facet, value, count(*) AS n FROM f GROUP BY ALL)
SELECT facet, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank, value, n FROM c
QUALIFY rank <= 50 OR facet IN ('event_type', 'anomaly')""")
def ids_event_facets(spark, sf):
    return ids.top_facets(facets(spark, sf))


@query("ids_signatures", f"""WITH {ROWS}, a AS (SELECT 2000 + k % 9 AS signature_id, 'sig ' || k % 9 AS signature, t,
  CASE WHEN k % 4 = 0 THEN 3 ELSE k % 4 END AS severity, 'c' || k % 3 AS category, '198.51.100.' || k AS src,
  '10.0.0.' || user_id % 250 AS dst, 80 + k % 40 AS port, 'T10' || k % 3 || '0' AS technique
  FROM v WHERE event_id % 6 = 0)
SELECT signature_id, signature, count(*) AS event_count, min((t, severity, category))[2]::INT AS severity,
  min((t, severity, category))[3] AS category, min(t) AS first_seen, max(t) AS last_seen,
  array_to_string(list_sort(list(DISTINCT src))[1:10], ',') AS src_ips,
  array_to_string(list_sort(list(DISTINCT dst))[1:10], ',') AS dest_ips,
  array_to_string(list_sort(list(DISTINCT port))[1:10], ',') AS dest_ports,
  array_to_string(list_sort(list_distinct(list_concat(list(technique), ['T1100']))), ',') AS techniques
FROM a GROUP BY ALL""")
def ids_signatures(spark, sf):
    found = ids.signature_clusters(facets(spark, sf))
    return found.selectExpr(
        "signature_id", "signature", "event_count", "severity", "category",
        "CAST(first_seen AS TIMESTAMP_NTZ) AS first_seen", "CAST(last_seen AS TIMESTAMP_NTZ) AS last_seen",
        *[f"array_join({c}, ',') AS {c}" for c in ("src_ips", "dest_ips", "dest_ports", "techniques")])
