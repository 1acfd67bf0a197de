"""Queries over registries, fingerprints, DNS links and device usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.fixed import fingerprints as fx
from emberlog.operators import fingerprints as fp, indicators as ind, usage
from emberlog.plans.adapters import adapter, events, sql, table
from emberlog.plans.indicator_queries import DOC_IOCS, PAGE_IOCS, document_iocs, page_iocs, q
from emberlog.plans.registry import query
from emberlog.session import scratch_path
from emberlog.sinks import tables as sinks


# --- registries: what the insert paths commit --------------------------------------------------------

@query("ioc_registry_commits", f"""WITH {DOC_IOCS}, {PAGE_IOCS},
p AS (SELECT DISTINCT ioc_type, value FROM pgs), d AS (SELECT DISTINCT ioc_type, value FROM docs)
SELECT 1 AS version, ioc_type, count(*) AS new_rows FROM p GROUP BY ioc_type UNION ALL
SELECT 2, ioc_type, count(*) FROM (FROM d EXCEPT FROM p) GROUP BY ioc_type""")
def ioc_registry_commits(spark, sf):
    """Indicators of pages, then of documents, into one registry of one case; the second commit adds the unseen."""
    path, key = scratch_path(spark, "iocs"), ["ioc_type", "value", "case_id"]
    for found in (page_iocs(spark, sf), document_iocs(spark, sf)):
        sinks.insert_new(found.select("ioc_type", "value", F.lit("all").alias("case_id"), "observed"), path, key)
    return sinks.read_registry(spark, path).groupBy("version", "ioc_type").agg(F.count("*").alias("new_rows"))


@query("digest_registry_seals", """
WITH d AS (SELECT DISTINCT source AS case_id, sha256(coalesce(text, '')) AS sha256, doc_id IN (
    SELECT doc_id FROM labels) AS labelled, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM documents),
k AS (SELECT case_id, sha256, bool_or(labelled) AS first FROM d GROUP BY ALL),
c AS (SELECT DISTINCT case_id FROM d WHERE toxic)
SELECT case_id, first AND case_id IN (FROM c) AS sealed, count(*) AS n FROM k GROUP BY ALL""")
def digest_registry_seals(spark, sf):
    """Digests of labelled documents, seals of the cases with toxic ones, then digests of all documents."""
    path = scratch_path(spark, "digests")
    docs = table(spark, sf, "documents").select(F.col("source").alias("case_id"), F.sha2(F.coalesce(
        "text", F.lit("")), 256).alias("sha256"), "doc_id")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    sinks.insert_new(docs.join(labels, "doc_id", "left_semi"), path, ["case_id", "sha256"])
    sinks.seal_cases(docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi"), path)
    sinks.insert_new(docs, path, ["case_id", "sha256"])
    return sinks.read_registry(spark, path).groupBy("case_id", "sealed").agg(F.count("*").alias("n"))


@query("ledger_commits", sql("findings", """SELECT case_id, CASE WHEN confidence = 'high' THEN 2 ELSE 1 END AS version,
count(*) AS n, count(DISTINCT claim) AS claims FROM findings GROUP BY ALL"""))
def ledger_commits(spark, sf):
    """All findings, then those of high confidence again: the later commit replaces them."""
    path = scratch_path(spark, "ledger")
    rows = adapter(spark, sf, "findings").select("finding_id", "case_id", "claim", "confidence", "created")
    sinks.insert_findings(rows, path)
    sinks.insert_findings(rows.filter("confidence = 'high'"), path)
    return sinks.list_findings(spark, path).groupBy("case_id", "version").agg(
        F.count("*").alias("n"), F.count_distinct("claim").alias("claims"))


# --- fingerprints ---------------------------------------------------------------------------------------

JA3_SEEN = "CASE WHEN k % 9 < 5 THEN upper([{}][k % 9 + 1]) WHEN k % 9 = 5 THEN 'no hash' ELSE md5(event_type) END".format(
    ", ".join(q(r[0]) for r in fx.JA3))
E = "e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"


def picked(values, k: str):
    """One of some values by number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(k) + 1).cast("int"))


@query("ja3_reputation", f"""WITH {E}, t(ja3, class, label, source) AS (VALUES {', '.join(
    '(' + ', '.join(q(v) if v else 'NULL' for v in r) + ')' for r in fx.JA3)}),
s AS (SELECT event_id, {JA3_SEEN} AS ja3 FROM e)
SELECT event_id, coalesce(class, 'unknown') AS class, label, source FROM s LEFT JOIN t ON lower(s.ja3) = t.ja3""")
def ja3_reputation(spark, sf):
    seen = events(spark, sf).select("event_id", F.when(F.expr("k % 9 < 5"), F.upper(picked(
        [r[0] for r in fx.JA3], "least(k % 9, 4)"))).when(F.expr("k % 9 = 5"), "no hash").otherwise(
        F.md5("event_type")).alias("ja3"))
    return fp.reputations(seen, "ja3", "ja3", fp.known_fingerprints(spark)).select(
        "event_id", "class", "label", "source")


#: Fingerprints of the queries' JA4 table, and the ones seen: the same, with another middle, last and first part.
JA4_TABLE = (("t13d1516h2_8daaf6152771_b186095e22b6", "tool one"), ("t12d0909h1_aaaaaaaaaaaa_bbbbbbbbbbbb", "tool two"),
             ("t12d0909h1_cccccccccccc_bbbbbbbbbbbb", "tool three"))
JA4_SEEN = ("t13d1516h2_8daaf6152771_b186095e22b6", "t13d1516h2_000000000000_b186095e22b6",
            "t13d1516h2_8daaf6152771_000000000000", "q13d0000h3_8daaf6152771_b186095e22b6",
            "t12d0909h1_000000000000_bbbbbbbbbbbb", "t12d0909h1_aaaaaaaaaaaa_000000000000", "odd", "a_b_c")


@query("ja4_reputation", f"""WITH {E}, s AS (SELECT event_id, [{', '.join(map(q, JA4_SEEN))}][k % 8 + 1] AS ja4 FROM e)
SELECT event_id, ja4, CASE WHEN ja4 LIKE '%000000000000_bbbbbbbbbbbb' OR ja4 IN ('odd', 'a_b_c') THEN 'unknown'
    ELSE 'known_bad' END AS class,
  CASE WHEN ja4 LIKE '%bbbbbbbbbbbb' OR ja4 IN ('odd', 'a_b_c') THEN NULL WHEN ja4 LIKE 't12%' THEN 'tool two'
    ELSE 'tool one' END AS label,
  CASE WHEN ja4 LIKE '%bbbbbbbbbbbb' OR ja4 IN ('odd', 'a_b_c') THEN NULL WHEN ja4 LIKE 'q13%' THEN 'middle_and_last'
    WHEN ja4 LIKE '%000000000000' THEN 'first_and_middle' WHEN ja4 LIKE '%000000000000_b%' THEN 'first_and_last'
    ELSE 'exact' END AS stage FROM s""")
def ja4_reputation(spark, sf):
    known = spark.createDataFrame([("ja4", v, "known_bad", label, None) for v, label in JA4_TABLE],
                                  "kind string, value string, class string, label string, source string")
    seen = events(spark, sf).select("event_id", picked(JA4_SEEN, "k % 8").alias("ja4"))
    return fp.reputations(seen, "ja4", "ja4", known).select("event_id", "ja4", "class", "label", "stage")


DHCP_SEEN = [key for key, _ in fx.DHCP] + [fx.DHCP[2][0].replace(",", " "), "28,15,6,3,1", "1,2", ""]


@query("dhcp_fingerprints", f"""WITH {E}, t(params, os) AS (VALUES {', '.join(
    f'({q(k)}, {q(v)})' for k, v in fx.DHCP)}),
c AS (SELECT DISTINCT 'mac' || user_id AS mac, '10.0.0.' || (k % 40) AS ip,
  replace([{', '.join(map(q, DHCP_SEEN))}][k % {len(DHCP_SEEN)} + 1], ' ', ',') AS params_list FROM e)
SELECT mac, ip, params_list, CASE WHEN params_list = '28,15,6,3,1' THEN {q(fx.DHCP[2][1])} ELSE os END AS likely_os,
  CASE WHEN os IS NOT NULL THEN 'exact' WHEN params_list = '28,15,6,3,1' THEN 'any_order' END AS stage
FROM c LEFT JOIN t ON params = params_list""")
def dhcp_fingerprints(spark, sf):
    leases = events(spark, sf).select(
        F.concat(F.lit("mac"), "user_id").alias("mac"), F.concat(F.lit("10.0.0."), F.expr("k % 40")).alias("ip"),
        picked(DHCP_SEEN, f"k % {len(DHCP_SEEN)}").alias("params_list"), F.col("event_type").alias("host_name"))
    return fp.dhcp_clients(leases, fp.known_fingerprints(spark)).drop("host_name")


# --- DNS ------------------------------------------------------------------------------------------------

#: Further answers: the adapter's aliases lead on over three names to an IPv6 address, and back in a loop.
STEPS = [("alias", "edge{}.example.net"), ("edge", "pool{}.example.net,alias{}.example.net"),
         ("pool", "node{}.example.net"), ("node", "198.51.100.{},2001:db8::{}")]


def step_sql(name: str, answers: str) -> str:
    number = "CAST(k % 3 AS STRING)"
    parts = answers.split("{}")
    made = ", ".join(x for i, p in enumerate(parts) for x in ([number] if i else []) + [f"'{p}'"])
    return f"SELECT concat('{name}', {number}, '.example.net') AS query, concat({made}) AS answers"


@query("dns_all_links", sql("dns", f"""WITH {E}, log AS (SELECT query, answers FROM dns UNION {' UNION '.join(
    step_sql(n, a) + ' FROM e' for n, a in STEPS)}),
a AS (SELECT DISTINCT lower(query) AS name, lower(trim(x)) AS answer FROM (
  SELECT query, unnest(string_split(answers, ',')) AS x FROM log) WHERE lower(query) <> lower(trim(x))),
w AS (SELECT name, answer, 1 AS steps FROM a WHERE NOT regexp_matches(answer, '^[0-9.]+$|:') UNION
  SELECT w.name, a.answer, steps + 1 FROM w JOIN a ON a.name = w.answer WHERE steps < 8 AND a.answer <> w.name
    AND NOT regexp_matches(a.answer, '^[0-9.]+$|:')),
p AS (SELECT name, answer AS address, 0 AS aliases FROM a WHERE regexp_matches(answer, '^[0-9.]+$|:') UNION
  SELECT w.name, a.answer, w.steps FROM w JOIN a ON a.name = w.answer WHERE regexp_matches(a.answer, '^[0-9.]+$|:')),
b AS (SELECT name, address, min(aliases) AS aliases FROM p GROUP BY ALL)
SELECT 'domain' AS ioc_type, name AS value, 'resolved_to' AS relation, address AS linked, aliases FROM b UNION ALL
SELECT CASE WHEN contains(address, ':') THEN 'ipv6' ELSE 'ipv4' END, address, 'resolved_from', name, aliases FROM b""").replace(
    "WITH ", "WITH RECURSIVE ", 1))
def dns_all_links(spark, sf):
    log = adapter(spark, sf, "dns").select("query", "answers")
    seen = events(spark, sf)
    for name, answers in STEPS:
        log = log.unionByName(seen.selectExpr(*step_sql(name, answers).removeprefix("SELECT ").replace(
            " AS query, ", " AS query|").split("|")))
    return ind.dns_links(log)


# --- usage of devices -----------------------------------------------------------------------------------

SWEEP = """SELECT app, seconds, raw_seconds, intervals FROM (
  SELECT app, sum(greatest(0, epoch(e) - epoch(greatest(s, coalesce(reached, s))))) AS seconds,
    sum(epoch(e) - epoch(s)) AS raw_seconds, count(*) AS intervals
  FROM (SELECT app, s, e, max(e) OVER (PARTITION BY app ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND
    1 PRECEDING) AS reached FROM u) GROUP BY app)"""


@query("foreground_seconds", f"""WITH {E}, u AS (SELECT event_type AS app, ts AS s, ts + to_seconds(k * 97) AS e FROM e)
SELECT app, round(seconds, 3) AS seconds, round(raw_seconds, 3) AS raw_seconds, intervals FROM ({SWEEP})""")
def foreground_seconds(spark, sf):
    used = events(spark, sf).selectExpr("event_type AS app", "ts AS start", "ts + make_dt_interval(0, 0, 0, k * 97) AS end")
    return usage.foreground_seconds(used, ["app"]).select("app", F.round("seconds", 3).alias("seconds"), F.round(
        "raw_seconds", 3).alias("raw_seconds"), "intervals")


@query("network_timeline", f"""WITH {E}, n AS (SELECT 'net' || user_id AS ssid, min(ts) AS a, min(ts) FILTER (
    event_type = 'purchase') AS u, max(ts) FILTER (event_type = 'signup') AS y FROM e GROUP BY user_id)
SELECT ts, 'dhcp_lease' AS event, CASE WHEN k % 2 = 0 THEN 'en' || (k % 3) ELSE 'net' || user_id END || ' via router '
  || md5(event_type) AS detail FROM e WHERE event_type = 'view'
UNION ALL SELECT a, 'wifi_added', ssid FROM n UNION ALL SELECT u, 'wifi_joined_by_user', ssid FROM n WHERE u IS NOT NULL
UNION ALL SELECT y, 'wifi_joined_by_system', ssid FROM n WHERE y IS NOT NULL""")
def network_timeline(spark, sf):
    seen = events(spark, sf)
    leases = seen.filter("event_type = 'view'").selectExpr(
        "CASE WHEN k % 2 = 1 THEN concat('net', user_id) END AS ssid", "concat('en', k % 3) AS interface",
        "md5(event_type) AS router_mac", "ts AS lease_start")
    networks = seen.groupBy("user_id").agg(
        F.min("ts").alias("added"), F.min(F.expr("IF(event_type = 'purchase', ts, NULL)")).alias("joined_by_user"),
        F.max(F.expr("IF(event_type = 'signup', ts, NULL)")).alias("joined_by_system")).withColumn(
        "ssid", F.concat(F.lit("net"), "user_id"))
    return usage.network_timeline(leases, networks)
