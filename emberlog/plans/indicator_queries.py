"""Queries over indicators in documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.fixed import indicators as fx
from emberlog.operators import indicators as ind, intel
from emberlog.plans.adapters import adapter, sql, table
from emberlog.plans.registry import query


def document_iocs(spark, sf, keep=("doc_id", "case_id", "observed")):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("case_id"), F.col("doc_id").alias("observed"), "text")
    return ind.extract_indicators(docs, keep=list(keep))


def page_iocs(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page"), F.col("page_id") % 7).alias("case_id"),
        F.col("page_id").alias("observed"), F.concat_ws(" ", "url", "html").alias("text"))
    return ind.extract_indicators(pages, keep=["case_id", "observed"])


# --- SQL form: tokens bounded by lookarounds are whole runs of their character class ------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def runs(cls: str, full: str) -> str:
    return (f"list_filter(regexp_extract_all(t, {q(cls)}), "
            f"lambda x: regexp_full_match(x, {q(full)}))")


def hexes(n: int, least: int) -> str:
    return (f"list_filter(list_transform(list_filter(regexp_extract_all(t, '[A-Fa-f0-9]+'), "
            f"lambda x: length(x) = {n}), lambda x: lower(x)), lambda x: "
            f"len(list_distinct(string_split(x, ''))) >= {least})")


DOMAINS_FOUND = (r"list_filter(list_transform(regexp_extract_all(t, '[\p{L}\p{N}_.-]+'), "
                 r"lambda x: regexp_extract(x, " + q("^(" + fx.DOMAIN + r")(?:\.|$)")
                 + ", 1)), lambda x: x <> '')")


def lst(xs) -> str:
    return ", ".join(q(x) for x in xs)


REPEATS = "|".join(c * 4 if c != "-" else "----" for c in "abcdefghijklmnopqrstuvwxyz0123456789-")


def domain_ok(d: str) -> str:
    last = f"regexp_extract({d}, '([^.]*)$', 1)"
    noise = "|".join(n.replace(".", "[.]") for n in fx.NOISE_DOMAINS)
    prefixes = "|".join(p.replace(".", "[.]") for p in fx.NOISE_PREFIXES)
    return (f"(contains({d}, '.') AND NOT regexp_full_match({last}, '[0-9]+') "
            f"AND {last} NOT IN ({lst(fx.FILE_EXTENSIONS)}) "
            f"AND (regexp_full_match({last}, '[a-z]{{2,63}}|xn--[a-z0-9-]{{1,59}}') "
            f"OR {last} IN ({lst(fx.INTERNAL_TLDS)})) "
            f"AND NOT regexp_matches({d}, '(^|[.])({noise})$') AND {d} NOT IN ({lst(fx.OID_NAMES)}) "
            f"AND NOT regexp_matches({d}, '^({prefixes})') "
            f"AND NOT regexp_matches({d}, '^({'|'.join(fx.SYSTEM_NAME_PREFIXES)})') "
            f"AND NOT (regexp_matches({d}, '^[0-9]{{1,3}}[.]') AND contains({last}, 'x')) "
            f"AND len(list_filter(string_split({d}, '.'), lambda l: length(l) >= 3 "
            f"AND NOT regexp_full_match(l, '[0-9]+'))) > 0 "
            f"AND NOT regexp_matches({d}, '{REPEATS}'))")


REFANG = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
          "regexp_replace({t}, '\\[\\.\\]', '.', 'g'), '\\(\\.\\)', '.', 'g'), "
          "'\\[dot\\]', '.', 'gi'), '\\[at\\]', '@', 'gi'), '\\[:\\]', ':', 'g'), "
          "'hxxp(s?)://', 'http\\1://', 'gi')")


def ioc_cte(name: str, base: str, keep: str, text: str) -> str:
    """A CTE `name` with the kept columns, ioc_type and value, one row per row and indicator."""
    types = {
        "ipv4": f"list_filter({runs('[0-9.]+', fx.IPV4)}, lambda x: NOT regexp_matches(x, "
                f"{q(fx.PRIVATE_PREFIX)}) AND NOT regexp_full_match(x, '[0-9]+[.]0[.]0[.]0'))",
        "ipv6": "list_filter(" + runs(r"[\p{L}\p{N}_:]+", fx.IPV6) + ", lambda x: length(x) > 4)",
        "domain": f"list_filter(list_transform({DOMAINS_FOUND}, lambda x: lower(x)), "
                  f"lambda d: {domain_ok('d')})",
        "url": f"list_filter(regexp_extract_all(t, {q(fx.URL)}), lambda u: "
               f"{domain_ok('lower(string_split(u, chr(47))[3])')})",
        "md5": hexes(32, 8), "sha1": hexes(40, 10),
        "sha256": f"list_filter({hexes(64, 12)}, lambda x: x NOT IN ({lst(fx.CURVE_CONSTANTS)}))",
        "email": f"regexp_extract_all(t, {q(fx.EMAIL)})",
        "regkey": f"list_transform(regexp_extract_all(t, {q(fx.REGISTRY_KEY)}), "
                  "lambda x: rtrim(x, chr(92)))",
        "winpath": f"regexp_extract_all(t, {q(fx.WINDOWS_PATH)})",
        "btc": "list_concat(list_filter(" + runs("[A-Za-z0-9]+", fx.BTC_LEGACY)
               + ", lambda a: regexp_matches(a[2:], '[0-9]') AND regexp_matches(a[2:], '[A-Z]') "
               "AND regexp_matches(a[2:], '[a-z]') AND len(list_distinct(string_split(lower(a), "
               "''))) >= 12), list_filter(" + runs("[a-z0-9]+", fx.BTC_BECH32)
               + ", lambda a: len(list_distinct(string_split(a, ''))) >= 12))",
        "aws_access_key": runs("[A-Z0-9]+", fx.AWS_KEY_ID),
        "aws_secret_key": f"regexp_extract_all(t, {q(fx.AWS_SECRET + '(?:[^A-Za-z0-9/+=]|$)')}, 1)",
    }
    parts = " UNION ALL ".join(
        f"SELECT {keep}, '{k}' AS ioc_type, unnest(list_distinct({e})) AS value FROM {name}_t"
        for k, e in types.items())
    return (f"{name}_t AS (SELECT {keep}, {REFANG.format(t=text)} AS t FROM {base}), "
            f"{name} AS ({parts})")


DOC_IOCS = ioc_cte("docs", "(SELECT doc_id, source AS case_id, doc_id AS observed, text "
                   "FROM documents)", "doc_id, case_id, observed", "text")
PAGE_IOCS = ioc_cte("pgs", "(SELECT 'page' || (page_id % 7) AS case_id, page_id AS observed, "
                    "url || ' ' || html AS text FROM pages)", "case_id, observed", "text")


@query("ioc_extract_documents", f"WITH {DOC_IOCS} SELECT doc_id, ioc_type, value FROM docs")
def ioc_extract_documents(spark, sf):
    return document_iocs(spark, sf).select("doc_id", "ioc_type", "value")


@query("ioc_extract_pages", f"WITH {PAGE_IOCS} SELECT observed, ioc_type, value FROM pgs")
def ioc_extract_pages(spark, sf):
    return page_iocs(spark, sf).select("observed", "ioc_type", "value")


@query("ioc_path_listing", f"WITH {DOC_IOCS} SELECT doc_id, ioc_type, value FROM docs "
       "WHERE ioc_type IN ('ipv4', 'ipv6', 'md5', 'sha1', 'sha256', 'regkey', 'winpath')")
def ioc_path_listing(spark, sf):
    return ind.extract_indicators(table(spark, sf, "documents"), keep=["doc_id"],
                                  path_listing=True)


@query("ioc_raw_domains", f"""WITH d AS (SELECT doc_id, {REFANG.format(t='text')} AS t
FROM documents) SELECT doc_id, unnest(list_distinct({DOMAINS_FOUND})) AS value FROM d""")
def ioc_raw_domains(spark, sf):
    return ind.extract_indicators(table(spark, sf, "documents"), keep=["doc_id"],
                                  drop_noise=False).filter(F.col("ioc_type") == "domain").select(
        "doc_id", "value")


@query("ioc_extras")
def ioc_extras(spark, sf):
    return ind.extract_more(table(spark, sf, "documents"), keep=["doc_id"])


RANKS = "SELECT domain, min(p) AS rank FROM (SELECT regexp_extract(url, " \
        "'^https?://([^/]+)', 1) AS domain, page_id * 1000 AS p FROM pages) GROUP BY domain"


def page_ranks(spark, sf):
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("domain"),
        (F.col("page_id") * 1000).alias("p")).groupBy("domain").agg(F.min("p").alias("rank"))


@query("ioc_popularity_filter", f"""WITH {PAGE_IOCS}, r AS ({RANKS}),
h AS (SELECT *, CASE ioc_type WHEN 'domain' THEN value WHEN 'url' THEN
  lower(regexp_extract(value, '^(?:[^:/]*://)?([^/?]*)', 1)) END AS host FROM pgs)
SELECT observed, ioc_type, value FROM h WHERE NOT EXISTS (SELECT 1 FROM r
  WHERE r.domain = h.host AND r.rank <= 50000)""")
def ioc_popularity_filter(spark, sf):
    return ind.drop_popular(page_iocs(spark, sf), page_ranks(spark, sf)).select(
        "observed", "ioc_type", "value")


@query("ioc_union", f"""WITH {DOC_IOCS}, {PAGE_IOCS}
SELECT case_id, ioc_type, value FROM docs UNION SELECT case_id, ioc_type, value FROM pgs""")
def ioc_union(spark, sf):
    return ind.union_indicators([document_iocs(spark, sf).drop("doc_id"), page_iocs(spark, sf)])


@query("ioc_fact_addresses", sql("flows", """
SELECT DISTINCT flow_id, src AS value, 'ipv4' AS ioc_type FROM flows
UNION SELECT DISTINCT flow_id, dst, 'ipv4' FROM flows"""))
def ioc_fact_addresses(spark, sf):
    facts = adapter(spark, sf, "flows").withColumn("facts", F.create_map(
        F.lit("source_ip"), F.col("src"), F.lit("remote_host"),
        F.concat(F.col("dst"), F.lit(" (x3)"))))
    return ind.fact_addresses(facts, keep=["flow_id"]).distinct()


@query("ioc_registry_new", f"""WITH {DOC_IOCS}, {PAGE_IOCS}
SELECT ioc_type, count(*) AS new_rows FROM (
  SELECT DISTINCT ioc_type, value, case_id FROM docs WHERE NOT EXISTS (SELECT 1 FROM pgs
    WHERE pgs.ioc_type = docs.ioc_type AND pgs.value = docs.value AND
      pgs.case_id = 'page' || (doc_id % 7))) GROUP BY ioc_type""")
def ioc_registry_new(spark, sf):
    observed = document_iocs(spark, sf)
    registry = page_iocs(spark, sf)
    keyed = observed.withColumn("page_case", F.concat(F.lit("page"), F.col("doc_id") % 7))
    known = registry.select("ioc_type", "value", F.col("case_id").alias("page_case")).distinct()
    fresh = keyed.join(known, ["ioc_type", "value", "page_case"], "left_anti")
    return ind.unseen(fresh.select("ioc_type", "value", "case_id"),
                      registry.select("ioc_type", "value", "case_id"),
                      ["ioc_type", "value", "case_id"]).groupBy("ioc_type").agg(
        F.count("*").alias("new_rows"))


@query("digest_registry_new", """
WITH d AS (SELECT source AS case_id, sha256(text) AS sha256, doc_id FROM documents)
SELECT case_id, sha256 FROM (SELECT DISTINCT case_id, sha256 FROM d) x
WHERE NOT EXISTS (SELECT 1 FROM (SELECT source AS case_id, sha256(text) AS sha256 FROM documents
  JOIN labels USING (doc_id)) r WHERE r.case_id = x.case_id AND r.sha256 = x.sha256)""")
def digest_registry_new(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("case_id"), F.sha2("text", 256).alias("sha256"), "doc_id")
    known = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return ind.unseen(docs, known, ["case_id", "sha256"]).select("case_id", "sha256")


RARITY = """p AS (SELECT DISTINCT ioc_type, value, case_id FROM docs),
s AS (SELECT ioc_type, value, count(*) - 1 AS prior FROM p GROUP BY ALL)"""
BUCKET = """CASE WHEN {p} <= 2 THEN 'rare' WHEN {p} <= 10 THEN 'uncommon' WHEN {p} <= 50
  THEN 'common' ELSE 'ubiquitous' END"""


@query("ioc_rarity", f"""WITH {DOC_IOCS}, {RARITY}
SELECT p.*, prior AS prior_cases, {BUCKET.format(p='prior')} AS bucket,
  CASE WHEN prior <= 2 THEN 'high' WHEN prior <= 10 THEN 'medium' WHEN prior <= 50 THEN 'low'
  ELSE 'insufficient' END AS confidence, prior > 50 AS suppressed
FROM p JOIN s USING (ioc_type, value)""")
def ioc_rarity(spark, sf):
    return intel.indicator_rarity(document_iocs(spark, sf))


@query("ioc_overlap", f"""WITH {DOC_IOCS}, {RARITY}
SELECT ioc_type, value, count(*) AS cases, min(case_id) AS first_case FROM p GROUP BY ALL
HAVING count(*) >= 2 ORDER BY cases DESC, ioc_type, value""")
def ioc_overlap(spark, sf):
    return intel.indicator_overlap(document_iocs(spark, sf))


@query("ioc_cross_case", f"""WITH {DOC_IOCS}, {RARITY},
t AS (SELECT ioc_type, value, count(DISTINCT case_id) AS cases,
  count(DISTINCT case_id) FILTER (case_id LIKE 'feed:%') AS feeds, min(observed) AS first_seen
  FROM (SELECT ioc_type, value, observed, CASE WHEN case_id IN ('src1', 'src2')
    THEN 'feed:' || case_id ELSE case_id END AS case_id FROM docs) GROUP BY ALL),
m AS (SELECT DISTINCT CASE WHEN case_id IN ('src1', 'src2') THEN 'feed:' || case_id
  ELSE case_id END AS case_id, ioc_type, value FROM docs)
SELECT case_id, ioc_type, value, cases - 1 AS prior_cases, feeds, first_seen,
  {BUCKET.format(p='(cases - 1)')} AS bucket,
  CASE WHEN feeds = cases - 1 THEN 'feed' ELSE 'case' END AS origin
FROM m JOIN t USING (ioc_type, value) WHERE cases > 1 AND cases <= 51""")
def ioc_cross_case(spark, sf):
    iocs = document_iocs(spark, sf).withColumn("case_id", F.when(
        F.col("case_id").isin("src1", "src2"), F.concat(F.lit("feed:"), "case_id")).otherwise(
        F.col("case_id")))
    return ind.cross_case_overlap(iocs, iocs)


PAIRS = """pairs AS (SELECT DISTINCT lower(query) AS domain, trim(a) AS ip FROM (
  SELECT query, unnest(string_split(answers, ',')) AS a FROM dns)
  WHERE regexp_full_match(trim(a), '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'))"""


@query("dns_resolved_pairs", sql("dns", f"WITH {PAIRS} SELECT domain, ip FROM pairs"))
def dns_resolved_pairs(spark, sf):
    return ind.resolved_pairs(adapter(spark, sf, "dns"))


@query("ioc_dns_enrichment", sql("dns", f"""WITH {PAIRS}, {PAGE_IOCS},
i AS (SELECT DISTINCT ioc_type, value FROM pgs WHERE ioc_type IN ('domain', 'ipv4')
  UNION SELECT 'ipv4', ip FROM pairs),
l AS (SELECT 'ipv4' AS ioc_type, ip AS value, count(*) AS linked, min(domain) AS first_link
  FROM pairs GROUP BY ip UNION ALL SELECT 'domain', domain, count(*), min(ip) FROM pairs
  GROUP BY domain)
SELECT i.*, linked, first_link, CASE WHEN linked IS NOT NULL THEN CASE ioc_type WHEN 'ipv4'
  THEN 'resolved_from' ELSE 'resolved_to' END END AS relation
FROM i LEFT JOIN l USING (ioc_type, value)"""))
def ioc_dns_enrichment(spark, sf):
    dns = adapter(spark, sf, "dns")
    found = page_iocs(spark, sf).filter(F.col("ioc_type").isin("domain", "ipv4")).select(
        "ioc_type", "value")
    ips = ind.resolved_pairs(dns).select(F.lit("ipv4").alias("ioc_type"), F.col("ip").alias(
        "value"))
    return ind.enrich_with_dns(found.union(ips).distinct(), dns)
