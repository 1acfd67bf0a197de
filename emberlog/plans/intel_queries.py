"""Queries over the findings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.fixed import case as fc, hypotheses as fh, techniques as ft
from emberlog.operators import intel
from emberlog.plans.adapters import adapter, sql
from emberlog.plans.registry import query


def findings(spark, sf):
    return adapter(spark, sf, "findings").withColumn(
        "facts", F.create_map(F.lit("timestamp_utc"), F.col("fact_time")))


# --- SQL building blocks (rule tables as VALUES) -----------------------------------------------

def text(s) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(text(x) for x in xs) + "]::VARCHAR[]"


RULE_ROWS = ",\n".join(
    f"({text(r['hypothesis'])}, {r['weight']}, {strings(r['words'])}, {strings(r['any_of'])}, "
    f"{strings(r['all_of'])}, {strings(r['unless'])})" for r in fh.RULES)

DELTAS = f"""rules(h, w, words, any_of, all_of, unless) AS (VALUES {RULE_ROWS}),
sig AS (SELECT *, list_concat(tags, list_transform(tools, lambda x: 'tool:' || x),
    list_transform(categories, lambda x: 'category:' || x),
    ['agent:' || agent, 'severity:' || coalesce(severity, '?')]) AS s, lower(claim) AS c
  FROM findings WHERE confidence <> 'insufficient' AND agent <> 'knowledge_lookup'),
fired AS (SELECT finding_id, case_id, host, h, w FROM sig, rules
  WHERE (len(list_filter(words, lambda x: contains(c, x))) > 0 OR list_has_any(any_of, s)
      OR (len(words) = 0 AND len(any_of) = 0))
    AND list_has_all(s, all_of) AND NOT list_has_any(unless, s)),
delta AS (SELECT finding_id, case_id, host, h, sum(w) AS d FROM fired GROUP BY ALL)"""

HYPOTHESIS_ROWS = ", ".join(f"({text(h)})" for h in fh.HYPOTHESES)
MODIFIERS = ", ".join(text(m) for m in fh.MODIFIERS)

SCORES = DELTAS + f""",
hyps(h) AS (VALUES {HYPOTHESIS_ROWS}),
cases AS (SELECT DISTINCT case_id FROM findings),
scores AS (SELECT c.case_id, hyps.h AS hypothesis, CAST(coalesce(sum(d), 0) AS BIGINT)
    AS raw_score, count(*) FILTER (d > 0) AS support, count(*) FILTER (d < 0) AS refute
  FROM cases c CROSS JOIN hyps LEFT JOIN delta ON delta.case_id = c.case_id AND delta.h = hyps.h
  GROUP BY ALL),
idx AS (SELECT case_id, sum(raw_score) AS i FROM scores WHERE hypothesis IN ({MODIFIERS})
  GROUP BY case_id),
ranked AS (SELECT case_id, hypothesis, CAST(raw_score - CASE WHEN hypothesis =
    'H_BENIGN_NO_INCIDENT' AND i > 0 THEN least(i // 2, 8) ELSE 0 END AS BIGINT) AS score,
    support, refute FROM scores JOIN idx USING (case_id)
  WHERE hypothesis NOT IN ({MODIFIERS})),
final AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, hypothesis)
  AS rank FROM ranked),
leaders AS (SELECT case_id, max(hypothesis) FILTER (rank = 1) AS leader,
  max(score) FILTER (rank = 1) AS score, max(hypothesis) FILTER (rank = 2) AS runner,
  max(score) FILTER (rank = 2) AS runner_score FROM final WHERE rank <= 2 GROUP BY case_id)"""


@query("finding_contract", sql("findings", """
SELECT finding_id, CASE WHEN trim(agent) = '' THEN 'empty agent' WHEN trim(claim) = ''
  THEN 'empty claim' WHEN confidence <> 'insufficient' AND evidence_count = 0 THEN 'no evidence'
  WHEN length(summary) > 200 THEN 'summary too long' END AS reject_reason FROM findings"""))
def finding_contract(spark, sf):
    return intel.checked_findings(findings(spark, sf)).select("finding_id", "reject_reason")


@query("hypothesis_scores", sql("findings", "WITH " + SCORES + """
SELECT case_id, hypothesis, raw_score, support, refute FROM scores"""))
def hypothesis_scores(spark, sf):
    return intel.hypothesis_scores(findings(spark, sf))


@query("hypothesis_ranking", sql("findings", "WITH " + SCORES + """
SELECT case_id, hypothesis, score, support, refute, rank FROM final"""))
def hypothesis_ranking(spark, sf):
    return intel.ranked_hypotheses(findings(spark, sf))


@query("benign_discount", sql("findings", "WITH " + DELTAS + f"""
, m AS (SELECT case_id, h, sum(d) AS s, count(*) AS n FROM delta
  WHERE h IN ({MODIFIERS}) AND d > 0 GROUP BY ALL)
SELECT case_id, CAST(sum(s) AS BIGINT) AS modifier_index, CAST(sum(n) AS BIGINT)
  AS contributions, string_agg(h, ',' ORDER BY h) AS modifiers,
  CAST(least(sum(s) // 2, 8) AS BIGINT) AS benign_discount FROM m GROUP BY case_id"""))
def benign_discount(spark, sf):
    return intel.tampering_context(findings(spark, sf))


@query("case_leaders", sql("findings", "WITH " + SCORES + """
SELECT *, score - runner_score AS gap, CASE WHEN score <= 0 THEN 'inconclusive'
  WHEN score >= 10 AND score - runner_score >= 5 THEN 'strong'
  WHEN score >= 3 AND score - runner_score >= 2 THEN 'moderate' ELSE 'preliminary' END AS strength
FROM leaders"""))
def case_leaders(spark, sf):
    return intel.leaders(findings(spark, sf))


@query("diagnostic_findings", sql("findings", "WITH " + DELTAS + """
, v AS (SELECT finding_id, case_id, CAST(max(d) - min(d) AS INT) AS spread FROM delta
  WHERE d <> 0 GROUP BY ALL),
a AS (SELECT f.case_id, f.finding_id, coalesce(spread, 0) AS spread FROM findings f
  LEFT JOIN v USING (finding_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY spread DESC, finding_id) AS rank
  FROM a)
SELECT case_id, finding_id, spread, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""))
def diagnostic_findings(spark, sf):
    return intel.diagnostic_findings(findings(spark, sf))


def _grid(by):
    cols = ", ".join(f"CAST(coalesce(sum(d) FILTER (h = {text(h)}), 0) AS BIGINT) AS {h}"
                     for h in fh.HYPOTHESES)
    return "WITH " + DELTAS + f" SELECT {by}, {cols} FROM delta WHERE d <> 0 GROUP BY {by}"


@query("score_matrix_findings", sql("findings", _grid("finding_id")))
def score_matrix_findings(spark, sf):
    return intel.score_matrix(findings(spark, sf), "finding_id")


@query("score_matrix_hosts", sql("findings", _grid("host")))
def score_matrix_hosts(spark, sf):
    return intel.score_matrix(findings(spark, sf), "host")


# --- techniques ------------------------------------------------------------------------------------

TAG_ROWS = ", ".join(f"({text(tag)}, {text(t)})" for tag, ids in ft.TAG_TECHNIQUES.items()
                     for t in ids.split())
CLAIM_ROWS = ", ".join(f"({text(p)}, {text(t)})" for p, t in ft.CLAIM_TECHNIQUES)
TECHNIQUES = f"""tagmap(tag, t) AS (VALUES {TAG_ROWS}), pat(p, t) AS (VALUES {CLAIM_ROWS}),
tf AS (
  SELECT case_id, finding_id, t AS technique FROM (SELECT case_id, finding_id, unnest(tags) AS tag
    FROM findings) JOIN tagmap USING (tag)
  UNION SELECT case_id, finding_id, t FROM findings JOIN pat ON regexp_matches(claim, p)
  UNION SELECT case_id, finding_id, 'T1218' FROM findings
    WHERE contains(notes, 'LOLBIN_CMDLINE_BENIGN_USE'))"""
TACTIC_ROWS = ", ".join(f"({text(t)}, {text(name)}, {ft.TACTICS.index(name) + 1})"
                        for t, name in ft.TECHNIQUE_TACTICS.items())
TACTIC_CTE = f"tactics(t, tactic, o) AS (VALUES {TACTIC_ROWS})"


@query("technique_map", sql("findings", "WITH " + TECHNIQUES + """
SELECT case_id, technique, count(*) AS findings, min(finding_id) AS first_finding FROM tf
GROUP BY ALL"""))
def technique_map(spark, sf):
    return intel.technique_map(findings(spark, sf))


@query("tactic_groups", sql("findings", "WITH " + TECHNIQUES + ", " + TACTIC_CTE + """
SELECT case_id, technique, count(*) AS findings, min(finding_id) AS first_finding,
  coalesce(any_value(a.tactic), any_value(b.tactic), 'Unmapped') AS tactic,
  CAST(coalesce(any_value(a.o), any_value(b.o), 13) AS INT) AS tactic_order
FROM tf LEFT JOIN tactics a ON a.t = technique
LEFT JOIN tactics b ON b.t = split_part(technique, '.', 1) GROUP BY case_id, technique"""))
def tactic_groups(spark, sf):
    return intel.tactic_groups(findings(spark, sf))


PLAYBOOK_ROWS = ", ".join(f"({text(a)}, {text(t)})" for a, ids in ft.PLAYBOOKS.items()
                          for t in ids.split())


@query("actor_playbooks", sql("findings", "WITH " + TECHNIQUES + f""",
pb(actor, t) AS (VALUES {PLAYBOOK_ROWS}),
m AS (SELECT DISTINCT case_id, actor, t FROM tf JOIN pb ON technique = t
  OR technique = split_part(t, '.', 1) OR starts_with(technique, t || '.')),
n AS (SELECT actor, count(*) AS n FROM pb GROUP BY actor)
SELECT case_id, actor, string_agg(t, ',' ORDER BY t) AS matched,
  round(count(*) / any_value(n), 6) AS coverage,
  round(count(*) / any_value(n) * sqrt(count(*)), 6) AS score
FROM m JOIN n USING (actor) GROUP BY case_id, actor
HAVING count(*) / any_value(n) >= 0.2 AND count(*) >= 2"""))
def actor_playbooks(spark, sf):
    r = intel.playbook_coverage(intel.technique_findings(findings(spark, sf)), 0.2, 2)
    return r.select("case_id", "actor", F.array_join("matched", ",").alias("matched"),
                    F.round("coverage", 6).alias("coverage"), F.round("score", 6).alias("score"))


WRITTEN = f"""tagmap(tag, t) AS (VALUES {TAG_ROWS}),
wt AS (SELECT case_id, finding_id, t AS technique FROM (SELECT case_id, finding_id, unnest(tags)
    AS tag FROM findings) JOIN tagmap USING (tag)
  UNION SELECT case_id, finding_id, unnest(regexp_extract_all(claim, '\\bT\\d{{4}}(?:\\.\\d+)?\\b'))
    FROM findings
  UNION SELECT case_id, finding_id, unnest(techniques) FROM findings)"""


@query("technique_union", sql("findings", "WITH " + WRITTEN + """
SELECT technique, count(DISTINCT case_id) AS cases, count(*) AS findings,
  min(case_id) AS first_case FROM wt WHERE technique <> '' GROUP BY technique"""))
def technique_union(spark, sf):
    return intel.technique_union(findings(spark, sf)).filter(F.col("technique") != "")


def _part_analytics(spark, sf):
    """Analytics derived from `part`: the part's size and brand pick the technique."""
    from emberlog.plans.adapters import table
    pool = F.array(*[F.lit(t) for t in ("T1055", "T1003", "T1218", "T1071", "T1999.001")])
    pick = (F.col("p_partkey") % 5 + 1).cast("int")
    return table(spark, sf, "part").select(
        F.concat(F.lit("CAR-"), "p_partkey").alias("analytic_id"),
        F.array(F.element_at(pool, pick)).alias("technique_ids"), F.col("p_name").alias("capacity"),
        F.element_at(pool, pick).alias("technique"), "p_partkey")


PART_POOL = "['T1055', 'T1003', 'T1218', 'T1071', 'T1999.001'][CAST(p_partkey % 5 + 1 AS INT)]"


@query("technique_analytics", sql("findings", "WITH " + TECHNIQUES + f""",
o AS (SELECT DISTINCT case_id, technique FROM tf),
a AS (SELECT 'CAR-' || p_partkey AS analytic_id, {PART_POOL} AS technique FROM part)
SELECT case_id, technique, count(*) AS analytics, min(analytic_id) AS first_analytic
FROM o JOIN a USING (technique) GROUP BY ALL"""))
def technique_analytics(spark, sf):
    observed = intel.technique_findings(findings(spark, sf))
    return intel.technique_analytics(observed, _part_analytics(spark, sf)).groupBy(
        "case_id", "technique").agg(F.count("*").alias("analytics"),
                                    F.min("analytic_id").alias("first_analytic"))


@query("technique_capacity", sql("findings", "WITH " + TECHNIQUES + f""",
cap AS (SELECT {PART_POOL} AS technique, min(p_name) AS capacity FROM part GROUP BY 1),
o AS (SELECT DISTINCT technique FROM tf)
SELECT o.technique, coalesce(a.capacity, b.capacity) AS capacity FROM o
LEFT JOIN cap a ON a.technique = o.technique
LEFT JOIN cap b ON b.technique = split_part(o.technique, '.', 1)"""))
def technique_capacity(spark, sf):
    table = _part_analytics(spark, sf).groupBy("technique").agg(F.min("capacity").alias("capacity"))
    observed = intel.technique_findings(findings(spark, sf)).select("technique").distinct()
    return intel.technique_capacity(observed, table)


# --- review, ratings ----------------------------------------------------------------------------------

REVIEW = """
WITH t AS (SELECT *, lower(claim) AS c FROM findings),
h AS (SELECT *, confidence = 'insufficient' AS closed,
  regexp_matches(c, 'winword[.]exe|excel[.]exe|powerpnt[.]exe|outlook[.]exe')
    AND regexp_matches(c, 'cmd[.]exe|powershell[.]exe') AS a,
  contains(c, 'malfind') AND NOT regexp_matches(c, 'credential-access target|(lsass|winlogon|services|csrss|wininit|smss)[.]exe') AS b,
  regexp_matches(c, '(rundll32|regsvr32|mshta|bitsadmin)[.]exe') AS d,
  regexp_matches(c, 'netscan|connection|tcp|udp') AS e,
  confidence = 'low' AS f,
  confidence = 'high' AND evidence_count <= 1 AND regexp_matches(c, 'attribut|identified as|indicates|fingerprint|leading hypothesis|confirms|credential-dumping|process injection|memory-region attribution') AS g
  FROM t),
r AS (SELECT *, CASE WHEN closed THEN []::VARCHAR[] ELSE list_filter([
  CASE WHEN a THEN 'OFFICE_SPAWN_SHELL_BENIGN_AUTOMATION' END,
  CASE WHEN b THEN 'MALFIND_JIT_FALSE_POSITIVE' END,
  CASE WHEN d THEN 'LOLBIN_CMDLINE_BENIGN_USE' END,
  CASE WHEN e THEN 'NETSCAN_CONNECTION_NEEDS_ENRICHMENT' END,
  CASE WHEN f THEN 'LOW_CONFIDENCE_NEEDS_CORROBORATION' END,
  CASE WHEN g THEN 'NO_EVIDENCE_NO_CLAIM' END], lambda x: x IS NOT NULL) END AS rules FROM h)
SELECT finding_id, array_to_string(rules, ',') AS review_rules, CASE WHEN closed THEN 'unresolved'
  WHEN len(rules) > 0 THEN 'challenged' WHEN evidence_count = 0 THEN 'unresolved'
  ELSE 'passed' END AS review_status FROM r"""


@query("review_challenges", sql("findings", REVIEW))
def review_challenges(spark, sf):
    return intel.reviewed(findings(spark, sf)).select(
        "finding_id", F.array_join("review_rules", ",").alias("review_rules"), "review_status")


RATING_ROWS = ", ".join(f"({text(t)}, '{r}')" for t, r in fc.TOOL_RATINGS.items())


@query("source_ratings", sql("findings", f"""
WITH ratings(t, r) AS (VALUES {RATING_ROWS}),
k AS (SELECT finding_id, regexp_replace(lower(tool), '[.]exe$', '') AS key FROM findings),
x AS (SELECT finding_id, coalesce(a.r, b.r, 'XX') AS rating FROM k
  LEFT JOIN ratings a ON a.t = split_part(key, '-', 1) AND contains(key, '-')
  LEFT JOIN ratings b ON b.t = key)
SELECT finding_id, rating, CASE WHEN rating[2:2] BETWEEN '1' AND '5' THEN rating[1:1] ||
  CAST(CAST(rating[2:2] AS INT) + 1 AS VARCHAR) ELSE rating END AS downgraded FROM x"""))
def source_ratings(spark, sf):
    rated = findings(spark, sf).withColumn("rating", intel.tool_rating(F.col("tool")))
    return rated.select("finding_id", "rating", intel.downgraded(F.col("rating")).alias(
        "downgraded"))


@query("case_best_rating", sql("findings", f"""
WITH ratings(t, r) AS (VALUES {RATING_ROWS}),
k AS (SELECT case_id, regexp_replace(lower(tool), '[.]exe$', '') AS key FROM findings),
x AS (SELECT case_id, coalesce(a.r, b.r, 'XX') AS rating FROM k
  LEFT JOIN ratings a ON a.t = split_part(key, '-', 1) AND contains(key, '-')
  LEFT JOIN ratings b ON b.t = key)
SELECT case_id, min(rating) AS best FROM x GROUP BY case_id"""))
def case_best_rating(spark, sf):
    per = findings(spark, sf).select("case_id", intel.tool_rating(F.col("tool")).alias(
        "rating")).groupBy("case_id").agg(F.collect_set("rating").alias("ratings"))
    return per.select("case_id", intel.best_rating(F.col("ratings")).alias("best"))


@query("assumptions", sql("findings", "WITH " + SCORES + f"""
SELECT case_id, kind, count(*) AS n, min(text) AS first_text, min(finding_id) AS first_finding
FROM (
  SELECT case_id, 'baseline' AS kind, a.t AS text, NULL AS finding_id FROM cases,
    (SELECT unnest({strings([a[0] for a in intel.BASELINE_ASSUMPTIONS])}) AS t) a
  UNION ALL SELECT case_id, 'leader', leader, NULL FROM leaders
  UNION ALL SELECT case_id, 'low', claim, finding_id FROM findings WHERE confidence = 'low'
  UNION ALL SELECT case_id, 'gap', claim, finding_id FROM findings
    WHERE confidence = 'insufficient'
  UNION ALL SELECT DISTINCT case_id, 'feed', 'External feeds are accurate and current.', NULL
    FROM findings WHERE agent = 'threat_feeds'
  UNION ALL SELECT DISTINCT case_id, 'heuristic',
    'Heuristic matchers classified their samples correctly.', NULL FROM findings
    WHERE tool IN ('capa', 'yara', 'sigma')) GROUP BY case_id, kind"""))
def assumptions(spark, sf):
    return intel.assumptions(findings(spark, sf)).groupBy("case_id", "kind").agg(
        F.count("*").alias("n"), F.min("text").alias("first_text"),
        F.min("finding_id").alias("first_finding"))


# --- story, timeline, hosts --------------------------------------------------------------------------------

EVIDENCE_TIME = """coalesce(TRY_CAST(fact_time AS TIMESTAMP),
  TRY_CAST(nullif(regexp_extract(claim, '\\b\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}'), '')
    AS TIMESTAMP),
  TRY_CAST(nullif(regexp_extract(claim, '\\b\\d{4}-\\d{2}-\\d{2}\\b'), '') AS TIMESTAMP))"""
TAG_BEAT_ROWS = ", ".join(f"({text(t)}, {text(b)})" for t, b in fc.TAG_BEATS.items())
TACTIC_BEATS = "CASE tactic " + " ".join(
    f"WHEN {text(t)} THEN {text(b)}" for t, b in fc.TACTIC_BEATS.items()) + " END"
AGENT_BEATS = "CASE WHEN agent = 'triage' THEN 'prologue' " + " ".join(
    f"WHEN contains(agent, {text(p)}) THEN {text(b)}" for p, b in fc.AGENT_BEATS
) + " ELSE 'execution' END"
BEAT_ORDER = "CASE beat " + " ".join(
    f"WHEN {text(b)} THEN {i}" for i, b in enumerate(fc.BEATS, 1)) + " END"


@query("story_beats", sql("findings", f"""
WITH tb(tag, b) AS (VALUES {TAG_BEAT_ROWS}), {TACTIC_CTE},
x AS (SELECT f.*, {EVIDENCE_TIME} AS et, CASE WHEN agent = 'knowledge_lookup' THEN 'prologue'
  ELSE coalesce(t1.b, t2.b, {TACTIC_BEATS}, {AGENT_BEATS}) END AS beat
  FROM findings f LEFT JOIN tb t1 ON t1.tag = tags[1] LEFT JOIN tb t2 ON t2.tag = tags[2]
  LEFT JOIN tactics ON tactics.t = techniques[1])
SELECT case_id, beat, count(*) AS findings, count(DISTINCT (agent, trim(claim))) AS bullets,
  min(et) FILTER (agent <> 'knowledge_lookup') AS earliest,
  max(et) FILTER (agent <> 'knowledge_lookup') AS latest, {BEAT_ORDER} AS beat_order
FROM x GROUP BY case_id, beat"""))
def story_beats(spark, sf):
    return intel.story_beats(findings(spark, sf))


@query("activity_thread", sql("findings", "WITH " + SCORES + ", " + TACTIC_CTE + """,
p AS (SELECT f.case_id, finding_id, confidence, o, a.tactic, list_contains(tags, leader) AS s
  FROM findings f JOIN tactics a ON a.t = techniques[1] JOIN leaders USING (case_id)),
g AS (SELECT case_id, bool_or(s) AS found FROM p GROUP BY case_id)
SELECT case_id, finding_id, CAST(o AS INT) AS phase_order, tactic AS phase, NOT found AS widened,
  CASE WHEN confidence = 'insufficient' THEN 'Hypothesis' ELSE 'Actual' END AS status
FROM p JOIN g USING (case_id) WHERE s OR NOT found"""))
def activity_thread(spark, sf):
    return intel.activity_thread(findings(spark, sf))


@query("event_timeline", sql("findings", f"""
SELECT {EVIDENCE_TIME} AS ts, case_id, host, finding_id, agent, confidence FROM findings
WHERE agent <> 'knowledge_lookup' AND confidence <> 'insufficient'
  AND {EVIDENCE_TIME} IS NOT NULL"""))
def event_timeline(spark, sf):
    return intel.event_timeline(findings(spark, sf))


@query("processing_timeline", sql("findings", """
SELECT created AS ts, case_id, host, finding_id, agent, confidence FROM findings"""))
def processing_timeline(spark, sf):
    return intel.event_timeline(findings(spark, sf), "processing")


SIGNAL_ROWS = ", ".join(f"({text(n)}, {text(w)})" for n, ws in fc.CLAIM_SIGNALS for w in ws)


@query("signal_hits", sql("findings", f"""
WITH s(signal, w) AS (VALUES {SIGNAL_ROWS}),
h AS (SELECT DISTINCT finding_id, host, signal FROM findings JOIN s ON contains(lower(claim), w))
SELECT signal, host, count(*) AS hits FROM h GROUP BY ALL"""))
def signal_hits(spark, sf):
    return intel.signal_hits(findings(spark, sf))


HOSTS = [f"host{i}" for i in range(8)]


@query("signal_matrix", sql("findings", f"""
WITH s(signal, w) AS (VALUES {SIGNAL_ROWS}),
h AS (SELECT DISTINCT finding_id, host, signal FROM findings JOIN s ON contains(lower(claim), w))
SELECT signal, {", ".join(f"count(*) FILTER (host = '{h}') AS {h}" for h in HOSTS)}
FROM h GROUP BY signal"""))
def signal_matrix(spark, sf):
    return intel.signal_matrix(findings(spark, sf), HOSTS)


@query("evidence_divergence", sql("findings", "WITH " + SCORES + """,
hc AS (SELECT case_id, min(host) AS host FROM findings GROUP BY case_id),
d AS (SELECT host, count(*) AS cases, count(DISTINCT leader) AS leaders, max(score) AS max_score,
  min(score) AS min_score, max(score) - min(score) AS span FROM leaders JOIN hc USING (case_id)
  GROUP BY host)
SELECT * FROM d WHERE cases >= 2 AND NOT (max_score = 0 AND min_score = 0)
  AND (leaders > 1 OR span >= 15)"""))
def evidence_divergence(spark, sf):
    return intel.evidence_divergence(findings(spark, sf))


CLOCKS = """SELECT concat('host', CAST(c_custkey % 40 AS STRING)) AS host, c_custkey AS observed,
  CASE WHEN c_custkey % 3 = 0 THEN CASE c_nationkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN 'EST'
    ELSE 'JST' END END AS tz_name,
  CASE WHEN c_custkey % 3 = 0 THEN CASE c_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 300
    ELSE -540 END END AS bias_minutes,
  CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_nationkey % 4 = 0 THEN 'NoSync' ELSE 'NT5DS' END
    END AS sync_mode,
  CASE WHEN c_custkey % 7 = 0 THEN concat('ntp', CAST(c_nationkey % 2 AS STRING)) END AS ntp_peer,
  CASE WHEN c_custkey % 11 = 0 THEN CAST(c_nationkey * 7 AS BIGINT) END AS skew_seconds
FROM {customer}"""


def clock_facts(spark, sf):
    from emberlog.plans.adapters import table
    return spark.sql(CLOCKS, customer=table(spark, sf, "customer"))


CLOCK_SQL = f"""WITH f AS ({CLOCKS.format(customer='customer')}),
c AS (SELECT host, arg_max(tz_name, observed) FILTER (tz_name IS NOT NULL) AS tz_name,
  arg_max(bias_minutes, observed) FILTER (bias_minutes IS NOT NULL) AS bias_minutes,
  upper(arg_max(sync_mode, observed) FILTER (sync_mode IS NOT NULL)) AS sync_mode,
  arg_max(ntp_peer, observed) FILTER (ntp_peer IS NOT NULL) AS ntp_peer,
  arg_max(skew_seconds, observed) FILTER (skew_seconds IS NOT NULL) AS skew_seconds
  FROM f GROUP BY host)"""


@query("clock_baselines", CLOCK_SQL + """
SELECT *, CASE bias_minutes WHEN 0 THEN 'UTC+00:00' WHEN 300 THEN 'UTC-05:00'
  WHEN -540 THEN 'UTC+09:00' END AS utc_offset,
  tz_name IS NULL AND skew_seconds IS NULL AS missing FROM c""")
def clock_baselines(spark, sf):
    return intel.clock_baselines(clock_facts(spark, sf))


@query("clock_alerts", CLOCK_SQL + """,
a AS (SELECT count(DISTINCT tz_name) AS time_zones, count(DISTINCT sync_mode) AS sync_modes,
  count(DISTINCT ntp_peer) AS ntp_peers, count(*) FILTER (sync_mode = 'NOSYNC')
    AS unsynced_hosts, count(*) FILTER (tz_name IS NULL AND skew_seconds IS NULL) AS missing_hosts,
  max(abs(skew_seconds)) AS max_skew FROM c)
SELECT *, time_zones > 1 AS tz_split, sync_modes > 1 AND unsynced_hosts = 0 AS sync_split,
  ntp_peers > 1 AS peer_split FROM a""")
def clock_alerts(spark, sf):
    return intel.clock_alerts(clock_facts(spark, sf))


@query("bundle_leaders", sql("findings", "WITH b AS (SELECT * REPLACE ('bundle' AS case_id) "
       "FROM findings), " + SCORES.replace("FROM findings", "FROM b") + """
SELECT case_id, leader, score, runner, runner_score FROM leaders"""))
def bundle_leaders(spark, sf):
    merged = intel.bundle_union(findings(spark, sf), F.lit("bundle"))
    return intel.leaders(merged).drop("gap", "strength")


@query("device_leaders", sql("findings", "WITH b AS (SELECT * REPLACE (host AS case_id) "
       "FROM findings), " + SCORES.replace("FROM findings", "FROM b") + """
SELECT case_id AS device, leader, score FROM leaders"""))
def device_leaders(spark, sf):
    merged = intel.bundle_union(findings(spark, sf), F.lit("bundle"))
    return intel.leaders(merged, ("device",)).select("device", "leader", "score")
