"""Case-level analytics over findings: scoring, techniques, reviews, timelines and matrices.

Finding columns: finding_id, case_id, host, agent, claim, confidence, tags, tools, categories,
severity, techniques, evidence_count, facts (map), notes, created.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberlog import functions as fn
from emberlog.fixed import case as fc, hypotheses as fh, techniques as ft
from emberlog.operators.common import explode_rows

RULE_TYPE = ("array<struct<hypothesis:string,weight:int,words:array<string>,any_of:array<string>,"
             "all_of:array<string>,unless:array<string>>>")


def literal(value, ddl: str) -> Column:
    """A nested constant built from literals, which Catalyst folds into one (parsed JSON it keeps)."""
    def text(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, list):
            return "array(" + ", ".join(text(x) for x in v) + ")"
        pairs = ", ".join(f"{text(k)}, {text(x)}" for k, x in v.items())
        return f"{'map' if is_map(v) else 'named_struct'}({pairs})"

    def is_map(v) -> bool:
        return ddl.startswith("map<") and v is value
    return F.expr(f"CAST({text(value)} AS {ddl})")


def lookup(table: dict, key: Column) -> Column:
    """Value of a constant map; null when the key is absent."""
    return F.try_element_at(
        F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _lists(table: dict, ddl: str = "map<string,array<string>>") -> Column:
    return literal({k: v.split() for k, v in table.items()}, ddl)


# --- contract -------------------------------------------------------------------------------

def checked_findings(findings: DataFrame, summary_limit: int = 200) -> DataFrame:
    """Findings with the reason they are rejected, null for valid ones."""
    def blank(c):
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = fn.first_match([
        (blank("agent"), "empty agent"), (blank("claim"), "empty claim"),
        (blank("case_id"), "empty case_id"),
        ((F.col("confidence") != "insufficient") & (F.col("evidence_count") == 0),
         "no evidence"),
        (F.length("summary") > summary_limit, "summary too long")])
    return findings.withColumn("reject_reason", reason)


# --- hypothesis scores -------------------------------------------------------------------------

def signals(findings: DataFrame) -> DataFrame:
    """Adds the list of signals the scoring rules test."""
    def tagged(prefix, c):
        return F.transform(F.coalesce(c, F.array().cast("array<string>")),
                           lambda x: F.concat(F.lit(prefix), x))
    one = F.filter(F.array(F.concat(F.lit("agent:"), "agent"),
                           F.concat(F.lit("severity:"), "severity")), lambda x: x.isNotNull())
    return findings.withColumn("signals", F.concat(
        F.coalesce("tags", F.array().cast("array<string>")), tagged("tool:", F.col("tools")),
        tagged("category:", F.col("categories")), one)).withColumn(
        "_claim", F.lower(F.coalesce("claim", F.lit(""))))


def _fired(row: Column) -> Column:
    """Rules that fire: by words of the claim, or found under a signal, then checked in full."""
    by_signal: dict[str, list] = {}
    for rule in fh.RULES:
        for key in rule["any_of"] or ([] if rule["words"] else rule["all_of"][:1]):
            by_signal.setdefault(key, []).append(rule)
    by_words = literal([r for r in fh.RULES if r["words"]], RULE_TYPE)
    index = literal(by_signal, f"map<string,{RULE_TYPE}>")
    none = F.array().cast(RULE_TYPE)
    candidates = F.array_distinct(F.concat(
        F.filter(by_words, lambda r: F.exists(r["words"], lambda w: row["claim"].contains(w))),
        F.flatten(F.transform(row["signals"], lambda s: F.coalesce(
            F.try_element_at(index, s), none)))))
    return F.filter(candidates, lambda r: (F.size(F.array_except(
        r["all_of"], row["signals"])) == 0) & ~F.arrays_overlap(r["unless"], row["signals"]))


def finding_deltas(findings: DataFrame) -> DataFrame:
    """Score of every hypothesis for every finding (row-local; one row per finding).

    Insufficient findings and look-ups of other cases score nothing. `let` binds the claim and the
    fired rules once per row; a plain column would be computed again for every rule.
    """
    names = literal(list(fh.HYPOTHESES), "array<string>")
    scored = (F.col("confidence") != "insufficient") & (F.col("agent") != fh.UNSCORED_AGENT)

    def totals(fired):
        return F.transform(names, lambda h: F.struct(
            h.alias("hypothesis"),
            F.aggregate(F.filter(fired, lambda r: r["hypothesis"] == h), F.lit(0),
                        lambda acc, r: acc + r["weight"]).alias("delta")))

    def of_row(row):
        return fn.let(F.when(row["scored"], _fired(row)).otherwise(
            F.array().cast(RULE_TYPE)), totals)

    row = F.struct(F.col("_claim").alias("claim"), F.col("signals").alias("signals"),
                   scored.alias("scored"))
    return signals(findings).withColumn("deltas", fn.let(row, of_row)).drop("signals", "_claim")


def hypothesis_scores(findings: DataFrame, by=("case_id",)) -> DataFrame:
    """Raw score, supporting and refuting findings per case and hypothesis (all 33 rows)."""
    cells = explode_rows(finding_deltas(findings), F.col("deltas"), "d", *by)
    return cells.groupBy(*by, F.col("d.hypothesis").alias("hypothesis")).agg(
        F.sum("d.delta").cast("bigint").alias("raw_score"),
        F.count_if(F.col("d.delta") > 0).alias("support"),
        F.count_if(F.col("d.delta") < 0).alias("refute"))


def ranked_hypotheses(findings: DataFrame, by=("case_id",)) -> DataFrame:
    """Ranking of the competing hypotheses; modifiers only discount the benign one."""
    scores = hypothesis_scores(findings, by)
    modifier = F.col("hypothesis").isin(fh.MODIFIERS)
    index = F.sum(F.when(modifier, F.col("raw_score")).otherwise(0)).over(W.partitionBy(*by))
    discount = F.when(F.col("modifier_index") > 0, F.least(
        F.floor(F.col("modifier_index") / 2), F.lit(fh.BENIGN_DISCOUNT_CAP))).otherwise(0)
    final = scores.withColumn("modifier_index", index).withColumn(
        "score", (F.col("raw_score") - F.when(F.col("hypothesis") == fh.BENIGN, discount)
                  .otherwise(0)).cast("bigint"))
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc("hypothesis"))
    return final.filter(~modifier).withColumn("rank", F.row_number().over(order)).select(
        *by, "hypothesis", "score", "support", "refute", "rank")


def tampering_context(findings: DataFrame) -> DataFrame:
    """Per case: modifier index, discount of the benign hypothesis and contributing modifiers."""
    cells = explode_rows(finding_deltas(findings), F.col("deltas"), "d", "case_id").filter(
        F.col("d.hypothesis").isin(fh.MODIFIERS) & (F.col("d.delta") > 0))
    per = cells.groupBy("case_id", F.col("d.hypothesis").alias("h")).agg(
        F.sum("d.delta").alias("s"), F.count("*").alias("n"))
    return per.groupBy("case_id").agg(
        F.sum("s").alias("modifier_index"), F.sum("n").alias("contributions"),
        F.array_join(F.sort_array(F.collect_list("h")), ",").alias("modifiers")).withColumn(
        "benign_discount", F.least(F.floor(F.col("modifier_index") / 2),
                                   F.lit(fh.BENIGN_DISCOUNT_CAP)).cast("bigint"))


def leaders(findings: DataFrame, by=("case_id",)) -> DataFrame:
    """Leading and second hypothesis per case with the phrase that describes the margin."""
    top = ranked_hypotheses(findings, by).filter(F.col("rank") <= 2).groupBy(*by).agg(
        F.max(F.when(F.col("rank") == 1, F.col("hypothesis"))).alias("leader"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("hypothesis"))).alias("runner"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("runner_score"))
    gap = F.col("score") - F.col("runner_score")
    strength = (F.when(F.col("score") <= 0, "inconclusive")
                .when((F.col("score") >= 10) & (gap >= 5), "strong")
                .when((F.col("score") >= 3) & (gap >= 2), "moderate").otherwise("preliminary"))
    return top.withColumn("gap", gap).withColumn("strength", strength)


def diagnostic_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """Findings whose non-zero scores spread widest, per case."""
    deltas = F.filter(F.transform("deltas", lambda d: d["delta"]), lambda x: x != 0)
    spread = F.coalesce(F.array_max(deltas) - F.array_min(deltas), F.lit(0))
    rows = finding_deltas(findings).select("case_id", "finding_id", spread.alias("spread"))
    w = W.partitionBy("case_id").orderBy(F.desc("spread"), F.asc("finding_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def score_matrix(findings: DataFrame, by: str = "finding_id") -> DataFrame:
    """Grid of scores: one column per hypothesis, rows without any score dropped."""
    cells = explode_rows(finding_deltas(findings), F.col("deltas"), "d", by).select(
        by, "d.hypothesis", "d.delta").filter(F.col("delta") != 0)
    grid = cells.groupBy(by).pivot("hypothesis", list(fh.HYPOTHESES)).agg(F.sum("delta"))
    return grid.na.fill(0)


# --- techniques ------------------------------------------------------------------------------------

def with_technique_ids(findings: DataFrame) -> DataFrame:
    """Adds the techniques a finding implies through review notes, tags and words of the claim."""
    none = F.array().cast("array<string>")
    by_tag = F.flatten(F.transform(F.coalesce("tags", none), lambda t: F.coalesce(
        F.try_element_at(_lists(ft.TAG_TECHNIQUES), t), none)))
    notes = F.coalesce("notes", F.lit(""))
    by_rule = [F.when(notes.contains(rule), F.split(F.lit(ids), " ")).otherwise(none)
               for rule, ids in ft.RULE_TECHNIQUES.items()]
    claim = F.coalesce("claim", F.lit(""))
    by_claim = F.filter(F.array(*[F.when(claim.rlike(p), t) for p, t in ft.CLAIM_TECHNIQUES]),
                        lambda x: x.isNotNull())
    return findings.withColumn("technique_ids", F.array_distinct(
        F.concat(*by_rule, by_tag, by_claim)))


def technique_findings(findings: DataFrame) -> DataFrame:
    """One row per case, technique and finding."""
    return explode_rows(with_technique_ids(findings), F.col("technique_ids"), "technique",
                        "case_id", "finding_id")


def technique_map(findings: DataFrame) -> DataFrame:
    """Techniques of each case with their finding count and first finding."""
    return technique_findings(findings).groupBy("case_id", "technique").agg(
        F.count("*").alias("findings"), F.min("finding_id").alias("first_finding"))


def parent_technique(t: Column) -> Column:
    return F.substring_index(t, ".", 1)


def tactic(technique: Column) -> Column:
    """Primary tactic, of the parent when the sub-technique is not listed; else null."""
    table = ft.TECHNIQUE_TACTICS
    t = F.trim(technique)
    mapping = literal(table, "map<string,string>")
    return F.coalesce(F.try_element_at(mapping, t),
                      F.try_element_at(mapping, parent_technique(t)))


def tactic_order(name: Column) -> Column:
    pos = F.array_position(F.array(*[F.lit(t) for t in ft.TACTICS]), name)
    return F.when(pos > 0, pos).otherwise(len(ft.TACTICS) + 1).cast("int")


def tactic_groups(findings: DataFrame) -> DataFrame:
    """Techniques of each case by tactic, in tactic order; unlisted ones come last."""
    name = F.coalesce(tactic(F.col("technique")), F.lit("Unmapped"))
    return technique_map(findings).withColumn("tactic", name).withColumn(
        "tactic_order", tactic_order(F.col("tactic")))


def playbook_coverage(observed: DataFrame, min_coverage: float = 0.0,
                      min_matched: int = 1) -> DataFrame:
    """Share of each actor's techniques seen in a case (columns case_id, technique).

    A parent counts for its sub-technique and the other way round. Every observed technique looks
    its playbook entries up in a constant map, so no join with the playbooks is needed.
    """
    exact: dict[str, list] = {}
    for actor, ids in ft.PLAYBOOKS.items():
        for t in ids.split():
            for key in {t, t.split(".")[0]}:
                exact.setdefault("is:" + key, []).append({"actor": actor, "technique": t})
            exact.setdefault("under:" + t, []).append({"actor": actor, "technique": t})
    table = literal(exact, "map<string,array<struct<actor:string,technique:string>>>")
    none = F.array().cast("array<struct<actor:string,technique:string>>")
    t = F.regexp_replace(F.trim("technique"), "^t", "T")
    sub = F.when(t.contains("."), F.concat(F.lit("under:"), parent_technique(t)))
    hits = F.concat(F.coalesce(F.try_element_at(table, F.concat(F.lit("is:"), t)), none),
                    F.coalesce(F.try_element_at(table, sub), none))
    matched = explode_rows(observed, hits, "m", "case_id").select(
        "case_id", "m.actor", "m.technique").distinct()
    full = _lists(ft.PLAYBOOKS)
    per = matched.groupBy("case_id", "actor").agg(
        F.sort_array(F.collect_set("technique")).alias("matched"))
    want = F.try_element_at(full, F.col("actor"))
    cover = F.size("matched") / F.size(want)
    return per.withColumn("missing", F.sort_array(F.array_except(want, F.col("matched")))
                          ).withColumn("coverage", cover).withColumn(
        "score", cover * F.sqrt(F.size("matched"))).filter(
        (F.col("coverage") >= min_coverage) & (F.size("matched") >= min_matched))


def written_techniques(findings: DataFrame) -> DataFrame:
    """Techniques per case from tags, ids written in the claim and listed facts."""
    none = F.array().cast("array<string>")
    by_tag = F.flatten(F.transform(F.coalesce("tags", none), lambda t: F.coalesce(
        F.try_element_at(_lists(ft.TAG_TECHNIQUES), t), none)))
    found = F.array_distinct(F.concat(
        by_tag, F.regexp_extract_all("claim", F.lit(ft.WRITTEN_TECHNIQUE), F.lit(0)),
        F.coalesce("techniques", none)))
    return explode_rows(findings, found, "technique", "case_id", "finding_id")


def technique_union(findings: DataFrame) -> DataFrame:
    """Techniques over all cases with the number of cases and findings behind each."""
    per_case = written_techniques(findings).groupBy("technique", "case_id").agg(
        F.count("*").alias("n"))
    return per_case.groupBy("technique").agg(
        F.count("*").alias("cases"), F.sum("n").alias("findings"),
        F.min("case_id").alias("first_case"))


def technique_analytics(observed: DataFrame, analytics: DataFrame) -> DataFrame:
    """Detection analytics that cover the observed techniques of each case."""
    cover = analytics.select("analytic_id", F.explode("technique_ids").alias("technique"))
    return observed.select("case_id", "technique").distinct().join(cover, "technique")


def technique_capacity(observed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Plain description of a technique from a table, falling back to the parent's."""
    own = capacities.select(F.col("technique"), F.col("capacity").alias("own"))
    up = capacities.select(F.col("technique").alias("_parent"), F.col("capacity").alias("up"))
    return observed.withColumn("_parent", parent_technique(F.col("technique"))).join(
        own, "technique", "left").join(up, "_parent", "left").withColumn(
        "capacity", F.coalesce("own", "up")).drop("own", "up", "_parent")


# --- rarity and shared indicators -----------------------------------------------------------------------

def rarity_bucket(cases: Column) -> Column:
    return (F.when(cases <= 2, "rare").when(cases <= 10, "uncommon").when(cases <= 50, "common")
            .otherwise("ubiquitous"))


def rarity_confidence(bucket: Column) -> Column:
    return lookup({"rare": "high", "uncommon": "medium", "common": "low",
                   "ubiquitous": "insufficient"}, bucket)


def indicator_rarity(iocs: DataFrame) -> DataFrame:
    """Number of other cases each (case, indicator) is known from, with bucket and confidence."""
    pairs = iocs.select("ioc_type", "value", "case_id").distinct()
    spread = pairs.groupBy("ioc_type", "value").agg(F.count("*").alias("_all"))
    bucket = rarity_bucket(F.col("prior_cases"))
    return pairs.join(spread, ["ioc_type", "value"]).withColumn(
        "prior_cases", F.col("_all") - 1).withColumn("bucket", bucket).withColumn(
        "confidence", rarity_confidence(F.col("bucket"))).withColumn(
        "suppressed", F.col("bucket") == "ubiquitous").drop("_all")


def indicator_overlap(iocs: DataFrame, min_cases: int = 2) -> DataFrame:
    """Indicators shared by cases with the number of cases and the first one."""
    per_case = iocs.select("ioc_type", "value", "case_id").distinct()
    return per_case.groupBy("ioc_type", "value").agg(
        F.count("*").alias("cases"), F.min("case_id").alias("first_case")).filter(
        F.col("cases") >= min_cases)


# --- review -------------------------------------------------------------------------------------------------

REVIEW_RULES = [  # rule id, what to check before the claim is accepted
    ("OFFICE_SPAWN_SHELL_BENIGN_AUTOMATION",
     ["open document path", "shell command line", "parent command line", "logon type"]),
    ("MALFIND_JIT_FALSE_POSITIVE",
     ["runtime of the host process", "dump of the region", "region protection",
      "process integrity"]),
    ("LOLBIN_CMDLINE_BENIGN_USE",
     ["signer of the invoked file", "known abuse forms", "installer activity"]),
    ("NETSCAN_CONNECTION_NEEDS_ENRICHMENT",
     ["owner of the destination", "reputation of the destination", "connecting process"]),
    ("LOW_CONFIDENCE_NEEDS_CORROBORATION", ["second independent source"]),
    ("NO_EVIDENCE_NO_CLAIM", ["other tool version", "second tool on the same artifact"]),
]


def reviewed(findings: DataFrame) -> DataFrame:
    """Rules that challenge each finding: status, rule ids and a check list without repeats."""
    claim = F.lower(F.coalesce("claim", F.lit("")))

    def has(words):
        return fn.any_contains(claim, words)
    tests = [
        has(fc.OFFICE_PROGRAMS) & has(fc.SHELL_PROGRAMS),
        claim.contains("malfind") & ~has(fc.CREDENTIAL_TARGETS),
        has(fc.PROXY_PROGRAMS),
        has(fc.CONNECTION_WORDS),
        (F.col("confidence") == "low") & (F.size(F.coalesce(
            "tags", F.array().cast("array<string>"))) > 0),
        (F.col("confidence") == "high") & (F.col("evidence_count") <= 1)
        & has(fc.ATTRIBUTION_WORDS),
    ]
    hit_type = "struct<rule_id:string,checks:array<string>>"
    hits = F.filter(F.array(*[
        F.when(t, F.struct(F.lit(r).alias("rule_id"),
                           F.array(*[F.lit(c) for c in checks]).alias("checks")))
        for t, (r, checks) in zip(tests, REVIEW_RULES)]), lambda x: x.isNotNull())
    closed = F.col("confidence") == "insufficient"
    hits = F.when(~closed, hits).otherwise(F.array().cast(f"array<{hit_type}>"))
    status = (F.when(closed, "unresolved").when(F.size("_hits") > 0, "challenged")
              .when(F.col("evidence_count") == 0, "unresolved").otherwise("passed"))
    return findings.withColumn("_hits", hits).withColumn("review_status", status).withColumn(
        "review_rules", F.transform("_hits", lambda h: h["rule_id"])).withColumn(
        "checklist", F.array_distinct(F.flatten(F.transform(
            "_hits", lambda h: h["checks"])))).drop("_hits")


BASELINE_ASSUMPTIONS = [  # text, confidence, impact, status
    ("The evidence type was identified correctly and the manifest matches the source.",
     "Solid", "High", "Valid"),
    ("Established parsers read the underlying structures correctly.", "Solid", "High", "Valid"),
    ("At least three explanations, one of them benign, were scored against the evidence.",
     "Solid", "High", "Valid"),
    ("The chain of custody is intact.", "Solid", "High", "Valid"),
    ("All times are UTC and clocks did not drift.", "Solid", "Medium", "Valid"),
    ("Indicators shared with other cases are context and score nothing.",
     "Solid", "Medium", "Valid"),
    ("Every finding was reviewed and none is unresolved.", "Solid", "High", "Valid"),
]


def assumptions(findings: DataFrame) -> DataFrame:
    """Key assumptions per case: the baseline, the leader and what weak findings take for granted."""
    cases = findings.select("case_id").distinct()

    def rows(df, kind, text, confidence, impact, status, source=None):
        return df.select("case_id", F.lit(kind).alias("kind"), text.alias("text"),
                         F.lit(confidence).alias("confidence"), F.lit(impact).alias("impact"),
                         F.lit(status).alias("status"),
                         (source if source is not None else F.lit(None).cast("string")).alias(
                             "finding_id"))
    base = cases.select("case_id", F.explode(literal(
        [dict(zip(("text", "confidence", "impact", "status"), a)) for a in BASELINE_ASSUMPTIONS],
        "array<struct<text:string,confidence:string,impact:string,status:string>>")).alias("a")
    ).select("case_id", F.lit("baseline").alias("kind"), "a.text", "a.confidence", "a.impact",
             "a.status", F.lit(None).cast("string").alias("finding_id"))
    lead = rows(leaders(findings), "leader", F.col("leader"), "Solid", "High", "Valid")
    claim = F.col("claim")
    low = rows(findings.filter(F.col("confidence") == "low"), "low", claim, "Caveats", "Medium",
               "Conditional", F.col("finding_id"))
    gap = rows(findings.filter(F.col("confidence") == "insufficient"), "gap", claim, "Caveats",
               "Medium", "Conditional", F.col("finding_id"))
    feed = rows(findings.filter(F.col("agent") == "threat_feeds").select("case_id").distinct(),
                "feed", F.lit("External feeds are accurate and current."), "Caveats", "Low",
                "Conditional")
    rated = F.exists(F.coalesce("tools", F.array().cast("array<string>")),
                     lambda t: tool_rating(t) == "A2")
    heuristic = rows(findings.filter(rated).select("case_id").distinct(), "heuristic",
                     F.lit("Heuristic matchers classified their samples correctly."), "Caveats",
                     "Medium", "Conditional")
    return reduce(lambda a, b: a.unionByName(b), [base, lead, low, gap, feed, heuristic])


def tool_rating(tool: Column) -> Column:
    """Two-character rating of a tool; version suffixes and .exe do not matter, unknown is XX."""
    mapping = literal(fc.TOOL_RATINGS, "map<string,string>")
    key = F.regexp_replace(F.lower(F.trim(tool)), r"\.exe$", "")
    head = F.when(key.contains("-"), F.substring_index(key, "-", 1))
    return F.coalesce(F.try_element_at(mapping, head), F.try_element_at(mapping, key),
                      F.lit("XX"))


def downgraded(rating: Column, by: int = 1) -> Column:
    """Worsen the credibility digit; six and unset stay."""
    digit = F.substring(rating, 2, 1)
    step = F.least(F.lit(6), digit.try_cast("int") + by).cast("string")
    return F.when(digit.rlike("[1-5]"), F.concat(F.substring(rating, 1, 1), step)).otherwise(
        rating)


def best_rating(ratings: Column) -> Column:
    """The strongest of a list of ratings."""
    valid = F.filter(ratings, lambda r: r.rlike("^[A-FX][1-6X]$"))
    return F.coalesce(F.array_min(F.transform(valid, lambda r: F.struct(
        F.position(F.substring(r, 1, 1), F.lit(fc.RELIABILITY)).alias("a"),
        F.position(F.substring(r, 2, 1), F.lit(fc.CREDIBILITY)).alias("b"), r.alias("r"))))["r"],
        F.lit("XX"))


# --- story and timelines ----------------------------------------------------------------------------------

def evidence_time(findings: DataFrame) -> DataFrame:
    """Adds the earliest artifact time: listed facts first, a time in the claim otherwise."""
    texts = F.filter(F.array(*[F.try_element_at("facts", F.lit(k)) for k in fc.TIME_KEYS]),
                     lambda x: x.isNotNull())
    facts = F.array_min(F.transform(texts, lambda t: F.try_to_timestamp(t)))
    claim = F.array_min(fn.timestamps_in_text(F.col("claim")))
    day = F.try_to_timestamp(F.nullif(F.regexp_extract(
        "claim", r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit("")))
    return findings.withColumn("evidence_time", F.when(
        F.col("agent") != fh.UNSCORED_AGENT, F.coalesce(facts, claim, day)))


def beat(findings: DataFrame) -> Column:
    """Story beat: first listed tag, else tactic of the first listed technique, else the agent."""
    none = F.array().cast("array<string>")
    tags = F.filter(F.transform(F.coalesce("tags", none), lambda t: F.try_element_at(
        literal(fc.TAG_BEATS, "map<string,string>"), t)), lambda b: b.isNotNull())
    tactics = F.filter(F.transform(F.coalesce("techniques", none), lambda t: F.try_element_at(
        literal(fc.TACTIC_BEATS, "map<string,string>"), tactic(t))), lambda b: b.isNotNull())
    agent = F.coalesce("agent", F.lit(""))
    by_agent = fn.first_match(
        [(agent == "triage", "prologue"), (agent == "red_reviewer", "aftermath")]
        + [(agent.contains(part), b) for part, b in fc.AGENT_BEATS], "execution")
    return F.when(agent == fh.UNSCORED_AGENT, "prologue").otherwise(
        F.coalesce(F.get(tags, F.lit(0)), F.get(tactics, F.lit(0)), by_agent))


def story_beats(findings: DataFrame) -> DataFrame:
    """Findings, distinct bullets and time span of every beat of a case."""
    rows = evidence_time(findings).withColumn("beat", beat(findings))
    bullets = rows.groupBy("case_id", "beat", "agent", F.trim("claim").alias("bullet")).agg(
        F.count("*").alias("n"), F.min("evidence_time").alias("a"),
        F.max("evidence_time").alias("b"))
    order = F.array_position(F.array(*[F.lit(b) for b in fc.BEATS]), F.col("beat")).cast("int")
    return bullets.groupBy("case_id", "beat").agg(
        F.sum("n").alias("findings"), F.count("*").alias("bullets"), F.min("a").alias("earliest"),
        F.max("b").alias("latest")).withColumn("beat_order", order)


def activity_thread(findings: DataFrame) -> DataFrame:
    """Findings behind the leading hypothesis placed in their earliest tactic.

    A case whose leader is backed by no placed finding shows all of its placed findings instead.
    """
    none = F.array().cast("array<string>")
    orders = F.filter(F.transform(F.coalesce("techniques", none), lambda t: tactic_order(
        tactic(t))), lambda o: o <= len(ft.TACTICS))
    placed = findings.withColumn("phase_order", F.array_min(orders)).filter(
        F.col("phase_order").isNotNull())
    lead = leaders(findings).select("case_id", "leader")
    rows = placed.join(lead, "case_id").withColumn(
        "in_scope", F.array_contains("tags", F.col("leader")))
    scoped = rows.groupBy("case_id").agg(F.bool_or("in_scope").alias("_any"))
    phases = F.array(*[F.lit(t) for t in ft.TACTICS])
    return rows.join(scoped, "case_id").filter(F.col("in_scope") | ~F.col("_any")).select(
        "case_id", "finding_id", "phase_order",
        F.element_at(phases, F.col("phase_order")).alias("phase"),
        (~F.col("_any")).alias("widened"),
        F.when(F.col("confidence") == "insufficient", "Hypothesis").otherwise("Actual").alias(
            "status"))


def event_timeline(findings: DataFrame, mode: str = "findings") -> DataFrame:
    """One stream of findings by artifact time, or by the time they were written."""
    if mode == "findings":
        rows = evidence_time(findings).withColumn("ts", F.col("evidence_time")).filter(
            F.col("confidence") != "insufficient")
    else:
        rows = findings.withColumn("ts", F.col("created"))
    return rows.filter(F.col("ts").isNotNull()).select(
        "ts", "case_id", "host", "finding_id", "agent", "confidence").orderBy(
        "ts", "case_id", "finding_id")


# --- hosts ----------------------------------------------------------------------------------------------------

def signal_hits(findings: DataFrame) -> DataFrame:
    """Claim signals per host (long form of the signal matrix)."""
    claim = F.lower(F.coalesce("claim", F.lit("")))
    found = F.filter(F.array(*[F.when(fn.any_contains(claim, words), name)
                               for name, words in fc.CLAIM_SIGNALS]), lambda x: x.isNotNull())
    return explode_rows(findings, found, "signal", "host").groupBy(
        "signal", "host").agg(F.count("*").alias("hits"))


def signal_matrix(findings: DataFrame, hosts) -> DataFrame:
    """Signals x hosts, rows without a hit left out."""
    return signal_hits(findings).groupBy("signal").pivot("host", list(hosts)).agg(
        F.sum("hits")).na.fill(0)


def evidence_divergence(findings: DataFrame, min_span: int = 15) -> DataFrame:
    """Hosts whose cases disagree on the leader or whose leading scores lie far apart."""
    host = findings.groupBy("case_id").agg(F.min("host").alias("host"))
    per = leaders(findings).join(host, "case_id")
    out = per.groupBy("host").agg(
        F.count("*").alias("cases"), F.count_distinct("leader").alias("leaders"),
        F.max("score").alias("max_score"), F.min("score").alias("min_score"))
    span = F.col("max_score") - F.col("min_score")
    quiet = (F.col("max_score") == 0) & (F.col("min_score") == 0)
    return out.withColumn("span", span).filter(
        (F.col("cases") >= 2) & ~quiet & ((F.col("leaders") > 1) | (F.col("span") >= min_span)))


def clock_baselines(facts: DataFrame) -> DataFrame:
    """Latest clock facts per host (time zone, bias, sync mode, peer, skew); nulls show gaps."""
    per = facts.groupBy("host").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("observed", c))).alias(c)
        for c in ("tz_name", "bias_minutes", "sync_mode", "ntp_peer", "skew_seconds")])
    mins = -F.col("bias_minutes")
    offset = F.format_string("UTC%s%02d:%02d", F.when(mins >= 0, "+").otherwise("-"),
                             F.floor(F.abs(mins) / 60), F.abs(mins) % 60)
    return per.withColumn("utc_offset", F.when(mins.isNotNull(), offset)).withColumn(
        "sync_mode", F.upper("sync_mode")).withColumn("missing", F.col("tz_name").isNull()
                                                      & F.col("skew_seconds").isNull())


def clock_alerts(facts: DataFrame) -> DataFrame:
    """Counts behind the clock alerts of an estate, as one row."""
    c = clock_baselines(facts)
    out = c.agg(F.count_distinct("tz_name").alias("time_zones"),
                F.count_distinct("sync_mode").alias("sync_modes"),
                F.count_distinct("ntp_peer").alias("ntp_peers"),
                F.count_if(F.col("sync_mode") == "NOSYNC").alias("unsynced_hosts"),
                F.count_if("missing").alias("missing_hosts"),
                F.max(F.abs("skew_seconds")).alias("max_skew"))
    return out.withColumn("tz_split", F.col("time_zones") > 1).withColumn(
        "sync_split", (F.col("sync_modes") > 1) & (F.col("unsynced_hosts") == 0)).withColumn(
        "peer_split", F.col("ntp_peers") > 1)


def bundle_union(findings: DataFrame, bundle: Column) -> DataFrame:
    """Findings of several devices restamped with their bundle; the device is kept."""
    return findings.withColumn("device", F.coalesce("host", "case_id")).withColumn(
        "case_id", bundle)


