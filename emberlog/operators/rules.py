"""Detection rules over event rows: selections of field tests combined by a condition.

A rule is a dict with id, level, and `detection` holding named selections and a `condition`. A
selection is a dict of `field|modifier` to a value or list (a list of dicts means any of them).
Every rule becomes one boolean Column; Spark's own expression parser reads the condition, so a
table of events is scanned once for all rules.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.operators.common import explode_rows

MODIFIERS = {"contains", "startswith", "endswith", "re", "all", "cased", "gt", "gte", "lt", "lte"}
LEVELS = ["critical", "high", "medium", "low", "informational"]


def _any(tests):
    return reduce(lambda a, b: a | b, tests)


def _all(tests):
    return reduce(lambda a, b: a & b, tests)


def _wild(text: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in text) + "$"


def _one(value: Column, want, mods: set[str], known: bool) -> Column:
    """One value test. On the payload blob of an unknown field every text test is a containment."""
    if mods & {"gt", "gte", "lt", "lte"}:
        number = value.try_cast("double")
        return {"gt": number > want, "gte": number >= want, "lt": number < want,
                "lte": number <= want}[next(iter(mods & {"gt", "gte", "lt", "lte"}))]
    text = str(want)
    if "re" in mods:
        return value.rlike(text)
    if "cased" not in mods:
        value, text = F.lower(value), text.lower()
    if "contains" in mods or not known:
        return value.contains(text.strip("*"))
    if "startswith" in mods:
        return value.startswith(text)
    if "endswith" in mods:
        return value.endswith(text)
    return value.rlike("(?s)" + _wild(text)) if set(text) & set("*?") else value == text


def _field_test(key: str, want, fields: dict[str, Column], blob: Column) -> Column:
    name, *mods = key.split("|")
    mods = {m.lower() for m in mods}
    if mods - MODIFIERS:
        return F.lit(False)
    known = name in fields
    value = F.coalesce(fields[name] if known else blob, F.lit(""))
    wants = want if isinstance(want, list) else [want]
    tests = [_one(value, w, mods, known) for w in wants]
    return F.coalesce(_all(tests) if "all" in mods else _any(tests), F.lit(False))


def _selection(body, fields, blob) -> Column:
    if isinstance(body, list):
        if all(isinstance(b, str) for b in body):
            return _any([F.lower(blob).contains(b.lower()) for b in body])
        return _any([_selection(b, fields, blob) for b in body])
    return _all([_field_test(k, v, fields, blob) for k, v in body.items()])


def expand_condition(condition: str, names) -> str:
    """Write out `1 of x*`, `all of x*` and `them`; unknown selection names become false."""
    def group(m):
        many, pattern = m.group(1).lower(), m.group(2)
        chosen = [n for n in names if pattern == "them" or re.fullmatch(
            pattern.replace("*", ".*"), n)]
        if not chosen:
            return "false"
        return "(" + (" and " if many == "all" else " or ").join(chosen) + ")"
    text = re.sub(r"(?i)\b(1|any|all) of (\S+?)(?=[\s)]|$)", group, condition)
    words = set(names) | {"and", "or", "not", "true", "false"}
    return re.sub(r"[A-Za-z_][A-Za-z0-9_]*", lambda m: m.group(0) if m.group(0) in words
                  or m.group(0).lower() in words else "false", text)


def event_ids(detection: dict) -> list[int] | None:
    """Event ids a rule can match, when every selection its condition needs names them."""
    condition = detection["condition"].lower()
    if " not " in f" {condition} ":
        return None
    ids: set[int] = set()
    for name, body in detection.items():
        if name == "condition":
            continue
        if not isinstance(body, dict) or "EventID" not in body:
            return None
        want = body["EventID"]
        ids |= {int(x) for x in (want if isinstance(want, list) else [want])}
    return sorted(ids)


def match_rules(events: DataFrame, rules, fields: dict[str, Column], blob: Column,
                event_id: str = "event_id") -> DataFrame:
    """One row per event and matching rule (adds rule_id, level).

    The cheap event-id test stands first in every rule, so most text tests are never evaluated.
    """
    rows = events
    hits = []
    for i, rule in enumerate(rules):
        detection = rule["detection"]
        names = [n for n in detection if n != "condition"]
        columns = {n: f"_r{i}_{n}" for n in names}
        ids = event_ids(detection)
        gate = F.col(event_id).isin(ids) if ids else F.lit(True)
        rows = rows.withColumns({columns[n]: gate & _selection(detection[n], fields, blob)
                                 for n in names})
        text = expand_condition(detection["condition"], names)
        for n in sorted(names, key=len, reverse=True):
            text = re.sub(rf"\b{re.escape(n)}\b", columns[n], text)
        hits.append(F.when(gate & F.expr(text), F.struct(
            F.lit(rule["id"]).alias("rule_id"), F.lit(rule.get("level", "medium")).alias("level"))))
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return explode_rows(rows, found, "_hit").select(
        *events.columns, "_hit.rule_id", "_hit.level")


def rule_summary(matches: DataFrame, ts: str = "ts", sample: str | None = None) -> DataFrame:
    """Matches per rule, most severe level first."""
    order = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    aggs = [F.count("*").alias("event_count"), F.min(ts).alias("first_seen"),
            F.max(ts).alias("last_seen")]
    if sample:
        aggs.append(F.min(sample).alias("sample"))
    return matches.groupBy("rule_id", "level").agg(*aggs).withColumn(
        "level_order", order.cast("int"))
