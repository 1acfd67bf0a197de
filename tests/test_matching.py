import random
import re

from emberlog.fixed import patterns as fp
from emberlog.operators import matching, patterns
from emberlog.plans.case_queries import EVERY_FINGERPRINT


def test_required_literals_are_in_every_match():
    assert matching.required_literals(r"(?i)\bsekurlsa\b.{0,30}\b(?:msv|tspkg)\b") == {"sekurlsa"}
    assert matching.required_literals(r"/(?:table|chrls)\.[a-z]{3}") == {"table", "chrls"}
    assert matching.required_literals(r"a?b*[cd]") == frozenset() == matching.required_literals("(?:abc|x*)")
    assert matching.required_literals("(?i)straße") == {"stra"} and matching.required_literals("ab\ncd") == frozenset()
    assert matching.required_literals(r"(?:abc)+\d") == {"abc"} and matching.required_literals("(?:abc){0,2}de") == {"de"}
    assert matching.required_literals("x(?=foo)yz") == {"xyz"}


def brute(rules, text):
    out = []
    for number, line in enumerate(text.split("\n")):
        line = line.removesuffix("\r").strip(" ")
        if line and line[0] != "#":
            for r in rules:
                if not (r.benign and re.search(r.benign, line, re.ASCII)):
                    for m in re.finditer(r.pattern, line, re.ASCII):
                        out.append((r.family, r.number, number, m.start(),
                                    line[max(0, m.start() - 16):m.end() + 16].strip(" ")))
    return sorted(out)


def texts():
    rng = random.Random(3)
    pieces = [*EVERY_FINGERPRINT, "\n", "\n", "\r\n", "#", " ", "é", "plain words", "GOOGLE-ANALYTICS", "x", "\n\n  "]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(400)] + ["", "\n", None, "x" * 100_000]


def test_one_pass_finds_what_each_pattern_finds(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "id int, text string").repartition(3)
    for context in (None, "network", "disk"):
        rules = matching.rules_of(fp.MALWARE_FAMILIES, context)
        got = {}
        for r in patterns.fingerprint_matches(rows, context, keep=["id"]).collect():
            got.setdefault(r["id"], []).append((r["family"], r["pattern"], r["line_no"], r["start"], r["snippet"]))
        for i, t in enumerate(texts()):
            assert sorted(got.get(i, [])) == brute(rules, t or ""), t
    lines = {(r["id"], r["line_no"], r["family"]) for r in patterns.fingerprint_lines(rows, keep=["id"]).collect()}
    rules = matching.rules_of(fp.MALWARE_FAMILIES)
    assert lines == {(i, x[2], x[0]) for i, t in enumerate(texts()) for x in brute(rules, t or "")}


def test_patterns_without_literals_are_tried_on_every_line(spark):
    families = {"digits": [r"\d{3}", "abc"], "word": ["xyz"], "any": ["q*z?"]}
    data = [(1, "a 123\nplain\nabc 456\nxyz"), (2, "nothing"), (3, None)]
    rows = spark.createDataFrame(data, "id int, text string")
    got = {(r["id"], r["line_no"], r["family"]) for r in matching.text_families(
        rows, matching.rules_of(families), keep=["id"]).collect()}
    assert got == {(1, 0, "digits"), (1, 2, "digits"), (1, 3, "word"), *((1, n, "any") for n in range(4)), (2, 0, "any")}
    by_line = patterns.family_matches(patterns.text_lines(rows, keep=["id"]), families).collect()
    assert sorted((r["line"], r["family"]) for r in by_line if r["family"] != "any") == [
        ("a 123", "digits"), ("abc 456", "digits"), ("xyz", "word")]


def test_every_fingerprint_fires_and_snippets_are_bounded(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(EVERY_FINGERPRINT)] * 3, "id int, text string")
    found = patterns.fingerprint_matches(rows, keep=["id"])
    assert found.select("family", "pattern").distinct().count() == 79
    best = patterns.fingerprint_snippets(found, "id", 2).collect()
    assert all(r["rank"] <= 2 for r in best) and len(best) == 2 * len(fp.MALWARE_FAMILIES)
