import hashlib
import random
import re

import pytest

from emberlog.llm.secret_scan import BASE, MORE, Nfa, Rule, Scanner, _built, digest, scanned, searching

KINDS = [r.kind for r in BASE + MORE]
FIND = {"assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", **{r.kind: r.pattern for r in MORE}}


def brute(text):
    """Matches by Python's regexes, one rule after another."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(FIND[kind], text):
            if not (kind == "assign" and len(m[1]) < 6 or kind == "access" and len(m[0]) < 20
                    or kind == "hex" and len(m[0]) < 24):
                out.append((m.start(), k, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(out)]


PIECES = ["password", "passwd", "secret", "SECRET", "Token", "toKen", "api_key", "apikey", "ap", "pass", "_", '"', "'",
          " ", "  ", ":", "=", "f0", "abcdef0123456789", "0123456789ab", "AKIA", "AKIAAKIA", "ABCDEF12", "9" * 20,
          "Z", "g", "\n", "é", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", ".", "ghp_", "A" * 30, "b" * 6,
          "xoxb-", "1234567890", "x", "-", "ſ", "K", "\x00"]


def texts():
    rng = random.Random(9)
    made = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(6000)]
    made += ["secret: token: abcdefgh", "token=token=abcdef", "x" * 200_000 + "é password = 'abcdef1'" + "0" * 100_000]
    return made


def test_scanner_finds_what_the_regexes_find():
    scanner = Scanner(BASE + MORE)
    for text in texts():
        data = text.encode()
        got = [(KINDS[k], len(data[:s].decode()), len(data[:e].decode())) for s, e, k in scanner.scan(data)]
        assert got == brute(text), text


def test_query_columns_nulls_repeats_and_clashing_names(rows):
    some = texts()[:300] + ["", None, "twice secret=abcdef", "twice secret=abcdef", "ä token: 'abcdefg' ä" * 2000]
    schema = "doc_id bigint, text string, secrets string, kind int"
    table = rows([(i, t, "clash", 1) for i, t in enumerate(some)] + [(None, "api_key=1234567", "x", 2)], schema)
    got = {r["doc_id"]: r for r in digest(table).collect()}
    for i, t in [*enumerate(some), (None, "api_key=1234567")]:
        found = brute(t or "")
        base = [x for x in found if x[0] in ("assign", "access", "hex")]
        assert got[i]["spans"] == ",".join("%s:%d:%d" % x for x in found)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % x for x in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [
            sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
    one = scanned(table.filter("doc_id IS NULL")).collect()[0]
    assert [tuple(s) for s in one["secrets"]] == [("assign", 0, 15, "api_key=1234567")] and one["kind"] == 2
    assert digest(rows([], schema)).collect() == []


def test_minimisation_merges_equal_states():
    nfa = Nfa("(?:ab|cb|[de]b)c")
    dfa = _built(nfa, nfa.closure({nfa.start}), nfa.step, lambda s: int(nfa.end in s))
    assert len(dfa.next) == 5  # start, after the first, after b, the end, and the dead state
    assert len(searching(Rule("x", "[0-9]{3,}")).next) == 4


def test_rules_that_one_pass_cannot_answer_are_refused():
    for pattern in ("a", "a*", "ab(?:cd)?", "a[ab]*cc|bb", "é+x", r"\d\d", "ab?"):
        with pytest.raises(ValueError):
            Scanner((Rule("bad", pattern),))
    with pytest.raises(ValueError):
        Scanner((Rule("two", "ab"), Rule("two", "cd")))


def test_random_rules_against_regexes():
    rng = random.Random(4)
    tried = 0
    while tried < 60:
        parts = [rng.choice(["a", "b", "[ab]", "c", "(?:ab|c)", "a{2,3}", "b?"]) for _ in range(rng.randint(2, 4))]
        pattern = "".join(parts) + rng.choice(["", "c+", "[bc]+"])
        try:
            scanner = Scanner((Rule("one", pattern), Rule("two", "c{3,}")))
        except ValueError:
            continue
        tried += 1
        for _ in range(40):
            text = "".join(rng.choices("abc", k=rng.randint(0, 14)))
            # leftmost longest: alternatives here can't make Python's choice shorter than the longest one
            want = []
            at = 0
            while at < len(text):
                ends = [e for e in range(len(text), at, -1) if re.fullmatch(pattern, text[at:e])]
                if ends:
                    want.append((at, ends[0], 0))
                    at = ends[0]
                else:
                    at += 1
            want += [(m.start(), m.end(), 1) for m in re.finditer("c{3,}", text)]
            assert scanner.scan(text.encode()) == sorted(want, key=lambda m: (m[0], m[2])), (pattern, text)
