import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from emberlog.llm.filter_audit import Diagram, audited, document_audit, plain_changes

SCHEMA = "doc_id bigint, text string, lang string, part string, mask int, n string"


def fails(text, id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [c for c, bad in (
        ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
        ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)), ("D", bool(re.search("[#$%&*|]", text))),
        ("E", id is not None and least[text] is not None and id > least[text])) if bad]


def brute(docs, labels):
    least = {}
    for id, text, _ in docs:
        ids = [x for x in (id, least.get(text or "")) if x is not None]
        least[text or ""] = min(ids, default=None)
    marks = defaultdict(lambda: [0, 0])
    for id, quality, toxic in labels:
        marks[id][0] |= quality == 1
        marks[id][1] |= toxic == 1
    rows = [(lang or "", fails(text or "", id, least), *(marks[id] if id is not None else (0, 0)))
            for id, text, lang in docs]
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = set(order[:step - 1])
                here = [r for r in mine if f in r[1] and not gone & set(r[1])]
                shapley[f] += len(here)
                out[part, "".join(order), step] = (
                    sum(not set(order[:step]) & set(r[1]) for r in mine), len(here),
                    sum(f in r[1] and bool(gone & set(r[1])) for r in mine), sum(r[1] == [f] for r in mine),
                    sum(r[2] for r in here), sum(r[3] for r in here))
        for (p, order, step), row in out.items():
            if p == part:
                out[p, order, step] = (*row[:6], shapley[order[step - 1]])
    return out


def test_audit_equals_counting_documents(rows):
    rng = random.Random(5)
    docs = []
    for id in range(120):
        n = rng.choice([3, 60, 199, 200, 260])
        words = [rng.choice(["Word", "WORD", "some", f"w{rng.randrange(400)}", "thing\t", "ä"]) for _ in range(n)]
        if rng.random() < 0.3:
            words.append(rng.choice("#$%&*|"))
        docs.append((id, " ".join(words), rng.choice(["en", "de", None, ""])))
    docs += [(200 + i, "copy of a text", rng.choice(["en", "de"])) for i in range(50)]
    docs += [(300, None, "en"), (301, "", "de"), (302, "  \n", "xx"), (None, "copy of a text", "en"),
             (None, None, None), (400, "twice", "en"), (400, "twice", "en"), (500, "w" * 300_000, "en")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 260, 2)] + [
        (4, 1, 1), (None, 1, 1), (300, None, 1), (9999, 1, 1)]
    table = rows([(*d, "clash", 7, "n") for d in docs], SCHEMA)
    marks = rows([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, text string")
    got = {(r["part"], r["filter_order"], r["step"]): (
        r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"])
        for r in document_audit(table, marks).collect()}
    assert got == brute(docs, labels)


def test_nothing_gives_nothing(rows):
    none = rows([], SCHEMA)
    assert document_audit(none, rows([], "doc_id bigint, quality int, toxic int")).collect() == []


def test_swaps_keep_the_counts_and_share_nodes():
    rng = random.Random(2)
    counts = {m: (rng.randrange(5), rng.randrange(3)) for m in range(32) if rng.random() < 0.6}
    diagram = Diagram("ABCDE", counts)
    seen = list(plain_changes("ABCDE"))
    assert sorted(seen) == sorted("".join(p) for p in permutations("ABCDE"))
    for before, after in zip(seen, seen[1:]):
        assert sum(x != y for x, y in zip(before, after)) == 2
    for order in seen:
        diagram.to(order)
        bits = 0
        for letter, kept, removed in diagram.steps():
            mine = 1 << "ABCDE".index(letter)
            assert removed == tuple(sum(c[i] for m, c in counts.items() if m & mine and not m & bits) for i in (0, 1))
            bits |= mine
            assert kept == tuple(sum(c[i] for m, c in counts.items() if not m & bits) for i in (0, 1))
    alike = Diagram("ABCDE", {m: (1,) for m in range(32)})
    assert len(alike.weight) == 6  # one node per level where all sub-diagrams are equal


def test_other_letters_and_wrong_ones(rows):
    masks = rows([("p", 1, 4, 2), ("p", 0, 3, 0), (None, 3, 1, 1)], "part string, mask int, n bigint, seen bigint")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["seen"], r["shapley"])
           for r in audited(masks, "XY", ["seen"]).collect()}
    assert got["p", "XY", 1] == (3, 4, 2, 8) and got["p", "YX", 1] == (7, 0, 0, 0)
    assert got["", "YX", 2] == (0, 0, 0, 1) and len(got) == 8
    for letters, marks in (("XX", []), ("", []), ("ABCDEFGH", []), ("X", ["kept"])):
        with pytest.raises(ValueError):
            audited(masks, letters, marks)
