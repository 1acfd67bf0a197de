import random
import re
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import collocations
from emberlog.llm.collocations import BINS, segments

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int"


def brute(docs, least, longest, top):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    counts[lang, tuple(words[at:at + k])] += 1
    many = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    inside = Counter()
    for (lang, words), a in many.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                inside[lang, words[at:at + size]] = max(a, inside[lang, words[at:at + size]])
    out = {}
    for (lang, words), a in many.items():
        if inside[lang, words] >= a:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return {lang: [(i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
            for lang, rows in out.items()}


def made():
    rng = random.Random(8)
    phrases = ["new york city", "of the", "San  Francisco\tBay area news", "à propos de", "a b c d e f g", "x x x x x x"]
    docs = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice([*phrases, "of", "the", "city", f"w{rng.randrange(2000)}", "É"]))
            parts.append(rng.choice([" ", "  ", "\t", ". ", ", ", "\n", " \x1c ", "\x0b"]))
        docs.append(("".join(parts), rng.choice(["en", "en", "fr", None, ""])))
    return docs + [(None, "en"), ("", "fr"), ("...", "de"), ("one two " * 3000, "de"), ("only . once", "it")]


def report(table, **options):
    got = {}
    for r in sorted(collocations.collocations(table, **options).collect(), key=lambda r: (r["lang"], r["rank"])):
        got.setdefault(r["lang"], []).append(tuple(r[c] for c in ("rank", "phrase", "a", "l", "r", "n", "score")))
    return got


@pytest.mark.parametrize("least,top", [(10, 2000), (2, 2000), (10, 3)])
def test_report_equals_counting_all_phrases(rows, least, top):
    docs = made()
    table = rows([(i, *d, "clash", 3) for i, d in enumerate(docs)], SCHEMA)
    assert report(table, least=least, top=top) == brute(docs, least, 5, top)


def test_full_bins_change_nothing(rows, monkeypatch):
    docs = made()
    table = rows([(i, *d, "clash", 3) for i, d in enumerate(docs)], SCHEMA)
    monkeypatch.setattr(collocations, "frequent_bins", lambda *given: np.full(BINS // 8, 255, dtype=np.uint8))
    assert report(table, least=10) == brute(docs, 10, 5, 2000)


def test_an_empty_table_and_wrong_bounds(rows):
    assert collocations.collocations(rows([], SCHEMA)).collect() == []
    for options in ({"least": 0}, {"longest": 1}):
        with pytest.raises(ValueError):
            collocations.collocations(rows([], SCHEMA), **options)


def test_products_beyond_64_bits_stay_exact(spark):
    data = [("en", 0, "", 4_000_000_000_000), ("en", 1, "p", 300_000_000_001), ("en", 1, "q", 200_000_000_003),
            ("en", 2, "p q", 100_000_000_007)]
    row = collocations.ranked(spark.createDataFrame(data, "lang string, words int, phrase string, f bigint"),
                              100, 5, 10).collect()[0]
    assert row["score"] == 1000 * data[3][3] * data[0][3] // (data[1][3] * data[2][3])


def test_long_texts_are_cut_at_piece_ends_only(monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 50)
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab c.\n", k=rng.randint(0, 400))) for _ in range(50)] + [b"abc " * 100]

    def pieces(parts):
        return sorted(p for x in parts for p in re.split(rb"[.\n]", x) if p.strip())
    assert pieces(segments(texts)) == pieces(texts)
