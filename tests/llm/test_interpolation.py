import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm.interpolation import (BUCKETS, by_range, from_planes, learned_weights, narrow, planes, scored, widen)


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0D]+", low) + [None]


def brute(docs):
    """The same model by dictionaries: (id, part, text) -> id -> (n, known, N, base, score)."""
    def counts(parts):
        word, pair, context = Counter(), Counter(), Counter()
        for _, part, text in docs:
            if part in parts:
                t = tokens(text)
                word.update(t)
                before = ["<start>"] + t[:-1]
                pair.update(zip(before, t))
                context.update(before)
        return word, pair, context

    word, pair, context = counts({0})
    n, v = sum(word.values()), len(word)
    cells = Counter()
    for _, part, text in docs:
        if part == 1:
            before = "<start>"
            for w in tokens(text):
                zero = 1 / (v + 1)
                two = pair[before, w] / context[before] if context[before] else 0
                one = word[w] / n if n else 0
                log = [round(4 * math.log2(p / zero)) if p else -1000 for p in (two, one)]
                cells[min(context[before].bit_length(), BUCKETS - 1), *log] += 1
                before = w
    weights = learned_weights(np.array([(*k, c) for k, c in sorted(cells.items())], dtype=np.int64).reshape(-1, 4))
    word, pair, context = counts({0, 1})
    n, v = sum(word.values()), len(word)
    for id, part, text in docs:
        before, base, score, t = "<start>", 0.0, 0.0, tokens(text)
        for w in t:
            base += math.log10((word[w] + 0.1) / (n + 0.1 * (v + 1)))
            a = weights[min(context[before].bit_length(), BUCKETS - 1)]
            score += math.log10(a[0] * (pair[before, w] / context[before] if context[before] else 0)
                                + a[1] * (word[w] / n if n else 0) + a[2] / (v + 1))
            before = w
        yield id, (len(t), sum(word[w] > 0 for w in t), n, base, score)


def corpus():
    rng = random.Random(8)
    words = [f"w{int(1.7 ** rng.random() * i)}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, weights=range(60, 0, -1), k=rng.randint(0, 80)))
    docs = [(i, rng.choice([0, 0, 0, 1, 2]), text()) for i in range(120)]
    return docs + [(200, 0, None), (201, 2, ""), (202, 2, "NEVER Seen\x0bbefore"), (203, 0, "the " * 30_000),
                   (204, 1, "ümlaut ÜMLAUT A B"), (205, 0, "same here"), (206, 0, "same here")]


def test_against_dictionaries(rows):
    docs = corpus()
    df = rows([(i, p, t, 1) for i, p, t in docs], "doc_id bigint, part int, text string, batch int")
    for options in ({}, {"batch_tokens": 300, "range_tokens": 100}):
        got = {r["doc_id"]: r for r in scored(df, F.col("part"), **options).collect()}
        assert len(got) == len(docs)
        for id, (n, known, total, base, score) in brute(docs):
            r = got[id]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9)
            assert math.isclose(r["score"], score, rel_tol=1e-6), id
            assert r["held_out"] == (dict((i, p) for i, p, _ in docs)[id] == 2)


def test_mixture_is_a_distribution_and_better_than_words_alone(rows):
    rng = random.Random(9)
    follows = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}

    def text():
        out = ["a"]
        for _ in range(60):
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(out)

    docs = [(i, i % 5 % 3, text()) for i in range(100)]
    got = scored(rows(docs, "doc_id bigint, part int, text string"), F.col("part")).filter("held_out").collect()
    assert sum(r["score"] for r in got) > 0.5 * sum(r["base_score"] for r in got)


def test_nothing_to_learn_from(rows):
    schema = "doc_id bigint, part int, text string"
    assert scored(rows([], schema), F.col("part")).collect() == []
    alone = scored(rows([(1, 2, "a b")], schema), F.col("part")).collect()[0]
    assert (alone["n_tokens"], alone["n_known"], alone["train_tokens"]) == (3, 0, 0)
    assert math.isclose(alone["score"], 3 * math.log10(0.5))  # half the weight is the uniform one's


def test_weights_prefer_what_explains_the_held_out_counts():
    w = learned_weights(np.array([(3, 40, 8, 90), (3, -1000, 8, 10), (5, -1000, 20, 50)]))
    assert w[3][0] > 0.8 and w[5][1] > 0.9 and np.allclose(w.sum(1), 1) and w[0][0] == 0


def test_number_lists_survive_packing():
    rng = np.random.default_rng(10)
    for n in (0, 1, 1000):
        x = rng.integers(0, 1 << 32, n).astype("<u4")
        assert (from_planes(planes(x)) == x).all()
        keys = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (widen(narrow(keys)) == keys).all()


def test_ranges_without_keys_cost_no_step():
    bounds = np.array([(r << 64) // 100_000 for r in range(100_000)], dtype=np.uint64)
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 50, dtype=np.uint64))
    places = by_range(keys, bounds)
    assert len(places) <= 50 and sum(s.stop - s.start for s in places.values()) == 50
    for r, s in places.items():
        end = int(bounds[r + 1]) if r + 1 < len(bounds) else 1 << 64
        assert all(int(bounds[r]) <= int(k) < end for k in keys[s])
    assert by_range(keys[:0], bounds) == {}
