import random

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm.toxicity import fit, gram_bins, regression, sampled, scored, trained


def corpus(n=600):
    rng = random.Random(11)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.choice([5, 30, 200]))
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["scumbag", "Moronic!!", "LOSERS"])
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy(rows):
    docs, labels = corpus()
    df, given = rows(docs, "doc_id bigint, text string"), rows(labels, "doc_id bigint, toxic int")
    model = trained(df, given, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r["score"] for r in scored(df, model).collect()}
    truth = dict(labels)
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= 0.3, truth[i] == 1) for i in got if i % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_every_bin_that_depends_on_the_label_is_a_feature(rows):
    """Brute force over the labelled texts; no number of features is the limit."""
    rng = random.Random(5)
    toxic = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)]
    plain = ["".join(rng.choices("0123456789", k=6)) for _ in range(300)]
    texts = [(" ".join(rng.choices(toxic if i % 3 == 0 else plain, k=60)), int(i % 3 == 0)) for i in range(150)]
    model = fit(rows(texts, "text string, label int"))
    on, total, want = sum(y for _, y in texts), len(texts), set()
    seen = {}
    for t, y in texts:
        for b in set(gram_bins(t, 18).tolist()):
            n = seen.setdefault(b, [0, 0])
            n[y] += 1
    for b, (q, p) in seen.items():
        expected = (p + q) * on / total
        if (p - expected) ** 2 / max(expected * (1 - (p + q) / (total + 1)), 1e-9) >= 15.14:
            want.add(b)
    got = set(np.flatnonzero(model.weights).tolist())
    assert len(want) > 1024 and got <= want and len(want - got) <= 0.01 * len(want)


def test_scores_do_not_depend_on_other_columns_or_rows(rows):
    docs, labels = corpus(200)
    df = rows([(i, t, "x", 0.5) for i, t in docs], "doc_id bigint, text string, label string, score double")
    model = trained(df, rows(labels, "doc_id bigint, toxic int"), F.lit(True))
    odd = rows([(None, None, None, None), (1, "", None, None), (2, "x" * 200_000, None, None), (3, "a", None, None),
                (3, "a", None, None)], "doc_id bigint, text string, label string, score double")
    got = scored(odd, model)
    assert got.columns == ["doc_id", "text", "label", "score"]
    by = {(r["doc_id"], r["text"]): r["score"] for r in got.collect()}
    assert len(by) == 4 and by[None, None] == by[1, ""] == model.score("")
    assert scored(rows([], "doc_id bigint, text string"), model).collect() == []


def test_labels_of_one_kind_none_null_or_repeated(rows):
    docs = rows([(1, "a b"), (2, "c d"), (3, None)], "doc_id bigint, text string")
    for labels in ([], [(1, 0)], [(None, 1), (2, None), (9, 1)], [(3, 1), (3, 1)]):
        model = trained(docs, rows(labels, "doc_id bigint, toxic int"), F.lit(True))
        assert 0 < model.score("a b") < 1 and not model.weights.any()
    both = fit(rows([("a", 0), ("a", 1), (None, 0)], "text string, label int"))
    assert 0 < both.score("a") < 1


def test_sample_is_bounded_and_whole_if_small(rows):
    labels = rows([(i, 0) for i in range(1000)], "doc_id bigint, toxic int")
    assert sampled(labels, F.lit(True), 2000).count() == 1000
    assert 50 < sampled(labels, F.lit(True), 100).count() < 150


def test_grams_ignore_case_and_runs_of_space():
    assert (gram_bins("Ab  c\n", 18) == gram_bins("aB c", 18)).all()
    assert len(np.unique(gram_bins("abcdefgh", 18))) == 8 + 7 + 6


def test_pieces_do_not_change_the_fit():
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 6, 80)
    columns = rng.integers(0, 12, lengths.sum()).astype(np.int32)
    y, values = (rng.random(80) < 0.4).astype(float), rng.normal(size=12)
    whole, pieces = (regression(columns, lengths, values, y, 1e-3, 60, at_once=n) for n in (10_000, 7))
    assert np.allclose(whole[0], pieces[0]) and np.isclose(whole[1], pieces[1]) and whole[0].any()
    dense = np.zeros((80, 12))
    np.add.at(dense, (np.repeat(np.arange(80), lengths), columns), values[columns])
    error = 1 / (1 + np.exp(-(dense @ whole[0] + whole[1]))) - y
    assert np.abs(dense.T @ error / 80 + 1e-3 * whole[0]).max() < 1e-2  # near the minimum
    empty = regression(columns[:0], np.zeros(4, int), np.zeros(0), np.array([0, 1, 0, 0.0]), 1e-3, 20)
    assert len(empty[0]) == 0 and np.isfinite(empty[1])
