import math

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm.multi_index import nearest, query_parts, walk

SCHEMA = "vec_id bigint, embedding array<float>, v int, score string"


def brute(data, query, k):
    q = np.asarray(dict(data)[query], dtype=np.float64)
    found = sorted((float(np.sqrt(((np.asarray(x, dtype=np.float64) - q) ** 2).sum())), i) for i, x in data if i != query)
    return [(i, d) for d, i in found[:k]]


def made(n=700, width=8):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(10, width))
    x = (centres[rng.integers(0, 10, n)] + 0.3 * rng.normal(size=(n, width))).astype(np.float32)
    x[200:500] = x[min(200, n - 1)]  # one large group of equal vectors
    return [(i, x[i].tolist()) for i in range(n)]


def test_recall_and_exact_scores(rows):
    data = made()
    got = nearest(rows([(i, x, 0, "") for i, x in data], SCHEMA), F.col("vec_id") % 50 == 0, block_rows=50, block_queries=5)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 700, 50))
    hits = 0
    for q, found in by.items():
        want = brute(data, q, 10)
        assert len(found) == 10 and found == sorted(found, key=lambda r: (r[1], r[0]))
        hits += len({i for i, _ in found} & {i for i, _ in want})
        if 200 <= q < 500:  # ties go to the smaller ids
            assert [i for i, _ in found] == [i for i, _ in want]
        for i, d in found:
            assert math.isclose(d, float(np.linalg.norm(np.float64(data[i][1]) - np.float64(data[q][1]))), abs_tol=1e-12)
    assert hits >= 0.9 * 10 * len(by)


def test_all_cells_give_the_exact_answer(rows):
    data = made(150)
    got = nearest(rows([(i, x, 0, "") for i, x in data], SCHEMA), F.col("vec_id") % 50 == 0, share=1.0, k=3)
    for q in (0, 50, 100):
        assert [r["vec_id"] for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()] == [
            i for i, _ in brute(data, q, 3)]


def test_unusable_vectors_repeats_and_few_candidates(rows):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]),
            (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = rows([(i, x, 0, "") for i, x in data], SCHEMA)
    got = nearest(df, F.col("vec_id") % 2 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)]
    assert nearest(rows([], SCHEMA), F.col("vec_id") % 2 == 0).collect() == []
    assert nearest(rows([(2, [0.0], 0, "")], SCHEMA), F.lit(True)).collect() == []


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(13)
    a, b = rng.random(6), rng.random(5)
    counts = np.ones((6, 5), dtype=int)
    for wanted in (1, 7, 30):
        cells = {(i, j) for i, js in walk(a, b, counts, wanted).items() for j in js}
        order = sorted((a[i] + b[j], i, j) for i in range(6) for j in range(5))
        assert cells == {(i, j) for _, i, j in order[:wanted]}


def test_queries_near_together_share_a_part():
    """Crowded centroids have parts of their own, and entries are copied for few parts only."""
    centres = np.array([[0.0], [10.0], [1.0], [11.0]])
    parts = query_parts(centres, [50, 450, 60, 0], 100)
    assert parts[0] == (0, 1) and parts[2] == (0, 2)  # the next centroid on the axis goes on in the part
    low, many = parts[1]
    assert low == 1 and many == 5 and all(m >= 1 for _, m in parts)
    assert query_parts(np.zeros((1, 0)), [7], 3) == [(0, 3)]


def test_parts_do_not_change_the_answer(rows):
    data = made(400)
    df = rows([(i, x, 0, "") for i, x in data], SCHEMA)
    one, many = (sorted(map(tuple, nearest(df, F.col("vec_id") % 5 == 0, k=4, share=0.3, block_rows=n,
                                           block_queries=q).collect())) for n, q in ((10_000, 10_000), (15, 3)))
    assert one == many and len({r[0] for r in one}) == 80
