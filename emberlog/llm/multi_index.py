"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors get their own codebook; a vector's cell is the pair of its nearest centroids.
A query walks through cells by the sum of its two squared centroid distances, kept in a heap, until the
cells it has seen hold a stated share of all entries, and every entry in them is ranked by its exact
distance. The codebooks are fitted on a bounded sample; every row is indexed.

Entries are kept by first centroid, cut into blocks of bounded size, and meet blocks of queries in one
cogrouped shuffle, each entry in the blocks whose queries come near it: nothing is broadcast but the
codebooks, one count per cell and the blocks per first centroid.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from emberlog.llm.common import numbered, only, saved
from emberlog.session import ship

NEIGHBOURS = "query_id bigint, rank int, vec_id bigint, score double"


def usable(vector: str) -> Column:
    """True for vectors with only finite components of which one is not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def centroids_of(points: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's k-means; fewer distinct points than centroids leave repeated centroids out."""
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    centres = points[np.sort(np.random.default_rng(seed).choice(len(points), k, replace=False))]
    for _ in range(rounds):
        near = squared(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by the inner-product form; good enough to choose cells, not to rank."""
    return (points ** 2).sum(1)[:, None] - 2 * points @ centres.T + (centres ** 2).sum(1)[None]


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> dict[int, list]:
    """Cells by summed distance until they hold `wanted` entries: first centroid -> second centroids."""
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[by_first[0]] + second[by_second[0]], 0, 0)]
    held, cells = 0, {}
    while heap and held < wanted:
        _, a, b = heapq.heappop(heap)
        i, j = int(by_first[a]), int(by_second[b])
        if counts[i, j]:
            held += int(counts[i, j])
            cells.setdefault(i, []).append(j)
        if a + 1 < len(by_first) and b == 0:
            heapq.heappush(heap, (first[by_first[a + 1]] + second[by_second[0]], a + 1, 0))
        if b + 1 < len(by_second):
            heapq.heappush(heap, (first[i] + second[by_second[b + 1]], a, b + 1))
    return cells


def query_parts(centres: np.ndarray, queries: list[int], size: int) -> list[tuple[int, int]]:
    """Per centroid the first part its queries go to and how many they fill: of about `size` queries each.

    Centroids take their parts in the order of their places on the principal axis, so that queries of one
    part lie close together and ask for few cells; a crowded centroid has parts of its own.
    """
    spread = centres - centres.mean(0)
    axis = np.linalg.svd(spread, full_matrices=False)[2][0] if centres.shape[1] else np.zeros(0)
    parts, before = [(0, 1)] * len(centres), 0
    for i in np.argsort(spread @ axis, kind="stable"):
        low, high = before // size, max(before, before + queries[i] - 1) // size
        parts[i] = (low, high - low + 1)
        before += queries[i]
    return parts


def nearest(vectors: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", *,
            k: int = 10, centroids: int | None = None, share: float = 0.8, sample_rows: int = 20_000,
            block_rows: int = 20_000, block_queries: int = 2_000, seed: int = 7) -> DataFrame:
    """The k nearest entries found for each query row: query_id, rank from 1, vec_id, score.

    `is_query` is a condition on the id column. `share` of the entries is ranked per query (0.8 suits
    vectors without any structure; clustered ones need far less). `centroids` per half are by default the
    fourth root of the number of entries, at least 32. Rows without an id, repeated rows, and
    vectors that are null, zero, hold null or non-finite components, or have another length than most
    take no part. Of equal vectors only the k + 1 smallest ids are entries: no other can be among the k
    nearest, as ties go to the smaller id. A query is never its own neighbour. Fewer candidates than k
    give fewer rows; an empty table gives none.
    """
    spark = ship(vectors.sparkSession)
    rows = only(vectors, id, vector).toDF("vec_id", "v").filter(
        F.col("vec_id").isNotNull() & usable("v")).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], NEIGHBOURS)
    width = lengths["n"]
    half = max(1, width // 2)
    rows = rows.filter(F.size("v") == width).withColumn(
        "same", F.unhex(F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)))
    rows = rows.dropDuplicates(["vec_id", "same"])
    placed = numbered(rows, ["same", "vec_id"], name="vectors")
    groups = placed.groupBy("same").agg(F.min("position").alias("at"), F.count("*").alias("n"))
    large = groups.filter(F.col("n") > k + 1).select("same", "at")
    entries = placed.join(large, "same", "left").filter(
        F.coalesce(F.col("position") - F.col("at") <= k, F.lit(True))).select("vec_id", "v")

    total = entries.count()
    centroids = centroids or max(32, round(total ** 0.25))
    sample = entries.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(total)) < sample_rows)
    points = np.array([r["v"] for r in sample.select("v").collect()] or
                      [r["v"] for r in entries.select("v").take(centroids)], dtype=np.float64)
    books = [centroids_of(points[:, :half], centroids, seed),
             centroids_of(points[:, half:], centroids, seed + 1) if width > half else np.zeros((1, 0))]

    @F.pandas_udf("struct<i:int,j:int>")
    def cell(v: pd.Series) -> pd.DataFrame:
        x = np.array(v.tolist(), dtype=np.float64).reshape(-1, width)
        return pd.DataFrame({"i": squared(x[:, :half], books[0]).argmin(1),
                             "j": squared(x[:, half:], books[1]).argmin(1)})

    indexed = saved(entries.withColumn("c", cell("v")).select("vec_id", "v", "c.i", "c.j"), "cells")
    counts = np.zeros((len(books[0]), len(books[1])), dtype=np.int64)
    for r in indexed.groupBy("i", "j").count().collect():  # at most centroids squared
        counts[r["i"], r["j"]] = r["count"]
    blocks = {i: max(1, -(-int(n) // block_rows)) for i, n in enumerate(counts.sum(1))}
    queries = saved(placed.filter(is_query).select("vec_id", "v", cell("v")["i"].alias("own")), "queries")
    near = {r["own"]: r["count"] for r in queries.groupBy("own").count().collect()}  # one per centroid
    parts = query_parts(books[0], [near.get(i, 0) for i in range(len(books[0]))], block_queries)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["v"].tolist(), dtype=np.float64).reshape(-1, width)
            first, second = squared(x[:, :half], books[0]), squared(x[:, half:], books[1])
            out = []
            for n, (q, v, own) in enumerate(zip(batch["vec_id"], batch["v"], batch["own"])):
                low, many = parts[own]
                out += [(q, v, i, low + q % many, js) for i, js in walk(
                    first[n], second[n], counts, max(share * total, k + 1)).items()]
            yield pd.DataFrame(out, columns=["vec_id", "v", "i", "part", "js"])

    walked = saved(queries.mapInPandas(ask, "vec_id bigint, v array<double>, i int, part int, js array<int>"),
                   "walked")
    per_first = F.create_map(*[F.lit(x) for i, n in blocks.items() for x in (i, n)])
    asked = walked.withColumn("block", F.explode(F.sequence(F.lit(0), per_first[F.col("i")] - 1)))
    # entries are copied to the parts whose queries come to their centroid: a list per centroid, with one
    # number for every `block_queries` queries at most
    wanted = F.broadcast(walked.select("i", "part").distinct().groupBy("i").agg(
        F.collect_list("part").alias("parts")))
    stored = indexed.join(wanted, "i").withColumn("block", F.pmod(F.xxhash64("vec_id"), per_first[F.col(
        "i")]).cast("int")).withColumn("part", F.explode("parts")).drop("parts")

    def rank(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(have) and len(want):
            x, ids = np.array(have["v"].tolist()).reshape(-1, width), have["vec_id"].to_numpy()
            cells = have["j"].to_numpy()
            for q, v, js in zip(want["vec_id"], want["v"], want["js"]):
                seen = np.zeros(counts.shape[1], dtype=bool)
                seen[np.asarray(js)] = True
                at = np.flatnonzero(seen[cells] & (ids != q))
                d = np.sqrt(((x[at] - np.asarray(v)) ** 2).sum(1))
                if len(at) > k:
                    close = d <= np.partition(d, k - 1)[k - 1]
                    at, d = at[close], d[close]
                best = np.lexsort((ids[at], d))[:k]
                out += [(q, ids[at[b]], d[b]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = stored.groupBy("i", "block", "part").cogroup(
        asked.groupBy("i", "block", "part")).applyInPandas(
        rank, "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
