"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are presences of hashed lower-case n-grams of 3 to 5 characters. Each feature's value is its
log-count ratio between toxic and other labelled texts, and a logistic regression weighs these values.
The classifier is fitted on a bounded sample of labelled rows; presences and counts are found by Spark,
and the driver gets one count per hash bin and the chosen features of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import mix, only, powers, saved
from emberlog.session import ship


def gram_bins(text: str, bits: int, sizes: tuple[int, ...] = (3, 4, 5)) -> np.ndarray:
    """Hash bins of all character n-grams of a text, repeats and all; white-space runs are one space."""
    flat = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out, p = [], powers(max(sizes) + 1)
    for n in sizes:
        if len(c) >= n:
            h = c[: len(c) - n + 1] * p[1]
            for j in range(1, n):
                h = h + c[j: len(c) - n + 1 + j] * p[j + 1]
            out.append(mix(h + np.uint64(n)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


@dataclass
class Classifier:
    """The weight of each hash bin (0 where a bin isn't a feature) and the intercept."""

    bits: int
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        """Probability of label 1; an empty text has no n-gram of its own."""
        bins = gram_bins(text, self.bits)
        bins = bins[self.weights[bins] != 0]
        total = self.intercept + (self.weights[np.unique(bins)].sum() if len(bins) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def regression(columns: np.ndarray, lengths: np.ndarray, values: np.ndarray, y: np.ndarray,
               penalty: float, rounds: int, at_once: int = 1 << 19) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by accelerated gradient descent with backtracking.

    `columns` are the features of all rows one after the other, `lengths` their numbers per row, and
    `values` the value each feature has where it occurs. Rows are passed in pieces of about `at_once` entries.
    """
    n, n_features = len(y), len(values)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], at_once)), [0, n]))
    pieces = [(a, b, columns[ends[a]:ends[b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    w, b = np.zeros(n_features), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, vb, step, momentum = w.copy(), b, 1.0, 1.0

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        scaled = values * w
        z = np.concatenate([np.bincount(np.repeat(np.arange(hi - lo), lengths[lo:hi]), weights=scaled[c],
                                        minlength=hi - lo) for lo, hi, c in pieces]) + b
        return float((np.logaddexp(0, z) - y * z).sum() / n + penalty / 2 * (w * w).sum()), z

    for _ in range(rounds):
        at, z = loss(v, vb)
        error = (1 / (1 + np.exp(-z)) - y) / n
        g = penalty * v
        for lo, hi, c in pieces:
            g += values * np.bincount(c, weights=np.repeat(error[lo:hi], lengths[lo:hi]), minlength=n_features)
        gb = float(error.sum())
        norm = float((g * g).sum()) + gb * gb
        while step > 1e-6 and loss(v - step * g, vb - step * gb)[0] > at - step / 2 * norm:
            step /= 2
        nw, nb = v - step * g, vb - step * gb
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        v, vb = nw + (momentum - 1) / following * (nw - w), nb + (momentum - 1) / following * (nb - b)
        w, b, momentum, step = nw, nb, following, step * 1.1
    return w, b


def fit(labelled: DataFrame, text: str = "text", label: str = "label", *, bits: int = 18,
        critical: float = 15.14, smoothing: float = 1.0, penalty: float = 1e-4, rounds: int = 120
        ) -> Classifier:
    """Fit on labelled texts; give it a bounded number of rows.

    Every bin whose presence depends on the label is a feature, however many there are: those with a
    chi-square statistic of at least `critical` (15.14: one degree of freedom, one in 10 000 by chance).
    Rows without a label are left out, null and empty texts have no n-grams, repeated rows count each
    time. Without rows of both labels, and in an empty table, the score of every text is the smoothed
    share of label 1.
    """
    ship(labelled.sparkSession)
    given = saved(labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"),
                                  F.col(label).cast("int").alias("y")).filter("y IN (0, 1)"), "labelled")

    def presences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            for t, y in zip(batch["text"], batch["y"]):
                n[y, np.unique(gram_bins(t, bits))] += 1
        at = np.flatnonzero(n.sum(0))
        yield pd.DataFrame({"bin": at, "off": n[0, at], "on": n[1, at]})

    y_counts = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    off, on = y_counts.get(0, 0), y_counts.get(1, 0)
    weights = np.zeros(1 << bits)
    if not off or not on:
        return Classifier(bits, weights, float(np.log((on + 1) / (off + 1))))
    counts = given.mapInPandas(presences, "bin bigint, off bigint, on bigint").groupBy("bin").agg(
        F.sum("off").alias("off"), F.sum("on").alias("on")).toPandas().sort_values("bin")
    bins = counts["bin"].to_numpy()
    q, p = counts["off"].to_numpy().astype(float), counts["on"].to_numpy().astype(float)
    expected = (p + q) * on / (on + off)
    chi = (p - expected) ** 2 / np.maximum(expected * (1 - (p + q) / (on + off + 1)), 1e-9)
    chosen = np.flatnonzero(chi >= critical)
    ratio = np.log((p + smoothing) / (p + smoothing).sum()) - np.log((q + smoothing) / (q + smoothing).sum())
    number = np.full(1 << bits, -1, dtype=np.int64)
    number[bins[chosen]] = np.arange(len(chosen))

    def chosen_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [number[np.unique(gram_bins(t, bits))] for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "f": [x[x >= 0].astype("<i4").tobytes() for x in found]})

    sample = given.mapInPandas(chosen_features, "y int, f binary").toPandas()
    lengths = sample["f"].map(len).to_numpy() // 4
    columns = np.frombuffer(b"".join(sample.pop("f")), dtype="<i4")
    values = ratio[chosen]
    w, b = regression(columns, lengths, values, sample["y"].to_numpy().astype(float), penalty, rounds)
    weights[bins[chosen]] = w * values
    return Classifier(bits, weights, b)


def sampled(labels: DataFrame, use: Column, rows: int, id: str = "doc_id", seed: int = 3) -> DataFrame:
    """About `rows` of the usable labels, by a seeded hash of the id; all of them if there are fewer."""
    usable = labels.filter(use & F.col(id).isNotNull())
    n = usable.count()
    kept = usable if n <= rows else usable.filter(
        F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(n)) < rows)
    return kept


def trained(docs: DataFrame, labels: DataFrame, use: Column, *, id: str = "doc_id", text: str = "text",
            label: str = "toxic", sample_rows: int = 20_000, **options) -> Classifier:
    """A classifier from the labelled documents of which `use`, a condition on the id, is true.

    At most about `sample_rows` labels are used: with that bound they are broadcast, and the texts are
    not shuffled. A document with contradicting labels counts with each of them, repeated documents
    count each time; null ids and labels take no part.
    """
    small = sampled(only(labels, id, label).toDF("doc_id", "label").filter(
        F.col("label").isNotNull()).distinct(), use, sample_rows)
    rows = only(docs, id, text).toDF("doc_id", "text").join(F.broadcast(small), "doc_id")
    return fit(rows, **options)


def scored(docs: DataFrame, model: Classifier, text: str = "text", score: str = "score") -> DataFrame:
    """All columns and the score of the whole text; a column of that name is replaced.

    Null and empty texts get the score of a text without features, equal texts equal scores, and an
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per hash bin

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.score(t or "") for t in texts], dtype=float)

    return docs.withColumn(score, score_of(F.col(f"`{text}`")))
