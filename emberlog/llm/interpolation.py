"""Language-model scores by deleted interpolation of word bigrams, words and the uniform distribution.

Maximum-likelihood estimates are mixed with weights that depend on how often the context was seen, and
the weights are learned by expectation-maximisation on a part of the training documents whose own counts
are deleted from the estimates.

Counts travel in bulk. Tasks gather documents into batches of some million tokens and keep each batch as
numbers into its list of distinct words. Every batch sends its distinct words and bigrams, pre-counted, to
ranges of the hash space, one row per batch and range; each range adds up its counts and sends every batch
its answers in the same order, and the batch looks its tokens up. So a frequent word is sent once per
batch, texts are never shuffled, and nothing but sums and a histogram of bounded size reaches the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import mix, saved, word_hashes
from emberlog.session import ship

#: Hashes that stand for the start and the end of a text.
START, END = np.uint64(1), np.uint64(2)
#: Contexts seen at least 2^39 times share a bucket.
BUCKETS = 41
#: Learned, learned and tuned with, only scored.
LEARN, TUNE, ONLY_SCORE = 0, 1, 2


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses well if most are small."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def narrow(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as a width and their differences in so many bytes."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(
        steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(data: bytes) -> np.ndarray:
    width = data[0]
    part = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(part), 8), dtype=np.uint8)
    full[:, :width] = part
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


class Batch:
    """Documents of one batch: their ids, parts and lengths, and their tokens as numbers of words."""

    def __init__(self, ids: list, parts: np.ndarray, lengths: np.ndarray, tokens: np.ndarray,
                 keys: np.ndarray) -> None:
        self.ids, self.parts, self.lengths, self.tokens, self.keys = ids, parts, lengths, tokens, keys
        self.first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        before = np.empty(len(tokens), dtype=np.int64)
        before[1:] = tokens[:-1]
        before[self.first] = len(keys)  # START, kept behind the words
        self.before = before
        self.part = np.repeat(parts, lengths)

    @classmethod
    def of_row(cls, row: dict) -> Batch:
        return cls(row["ids"], np.frombuffer(row["parts"], np.int8), np.frombuffer(row["lengths"], "<u4").astype(
            np.int64), from_planes(row["tokens"]).astype(np.int64), np.frombuffer(row["keys"], "<u8"))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the words and START, and the place of each word number among them."""
        keys = np.concatenate([self.keys, [START]])
        order = np.argsort(keys)
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], place

    def pairs(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the bigrams, and the place of each token's bigram among them."""
        keys = np.concatenate([self.keys, [START]])
        h = mix(keys[self.before] * np.uint64(0x9E3779B97F4A7C15) + keys[self.tokens])
        return np.unique(h >> np.uint64(shift) << np.uint64(shift), return_inverse=True)

    def word_counts(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys and their counts in the documents to learn from and to tune with; START counts texts."""
        keys, place = self.words()
        counts = []
        for part in (LEARN, TUNE):
            n = np.bincount(place[self.tokens[self.part == part]], minlength=len(keys))
            n[place[-1]] += int((self.parts == part).sum())
            counts.append(n)
        return keys, counts

    def pair_counts(self, shift: int) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, place = self.pairs(shift)
        return keys, [np.bincount(place[self.part == p], minlength=len(keys)) for p in (LEARN, TUNE)]


def batches(docs: DataFrame, part: Column, id: str, text: str, batch_tokens: int) -> DataFrame:
    """One row per batch. Documents to tune with have batches of their own."""
    def work(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, {False: [], True: []}
        tokens = {False: 0, True: 0}

        def row(tune: bool) -> pa.RecordBatch:
            nonlocal number
            ids, parts, hashed = zip(*held[tune])
            keys, token, counts = np.unique(np.concatenate(hashed), return_inverse=True, return_counts=True)
            frequent = np.argsort(-counts, kind="stable")  # small numbers for frequent words
            rank = np.empty(len(keys), dtype=np.int64)
            rank[frequent] = np.arange(len(keys))
            values = [number, tune, len(token), list(ids), np.array(parts, np.int8).tobytes(),
                      np.array([len(h) for h in hashed], "<u4").tobytes(), planes(rank[token]),
                      keys[frequent].astype("<u8").tobytes()]
            number += 1
            held[tune], tokens[tune] = [], 0
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[
                "batch", "tune", "n", "ids", "parts", "lengths", "tokens", "keys"])

        for batch in arrived:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                for doc, part, text in zip(*(c.to_pylist() for c in some.columns)):
                    hashes, _ = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
                    tune = part == TUNE
                    held[tune].append((doc, part, np.append(hashes, END)))
                    tokens[tune] += len(hashes) + 1
                    if tokens[tune] >= batch_tokens:
                        yield row(tune)
        for tune in (False, True):
            if held[tune]:
                yield row(tune)

    given = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), part.cast("tinyint").alias("part"),
                        F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(work, "batch bigint, tune boolean, n bigint, ids array<bigint>, parts binary, "
                                  "lengths binary, tokens binary, keys binary")


def by_range(keys: np.ndarray, bounds: np.ndarray) -> dict[int, slice]:
    """The places of sorted keys per range that holds any; `bounds` are the starts of the ranges."""
    held, first = np.unique(np.searchsorted(bounds, keys, side="right") - 1, return_index=True)
    last = np.append(first[1:], len(keys))
    return {int(r): slice(int(a), int(b)) for r, a, b in zip(held, first, last)}


def counted(gathered: DataFrame, ranges: int, shift: int) -> DataFrame:
    """Answers: batch, range, tune, counts of its words and bigrams there (by part), and sums of the range."""
    bounds = np.array([(r << 64) // ranges for r in range(ranges)], dtype=np.uint64)

    def ask(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            for row in batch.to_pylist():
                b, out = Batch.of_row(row), defaultdict(list)
                lists = []
                for keys, n in (b.word_counts(), b.pair_counts(shift)):
                    lists.append((keys, *n, by_range(keys, bounds)))
                for r in sorted(set().union(*(places for *_, places in lists))):  # no step for an empty range
                    out["range"].append(r)
                    out["batch"].append(row["batch"])
                    out["tune"].append(row["tune"])
                    for name, (k, l, t, places) in zip(("word", "pair"), lists):
                        at = places.get(r, slice(0, 0))
                        out[name].append(narrow((k[at] - bounds[r]) >> np.uint64(shift if name == "pair" else 0)))
                        out[f"{name}_learn"].append(planes(l[at]))
                        out[f"{name}_tune"].append(planes(t[at]))
                yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for (n, v), k in zip(
                    out.items(), [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 6])})

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = {k: [r[k] for r in rows] for k in ("batch", "range", "tune")}
        sums = [0, 0, 0, 0]
        for name in ("word", "pair"):
            keys = [widen(r[name]) for r in rows]
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            per_part = []
            for part in ("learn", "tune"):
                n = np.concatenate([from_planes(r[f"{name}_{part}"]) for r in rows])
                total = np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64)
                per_part.append(total)
                out[f"{name}_{part}"] = [planes(x) for x in np.split(total[place], cuts)]
            if name == "word":
                real = distinct + bounds[rows[0]["range"]] != START
                learn, both = per_part[0][real], (per_part[0] + per_part[1])[real]
                sums = [int(learn.sum()), int((learn > 0).sum()), int(both.sum()), int((both > 0).sum())]
        for i, s in enumerate(sums):
            out[f"s{i}"] = [s] + [0] * (len(rows) - 1)
        kinds = [pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 4, *[pa.int64()] * 4]
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds)})

    asked = gathered.mapInArrow(ask, "range int, batch bigint, tune boolean, word binary, word_learn binary, "
                                     "word_tune binary, pair binary, pair_learn binary, pair_tune binary")
    return asked.groupBy("range").applyInArrow(
        answer, "batch bigint, range int, tune boolean, word_learn binary, word_tune binary, "
                "pair_learn binary, pair_tune binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def looked_up(rows: pa.Table, answers: pa.Table, shift: int, tuning: bool) -> tuple[Batch, np.ndarray, ...]:
    """A batch and, per token, the counts of its word, its context and its bigram.

    While tuning, only what was learned without the tuning documents counts.
    """
    b = Batch.of_row(rows.to_pylist()[0])
    told = sorted(answers.to_pylist(), key=lambda r: r["range"])
    count = {}
    for name in ("word", "pair"):
        learn = np.concatenate([from_planes(r[f"{name}_learn"]) for r in told]).astype(np.int64)
        tune = np.concatenate([from_planes(r[f"{name}_tune"]) for r in told]).astype(np.int64)
        count[name] = learn if tuning else learn + tune
    _, word_place = b.words()
    _, pair_place = b.pairs(shift)
    return (b, count["word"][word_place[b.tokens]], count["word"][word_place[b.before]],
            count["pair"][pair_place])


def context_bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else the number of binary digits of their count."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def learned_weights(cells: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Mixture weights (bigram, word, uniform) by context bucket, by expectation-maximisation.

    `cells` are rows of bucket, quarter binary logarithms of the bigram's and the word's estimate over the
    uniform one (-1000 for an estimate of zero), and a number of tokens. A bucket without tokens takes the
    weights of all tokens together; unseen contexts have no bigram estimate.
    """
    bucket, n = cells[:, 0].astype(int), cells[:, 3].astype(float)
    odds = np.stack([np.where(cells[:, i] <= -1000, 0.0, np.exp2(cells[:, i] / 4)) for i in (1, 2)]
                    + [np.ones(len(cells))], axis=1)

    def maximised(bucket: np.ndarray, size: int) -> np.ndarray:
        w = np.full((size, 3), 1 / 3)
        for _ in range(rounds):
            share = w[bucket] * odds
            share *= (n / share.sum(1))[:, None]
            sums = np.stack([np.bincount(bucket, share[:, i], minlength=size) for i in range(3)], axis=1)
            w = np.where(sums.sum(1, keepdims=True) > 0, sums / np.maximum(sums.sum(1, keepdims=True), 1e-300), w)
            w = np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum(1, keepdims=True)
        return w

    pooled = maximised(np.zeros(len(bucket), dtype=int), 1)[0] if len(cells) else np.full(3, 1 / 3)
    weights = maximised(bucket, BUCKETS) if len(cells) else np.tile(pooled, (BUCKETS, 1))
    weights[~np.isin(np.arange(BUCKETS), bucket)] = pooled
    weights[0] = [0, weights[0][1] / weights[0][1:].sum(), weights[0][2] / weights[0][1:].sum()]
    return weights


def scored(docs: DataFrame, part: Column, id: str = "doc_id", text: str = "text", *,
           batch_tokens: int = 1 << 21, range_tokens: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `part` says for each document if it is learned from (0), learned from and used to find the mixture
    weights (1), or only scored (2, held_out). Texts are lower-cased (A-Z), cut into words at white space,
    and closed by an end token; null is the empty text, whose only token is that end. `base_score` is the
    log10 probability under words alone with 0.1 added to every count, `score` that of the mixture. Words
    are told apart by 64-bit hashes, bigrams by 48 bits and their range. Repeated rows count repeatedly;
    an empty table gives no rows.
    """
    ship(docs.sparkSession)
    gathered = saved(batches(docs, part, id, text, batch_tokens), "batches")
    total = gathered.agg(F.sum("n")).first()[0] or 0
    ranges = max(64, -(-total // range_tokens))
    shift = max(0, 16 - ranges.bit_length() + 1)
    answers = saved(counted(gathered, ranges, shift), "counts")
    n_learn, v_learn, n_all, v_all = [x or 0 for x in answers.agg(
        *[F.sum(f"s{i}") for i in range(4)]).first()]

    def estimates(word: np.ndarray, context: np.ndarray, pair: np.ndarray, n: int, v: int
                  ) -> tuple[np.ndarray, np.ndarray, float]:
        return pair / np.maximum(context, 1), word / max(n, 1), 1 / (v + 1)

    def histogram(rows: pa.Table, told: pa.Table) -> pa.Table:
        b, word, context, pair = looked_up(rows, told, shift, True)
        two, one, zero = estimates(word, context, pair, n_learn, v_learn)
        with np.errstate(divide="ignore"):
            cell = [np.where(p > 0, np.rint(4 * np.log2(p / zero)), -1000).astype(np.int64) for p in (two, one)]
        cells, n = np.unique(np.stack([context_bucket(context), *cell], axis=1), axis=0, return_counts=True)
        return pa.table({"bucket": pa.array(cells[:, 0], pa.int64()), "two": pa.array(cells[:, 1], pa.int64()),
                         "one": pa.array(cells[:, 2], pa.int64()), "n": pa.array(n, pa.int64())})

    inputs = gathered.select("batch", "ids", "parts", "lengths", "tokens", "keys", "tune")
    replies = answers.select("batch", "range", "tune", "word_learn", "word_tune", "pair_learn", "pair_tune")
    cells = inputs.filter("tune").groupBy("batch").cogroup(replies.filter("tune").groupBy("batch")).applyInArrow(
        histogram, "bucket bigint, two bigint, one bigint, n bigint").groupBy("bucket", "two", "one").agg(
        F.sum("n").alias("n")).collect()  # buckets times steps of two logarithms, whatever the input
    weights = learned_weights(np.array([tuple(r) for r in sorted(cells)], dtype=np.int64).reshape(-1, 4))

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        b, word, context, pair = looked_up(rows, told, shift, False)
        two, one, zero = estimates(word, context, pair, n_all, v_all)
        w = weights[context_bucket(context)]
        mixed = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] * zero)
        base = np.log10((word + 0.1) / (n_all + 0.1 * (v_all + 1)))
        return pa.table({
            "doc_id": pa.array(b.ids, pa.int64()),
            "held_out": pa.array(b.parts == ONLY_SCORE, pa.bool_()),
            "n_tokens": pa.array(b.lengths, pa.int64()),
            "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), b.first), pa.int64()),
            "train_tokens": pa.array(np.full(len(b.ids), n_all), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, b.first), pa.float64()),
            "score": pa.array(np.add.reduceat(mixed, b.first), pa.float64())})

    return inputs.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
               "base_score double, score double")
