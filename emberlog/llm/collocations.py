"""Phrase collocations by top-order marginalisation.

Each word opens one window: itself and the next words of its piece as lead columns, five in all, padded
with nulls after the piece's end. Only these longest windows are counted; Spark's ROLLUP over the lead
columns sums them to the frequencies of all shorter phrases, as every occurrence of a phrase is the head of
exactly one window. So n-grams of each length aren't exploded on their own.

Most windows belong to no phrase that is frequent enough. A first pass counts words and word pairs in a
table of fixed size, a second one the longer heads of windows whose words and pairs may be frequent. A
bin's count is at least that of each phrase in it, so where a bin stays under the bound, no candidate or
part of one begins with that head, and a window is padded from there on. This loses nothing, however full
the bins are; it only makes rows fewer.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from emberlog.llm.common import BINS, full_bins, is_set, mix, only, powers, saved
from emberlog.session import ship

#: What ends a piece: . , ; : ! ? and U+000A to U+000D; words in it are parted by space and tab.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(10, 14)]] = True
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[*b" \t"]] = True
#: Bytes of text taken at once, windows gathered before they are passed on, and buckets of phrases.
SEGMENT, HELD, BUCKETS = 1 << 21, 400_000, 256


def segments(texts: list[bytes]) -> Iterator[bytes]:
    """The texts joined by line feeds, lower-cased (A-Z), in parts of about SEGMENT bytes cut at piece ends."""
    held, size = [], 0
    for text in texts:
        at = 0
        while len(text) - at > SEGMENT:
            piece = np.frombuffer(text, dtype=np.uint8)[at:at + SEGMENT]
            ends = np.flatnonzero(BREAKS[piece])
            if len(ends):
                cut = at + int(ends[-1]) + 1
            else:  # a piece longer than a segment stays whole
                rest = BREAKS[np.frombuffer(text, dtype=np.uint8)[at + SEGMENT:]]
                cut = at + SEGMENT + int(rest.argmax()) + 1 if rest.any() else len(text)
            yield text[at:cut].lower()
            at = cut
        held.append(text[at:])
        size += len(text) - at
        if size > SEGMENT:
            yield b"\n".join(held).lower()
            held, size = [], 0
    if held:
        yield b"\n".join(held).lower()


def parsed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, and whether the next word is in the same piece."""
    b = np.frombuffer(data, dtype=np.uint8)
    breaks = BREAKS[b]
    inside = ~(breaks | BLANKS[b])
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letters = b[inside].astype(np.uint64) + np.uint64(1)
    letters *= powers(int(lengths.max()))[np.arange(len(letters)) - np.repeat(first, lengths)]
    hashes = mix(np.add.reduceat(letters, first))
    passed = np.concatenate([[0], np.cumsum(breaks)])
    same = np.zeros(len(starts), dtype=bool)
    same[:-1] = passed[starts[1:]] == passed[ends[:-1]]
    return starts, ends, hashes, same


def bins_of(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Bins of hashes, in a group's own way."""
    return (mix(hashes ^ mix(np.array([salt], dtype=np.uint64))) & np.uint64(BINS - 1)).astype(np.int64)


def heads(hashes: np.ndarray, same: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length from 2: its number of words, the hashes of the heads of all windows, and which exist.

    The second and third array are as long as `hashes`; the caller may clear places of the third, and the
    longer heads there won't exist then.
    """
    head, there, p = hashes, same.copy(), powers(3)
    for words in range(2, longest + 1):
        lead = np.concatenate([hashes[words - 1:], np.zeros(min(words - 1, len(hashes)), dtype=np.uint64)])
        head = head * p[1] + lead * p[2] + np.uint64(words)
        yield words, mix(head), there
        there = there & np.concatenate([same[words - 1:], np.zeros(min(words - 1, len(same)), dtype=bool)])


def _by_group(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    """Texts of a batch by group."""
    groups: dict[str, list[bytes]] = {}
    for group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text:
            groups.setdefault(group, []).append(text)
    return groups


def _salt(group: str) -> int:
    """A number per group, the same in every process."""
    return int(np.frombuffer(group.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64).dot(
        powers(len(group.encode("utf-8", "surrogatepass")) + 1)[1:])) if group else 1


def frequent_bins(rows: DataFrame, least: int, longest: int = 2, pairs: np.ndarray | None = None) -> np.ndarray:
    """One bit per bin: whether the words and pairs in it come to `least` or more over all rows.

    With the bits of words and pairs, those of longer heads up to `longest` words: only heads of words and
    pairs whose bits are set are counted.
    """
    shared = None if pairs is None else rows.sparkSession.sparkContext.broadcast(pairs)  # one bit per bin

    def found(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for group, texts in _by_group(batch).items():
            salt = _salt(group)
            for data in segments(texts):
                _, _, hashes, same = parsed(data)
                if not len(hashes):
                    continue
                if shared is None:
                    yield bins_of(hashes, salt)
                    _, pair, there = next(heads(hashes, same, 2))
                    yield bins_of(pair[there], salt)
                    continue
                for words, head, there in heads(hashes, linked(hashes, same, salt, shared.value)[1], longest):
                    if words > 2:
                        yield bins_of(head[there], salt)

    return full_bins(rows, found, least)


def linked(hashes: np.ndarray, same: np.ndarray, salt: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words may be frequent, and which of them may be with the next word of their piece."""
    known = is_set(bits, bins_of(hashes, salt))
    _, pair, there = next(heads(hashes, same, 2))
    return known, there & known & np.append(known[1:], False) & is_set(bits, bins_of(pair, salt))


def windows(rows: DataFrame, pairs: np.ndarray, longer: np.ndarray, longest: int) -> DataFrame:
    """lang, phrase and n: longest windows, each padded from the first head that is too rare.

    `pairs` and `longer` are the two results of `frequent_bins`. Every word occurrence is in exactly one
    window, so that their sum is the number of words; a window whose own word is too rare is the empty
    phrase. Tasks count alike windows and pass them on packed, one row per lang and bucket of phrases; the
    same windows of all tasks meet in a bucket.
    """
    shared = rows.sparkSession.sparkContext.broadcast((pairs, longer))  # one bit per bin

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for group, counter in counts.items():
                packed: dict[int, tuple[list, list]] = {}
                for phrase, n in counter.items():
                    phrases, numbers = packed.setdefault(zlib.crc32(phrase) % BUCKETS, ([], []))
                    phrases.append(phrase)
                    numbers.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(packed), pa.string()), pa.array(list(packed), pa.int32()),
                     pa.array([x[0] for x in packed.values()], pa.list_(pa.binary())),
                     pa.array([x[1] for x in packed.values()], pa.list_(pa.int64()))],
                    names=["lang", "bucket", "phrases", "counts"])
            counts.clear()

        for batch in batches:
            for group, texts in _by_group(batch).items():
                salt, counter = _salt(group), counts.setdefault(group, Counter())
                for data in segments(texts):
                    starts, ends, hashes, same = parsed(data)
                    if not len(starts):
                        continue
                    known, goes_on = linked(hashes, same, salt, shared.value[0])
                    length = known.astype(np.int64)
                    for words, head, there in heads(hashes, goes_on, longest):
                        at = np.flatnonzero(there)
                        if words > 2:
                            frequent = is_set(shared.value[1], bins_of(head[at], salt))
                            there[at[~frequent]] = False
                            at = at[frequent]
                        length[at] = words
                    counter[b""] += int((length == 0).sum())
                    one, more = np.flatnonzero(length == 1), np.flatnonzero(length > 1)
                    counter.update([data[s:e] for s, e in zip(starts[one].tolist(), ends[one].tolist())])
                    last = ends[more + length[more] - 1]
                    counter.update([b" ".join(data[s:e].split()) for s, e in zip(starts[more].tolist(), last.tolist())])
                    if (held := sum(map(len, counts.values()))) > HELD:
                        yield from flush()
                        counter = counts.setdefault(group, Counter())
        if counts:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}
        for batch in batches:
            for group, phrases, numbers in zip(*(batch.column(c) for c in (0, 2, 3))):
                total = sums.setdefault(group.as_py(), Counter())
                for phrase, n in zip(phrases.values.to_pylist(), numbers.values.to_pylist()):
                    total[phrase] += n
        for group, total in sums.items():
            phrases, numbers = list(total), list(total.values())
            for at in range(0, len(phrases), 10_000):
                part = phrases[at:at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(part), pa.string()), pa.array(part, pa.binary()),
                     pa.array(numbers[at:at + 10_000], pa.int64())], names=["lang", "phrase", "n"])

    packed = rows.mapInArrow(work, "lang string, bucket int, phrases array<binary>, counts array<bigint>")
    return packed.repartition("lang", "bucket").mapInArrow(add, "lang string, phrase binary, n bigint").select(
        "lang", F.col("phrase").cast("string").alias("phrase"), "n")


def frequencies(counted: DataFrame, longest: int) -> DataFrame:
    """lang, words (their number), phrase and f: ROLLUP over the lead columns of counted windows.

    Words 0 is the number of all word occurrences of a lang.
    """
    word = F.split("phrase", " ")
    leads = [f"w{k}" for k in range(1, longest + 1)]
    rows = counted.select("lang", "n", *[
        F.when(F.col("phrase") != "", F.get(word, F.lit(k))).alias(lead) for k, lead in enumerate(leads)])
    # the grouping id has a bit per lead column that is summed over: 2^k - 1 for k of them
    level = sum((F.grouping_id() == (1 << longest - k) - 1).cast("int") * k for k in range(1, longest + 1))
    rolled = rows.rollup("lang", *leads).agg(F.sum("n").alias("f"), level.alias("words"),
                                             F.grouping("lang").alias("all"))
    last = F.element_at(F.array(*leads), F.greatest(F.col("words"), F.lit(1)))
    return rolled.filter("all = 0").filter((F.col("words") == 0) | last.isNotNull()).select(
        "lang", "words", F.concat_ws(" ", *leads).alias("phrase"), "f")


def part_of(phrase: str, start: Column | int, length: Column | int) -> Column:
    """Words of a phrase, from 1."""
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def ranked(counted: DataFrame, least: int, longest: int, top: int) -> DataFrame:
    """The report from frequencies: see `collocations`."""
    known = saved(counted.filter((F.col("words") == 0) | (F.col("f") >= least)), "frequencies")
    totals = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    parts = known.filter("words > 0").select("lang", "phrase", "f")
    many = known.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = many.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", part_of("phrase", F.lit(1), F.col("k")).alias("head"),
        part_of("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    wide = "decimal(19,0)"
    exact = F.expr(f"(cast(1000 * a AS {wide}) * cast(n AS {wide})) div (cast(l AS {wide}) * cast(r AS {wide}))")
    scored = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(
        totals, "lang").withColumn("score", exact)
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = many.filter("words > 2").select("lang", "phrase", "words", "a", F.explode(
        F.sequence(F.lit(2), F.col("words") - 1)).alias("size")).select(
        "lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    covered = inner.groupBy("lang", part_of("phrase", F.col("at"), F.col("size")).alias("phrase")).agg(
        F.max("a").alias("longer"))
    left = lowest.join(covered, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a")
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", *, least: int = 100,
                 longest: int = 5, top: int = 2000, unknown: str = "und") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each lang whose words belong together most.

    Candidates are phrases of 2 to `longest` words that occur `least` times or more within pieces. The
    score of a cut after k words is floor(1000 a n / (l r)) of the frequencies of phrase and parts and the
    number of all words; the lowest-scoring cut counts, ties to the smallest k. Candidates inside a longer
    candidate that is as frequent go. Each lang's first `top` by score, frequency and phrase are returned.
    Arithmetic is exact. Null texts have no words, a null lang is `unknown`, repeated rows count each, and
    an empty table gives no rows. Other columns are left out.
    """
    if least < 1 or longest < 2:
        raise ValueError("least must be 1 or more and longest 2 or more")
    ship(docs.sparkSession)
    rows = only(docs, group, text).toDF("lang", "text").select(
        F.coalesce("lang", F.lit(unknown)).alias("lang"), F.col("text").cast("binary").alias("text"))
    pairs = frequent_bins(rows, least)
    counted = windows(rows, pairs, frequent_bins(rows, least, longest, pairs), longest)
    return ranked(frequencies(counted, longest), least, longest, top)
