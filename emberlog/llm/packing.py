"""Best-fit packing of token pieces by exact-complement hashing.

Only the number of pieces of each length matters for a packing, so the plan is made on a histogram of at
most `limit` rows: for each length, longest first, the index of single, pair and triple sums gives a
combination that fills the gap exactly, and as many sequences are closed with it as the counts allow.
What has no exact complement is packed best-fit: into the tightest open gap, else into a new sequence.

The plan is a list of runs (pieces of one length at consecutive places of a sorted order), bounded by the
limit and not by the table. Pieces are put in that order by one range shuffle, and each finds its run,
and with it its sequence and offset, by binary search.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import Memo, numbered, only, saved
from emberlog.session import ship

#: Kept per Python worker, so that tasks share what earlier tasks have encoded.
_WORKER: dict[str, WordIds] = {}


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, from a tokenizer that drops white space.

    Its pre-tokenizer never joins characters across white space, so a text's ids are those of its
    words in a row, and each distinct word is encoded once and remembered. Words of ASCII and Latin-1
    letters need no more normalising than lower case and go to the tokenizer's model part by part;
    other words go through the whole tokenizer. Texts with control characters, on some of which
    libraries disagree whether they are white space, are encoded whole.
    """

    ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]"
                       "|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes follow 255
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.coded = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.parts = Memo(self.part, 200_000)
        self.known = Memo(self.word, 300_000)

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in _WORKER:
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.letters)
        return b"".join([self.coded[t.id] for t in self.model.tokenize(spelt)])

    def word(self, word: str) -> bytes:
        lower = word.lower()
        if word.isascii():
            if word.isalpha():
                return self.parts[lower]
        elif not self.PLAIN.fullmatch(word):
            return self.whole(word).tobytes()
        return b"".join(map(self.parts.__getitem__, self.PARTS.findall(lower)))

    def encode(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self.whole(text).tobytes()
        return b"".join(map(self.known.__getitem__, text.split()))


def token_pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", *,
                 limit: int = 4096, end: int = 1, with_ids: bool = True) -> DataFrame:
    """Whole texts as token pieces: doc_id, piece, start, length, ids_crc32 and, if wanted, ids.

    Every document gets the id `end` at its end, so a null or empty text is one piece of one token. Only
    documents of more than `limit` tokens are cut, into pieces of `limit`; the last may be shorter.
    `tokenizer` is a file that every executor can open.
    """
    ship(docs.sparkSession)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (
        ", ids array<int>" if with_ids else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = WordIds.of(tokenizer), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            out = defaultdict(list)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + last
                for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                    part = ids[start * 4:(start + limit) * 4]
                    row = (doc, piece, start, len(part) // 4, zlib.crc32(part),
                           np.frombuffer(part, "<i4") if with_ids else None)
                    for name, value in zip(names, row):
                        out[name].append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[name], kind) for name, kind in zip(names, types)], names=names)

    return only(docs, id, text).mapInArrow(cut, schema)


class Complements:
    """Which sums of one, two or three available lengths there are.

    The pair index is a convolution of the lengths that were available when it was built. Lengths only
    run out, so it may name sums that are gone but never misses one; a stale entry rebuilds it.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts, self.size = counts, 2 * len(counts)
        self.build()

    def build(self) -> None:
        have = np.fft.rfft(self.counts > 0, self.size)
        self.pairs = np.rint(np.fft.irfft(have * have, self.size)).astype(np.int64) > 0

    def pair(self, total: int) -> tuple[int, ...] | None:
        """The pair with the longest member."""
        c = self.counts
        longer = np.arange(total - 1, (total - 1) // 2, -1)
        fits = (c[longer] > 0) & (c[total - longer] > (2 * longer == total))
        at = int(fits.argmax()) if len(fits) else 0
        return (int(longer[at]), total - int(longer[at])) if len(fits) and fits[at] else None

    def find(self, gap: int) -> tuple[int, ...] | None:
        c = self.counts
        if c[gap]:
            return (gap,)
        for fresh in (False, True):
            if fresh:
                self.build()
            if self.pairs[gap] and (pair := self.pair(gap)):
                return pair
            third = np.arange(gap - 2, 0, -1)
            for d in third[(c[third] > 0) & self.pairs[gap - third]].tolist():
                c[d] -= 1
                pair = self.pair(gap - d)
                c[d] += 1
                if pair:
                    return (d, *pair)
        return None


def plan(counts: np.ndarray, limit: int) -> list[tuple[Counter, int]]:
    """Sequences as (length -> number of its pieces, how many such sequences), from counts by length."""
    counts, done = counts.astype(np.int64).copy(), []
    sums = Complements(counts)
    for length in range(limit, 0, -1):
        while counts[length]:
            counts[length] -= 1
            rest = () if length == limit else sums.find(limit - length)
            counts[length] += 1
            if rest is None:
                break
            need = Counter([length, *rest])
            times = min(int(counts[x]) // n for x, n in need.items())
            for x, n in need.items():
                counts[x] -= n * times
            done.append((need, times))
    open_at: dict[int, list] = defaultdict(list)  # gap -> [(pieces, how many)]
    gaps = np.zeros(limit + 1, dtype=bool)
    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            tight = np.flatnonzero(gaps[length:])
            if not len(tight):
                per = min(limit // length, left)
                times = left // per
                left -= per * times
                pieces, gap = Counter({length: per}), limit - per * length
            else:
                at = length + int(tight[0])
                had, many = open_at[at].pop()
                per = min(at // length, left)
                times = min(many, left // per)
                left -= per * times
                if many > times:
                    open_at[at].append((had, many - times))
                gaps[at] = bool(open_at[at])
                pieces, gap = had + Counter({length: per}), at - per * length
            open_at[gap].append((pieces, times))
            gaps[gap] = gap > 0
    return done + [x for some in open_at.values() for x in some]


def runs_of(counts: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """Rows (first place, pieces per sequence, length, first sequence, offset) by place; sequences.

    Places number the pieces by length, shortest first.
    """
    following = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rows, sequence = [], 0
    for pieces, times in plan(counts, limit):
        offset = 0
        for length, per in sorted(pieces.items(), reverse=True):
            rows.append((following[length], per, length, sequence, offset))
            following[length] += per * times
            offset += per * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), sequence


def packed(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), *,
           limit: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset: together at most `limit` long, gapless from 0.

    Lengths must be from 1 to `limit`; a null or other length raises an error. Which of several pieces
    of one length goes where follows `order`; ties get any place. An empty table stays empty.
    """
    length_name = f"`{length}`"
    counts = np.zeros(limit + 1, dtype=np.int64)
    for r in pieces.groupBy(F.col(length_name).alias("n")).count().limit(limit + 1).collect():
        if r["n"] is None or not 1 <= r["n"] <= limit:
            raise ValueError(f"a piece of length {r['n']} can't go into sequences of {limit}")
        counts[r["n"]] = r["count"]
    runs, _ = runs_of(counts, limit)  # bounded by the limit, not by the table
    first, per, size, sequence, offset = (np.ascontiguousarray(x) for x in runs.T)

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(position: pd.Series) -> pd.DataFrame:
        at = position.to_numpy()
        run = np.searchsorted(first, at, side="right") - 1
        turn, within = np.divmod(at - first[run], per[run])
        return pd.DataFrame({"sequence_id": sequence[run] + turn, "offset": offset[run] + within * size[run]})

    rows = numbered(pieces, [length, *order], position="_emberlog_position", name="pieces")
    return rows.withColumn(
        "_emberlog_at", place("_emberlog_position")).select(
        *[f"`{c}`" for c in pieces.columns], "_emberlog_at.*")


def packed_documents(docs: DataFrame, tokenizer: str, *, limit: int = 4096, end: int = 1,
                     with_ids: bool = False) -> DataFrame:
    """Documents as packed pieces; texts are tokenized once, and only piece lengths are planned with."""
    pieces = saved(token_pieces(docs, tokenizer, limit=limit, end=end, with_ids=with_ids), "pieces")
    return packed(pieces, limit=limit)
