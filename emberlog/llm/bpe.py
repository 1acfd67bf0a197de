"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

For each piece of text the leaves of the tree stand for byte positions and hold (rank, position) of the
pair that starts there; the root is the leftmost pair of the least rank. A merge changes the pair at its
own position and at its left neighbour and clears that of the byte it swallowed: three logarithmic point
updates, so a run of n bytes costs O(n log n) however long it is. Pieces of few bytes, nearly all, are
merged in a plain list, which is faster for them.

Pieces recur, so every Python worker remembers what the latest distinct pieces and chunks encode to.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from emberlog.llm.common import Memo
from emberlog.session import ship

#: White space other than space and line feed, and the mark that texts are cut at.
ODD_SPACE = re.compile(r"[^\S \n]|[\x00\x1c-\x1f]")
#: Bytes from which a piece is merged by a tree.
LONG = 48
#: Kept per Python worker, so that tasks share what earlier tasks have encoded.
_WORKER: dict[tuple[str, str], BytePairs] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """As `merged`, in time that grows with the square of the piece."""
    rank, none = ranks.get, 1 << 62
    tokens = [piece[at:at + 1] for at in range(len(piece))]
    pairs = [rank(piece[at:at + 2], none) for at in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != none:
        at = pairs.index(least)
        token = tokens[at] = tokens[at] + tokens.pop(at + 1)
        del pairs[at]
        if at < len(pairs):
            pairs[at] = rank(token + tokens[at + 1], none)
        if at:
            pairs[at - 1] = rank(tokens[at - 1] + token, none)
    return tokens


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one piece: always merge the leftmost pair of least rank, until none has a rank."""
    n = len(piece)
    if n == 1 or piece in ranks:
        return [piece]
    if n < LONG:
        return merged_short(piece, ranks)
    shift, rank, none = n.bit_length(), ranks.get, 1 << 62
    size = 1 << (n - 2).bit_length()
    tree = [none] * size
    tree += [none if (r := rank(piece[at:at + 2])) is None else r << shift | at for at in range(n - 1)]
    tree += [none] * (2 * size - len(tree))
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    end, left = list(range(1, n + 1)), list(range(-1, n))  # of the token that starts at a position
    mask = (1 << shift) - 1
    while (top := tree[1]) != none:
        at = top & mask
        gone = end[at]
        stop = end[at] = end[gone]
        value, other = none, none
        if stop < n:
            left[stop] = at
            if (r := rank(piece[at:end[stop]])) is not None:
                value = r << shift | at
        if (before := left[at]) < 0:
            changed = (at, value), (gone, none)
        else:
            if (r := rank(piece[before:stop])) is not None:
                other = r << shift | before
            changed = (at, value), (gone, none), (before, other)
        for node, value in changed:
            node += size
            if node >= 2 * size:  # the last byte starts no pair
                continue
            while tree[node] != value:
                tree[node] = value
                if node == 1:
                    break
                if (sibling := tree[node ^ 1]) < value:
                    value = sibling
                node >>= 1
    tokens, at = [], 0
    while at < n:
        tokens.append(piece[at:end[at]])
        at = end[at]
    return tokens


class BytePairs:
    """Encoder and decoder of one rank file and one pre-splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = read_ranks(path)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.pieces = Memo(self.piece, 100_000)
        self.chunks = Memo(self.chunk, 400_000)

    @classmethod
    def of(cls, path: str, pattern: str) -> BytePairs:
        if (path, pattern) not in _WORKER:
            _WORKER[path, pattern] = cls(path, pattern)
        return _WORKER[path, pattern]

    def piece(self, piece: str) -> tuple[int, ...]:
        return tuple(map(self.ranks.__getitem__, merged(piece.encode("utf-8"), self.ranks)))

    def chunk(self, chunk: str) -> tuple[int, ...]:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            return self.piece(chunk)  # letters alone are one match
        short = self.pieces
        return tuple(i for piece in self.split.findall(chunk) for i in (
            short[piece] if len(piece) < 64 else self.piece(piece)))

    def encode(self, text: str) -> list[int]:
        """Token ids, each match of the pattern encoded by itself, without special tokens.

        Where no two white-space characters meet and none stands at an end, the pattern can't match
        across a space or line break, so words with their leading space are looked up as wholes.
        """
        if not text:
            return []
        if (ODD_SPACE.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
                or text[0] in " \n" or text[-1] in " \n"):
            return list(self.chunk(text))
        chunks = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return list(chain.from_iterable(map(self.chunks.__getitem__, chunks)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encoded(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and the token ids of the whole text as array<int>; a null text has no tokens.

    `ranks` is a file that every executor can open; a column named `ids` is replaced.
    """
    return _mapped(docs, text, ids, pa.list_(pa.int32()), "array<int>",
                   lambda pairs, t: pairs.encode(t or ""), ranks, pattern)


def decoded(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the bytes of the token ids; a null array has none, an unknown id raises an error."""
    return _mapped(rows, ids, out, pa.binary(), "binary",
                   lambda pairs, i: pairs.decode(i or []), ranks, pattern)


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The lists of a column; their numbers are turned to Python's in one go."""
    at = column.offsets.to_pylist()
    flat = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).tolist()
    for start, stop, valid in zip(at, at[1:], column.is_valid().to_pylist()):
        yield flat[start - at[0]:stop - at[0]] if valid else None


def _mapped(rows: DataFrame, source: str, out: str, kind, sql: str, each, ranks: str, pattern: str
            ) -> DataFrame:
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != out]
    given = rows.select(*[f"`{c}`" for c in kept], *([] if source in kept else [f"`{source}`"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = BytePairs.of(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(source)
                values = _lists(column) if pa.types.is_list(column.type) else column.to_pylist()
                made = pa.array([each(pairs, x) for x in values], kind)
                columns = {n: part.column(n) for n in part.schema.names if n != out} | {out: made}
                yield pa.RecordBatch.from_pydict(columns)

    return given.mapInArrow(work, f"{fields}, `{out}` {sql}")
