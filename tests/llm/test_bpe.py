import random

import public_tokenizers as P
import pytest
import tiktoken

from emberlog.llm import bpe
from emberlog.llm.bpe import BytePairs, decoded, encoded, merged, read_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(PATH, P.PATTERN)


def test_same_ids_as_the_library(pairs, library):
    rng = random.Random(4)
    letters = list("abcdefgh  \n\n\t'.,!s12²½ªéßÉñ中文  \x1c\x1d\x85 ​İſ'stdI’\x00\x01👍́") + ["<|endoftext|>"]
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        ids = pairs.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert pairs.decode(ids) == text.encode()


def test_long_runs(pairs, library):
    for text in ("a" * 50_000, "ab" * 20_000 + "é" * 9_000, " " * 3_000, "\n" * 999 + "x"):
        assert pairs.encode(text) == library.encode_ordinary(text)


def test_merges_are_leftmost_of_least_rank():
    def plain(piece, ranks):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks),
                       default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(5)
    for _ in range(500):
        ranks = {bytes([c]): c for c in b"abc"}
        for r in range(12):
            token = b"".join(rng.choices(list(ranks), k=2))
            ranks.setdefault(token, 300 + r)
        for _ in range(10):
            piece = bytes(rng.choices(b"abc", k=rng.randint(1, 30)))
            if piece not in ranks:
                assert merged(piece, ranks) == plain(piece, ranks)


def test_short_and_long_pieces_are_merged_alike(monkeypatch):
    ranks, rng = read_ranks(PATH), random.Random(6)
    pieces = ["".join(rng.choices("abcdeinorst é中", k=rng.randint(2, 70))).encode() for _ in range(1000)]
    got = [bpe.merged(p, ranks) for p in pieces]
    asked = []
    short = bpe.merged_short
    monkeypatch.setattr(bpe, "merged_short", lambda p, r: (asked.append(len(p)), short(p, r))[1])
    assert [bpe.merged(p, ranks) for p in pieces] == got and 400 < len(asked) and max(asked) < bpe.LONG
    monkeypatch.setattr(bpe, "LONG", 0)
    assert [bpe.merged(p, ranks) for p in pieces] == got  # all by the tree


def test_columns_nulls_and_clashing_names(rows, library):
    df = rows([(1, "Hello there", None, "x"), (None, None, [1], "y"), (2, "", None, None), (2, "", None, None)],
              "doc_id bigint, text string, ids array<int>, decoded string")
    got = decoded(encoded(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(got.columns) == sorted(df.columns)
    found = sorted((r["text"] or "", r["ids"], bytes(r["decoded"])) for r in got.collect())
    assert found == [("", [], b"")] * 3 + [("Hello there", library.encode_ordinary("Hello there"), b"Hello there")]
    empty = encoded(rows([], "doc_id bigint, text string"), PATH, P.PATTERN)
    assert decoded(empty, PATH, P.PATTERN).collect() == []
