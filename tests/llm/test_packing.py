import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberlog.llm import packing
from emberlog.llm.packing import WordIds, packed, packed_documents, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_words_encode_as_the_whole_text(tokenizer):
    rng = random.Random(1)
    letters = list("abcdeXYZ  \n\t'.,!s12²½ªßÉñ中文\x1c\x85 ​ İſΣ'stdI’\x00\x01👍́_-") + ["<|endoftext|>"]
    words = WordIds(PATH)
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == tokenizer.encode(
            text, add_special_tokens=False).ids, repr(text)
    long = "word " * 30_000 + "x" * 5000
    assert np.frombuffer(words.encode(long), "<u4").tolist() == tokenizer.encode(
        long, add_special_tokens=False).ids


def test_documents_are_whole_and_sequences_gapless(rows, tokenizer):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "and", "Zebra,", "été", "x1"], k=rng.choice([0, 1, 5, 20, 60])))
             for _ in range(150)] + [None, "", "same", "same"]
    df = rows([(n, t, 1) for n, t in enumerate(texts)] + [(0, texts[0], 2)], "doc_id bigint, text string, length int")
    got = packed_documents(df, PATH, limit=32, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == len(r["ids"])
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for n, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        wanted = [(p, s, ids[s:s + 32]) for p, s in enumerate(range(0, len(ids), 32))]
        have = sorted((r["piece"], r["start"], r["ids"]) for r in by_doc[n])
        assert have == sorted(wanted * (2 if n == 0 else 1))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= 1.05 * total / 32 + 1


def test_plan_uses_each_piece_once_and_closes_exactly():
    rng = np.random.default_rng(3)
    for limit, n in ((10, 5), (64, 400), (300, 3000), (64, 0)):
        counts = np.bincount(rng.integers(1, limit + 1, n), minlength=limit + 1)
        used = np.zeros(limit + 1, dtype=int)
        sequences = 0
        for pieces, times in plan(counts, limit):
            assert times > 0 and sum(k * v for k, v in pieces.items()) <= limit
            for k, v in pieces.items():
                used[k] += v * times
            sequences += times
        assert (used == counts).all()
        bound = -(-int(counts @ np.arange(limit + 1)) // limit)
        assert sequences <= max(bound * 1.2, bound + 2)


def test_triples_are_found():
    counts = np.zeros(101, dtype=int)
    counts[[60, 23, 12, 5]] = 7
    assert [(dict(p), t) for p, t in plan(counts, 100)] == [({60: 1, 23: 1, 12: 1, 5: 1}, 7)]


def test_one_length_and_empty_and_wrong(rows):
    same = packed(rows([(n, 0, 8) for n in range(1000)], "doc_id bigint, piece int, length bigint"), limit=16)
    assert same.select("sequence_id").distinct().count() == 500
    assert packed(rows([], "doc_id bigint, piece int, length bigint"), limit=16).count() == 0
    for bad in (None, 0, 17):
        with pytest.raises(ValueError):
            packed(rows([(1, 0, bad)], "doc_id bigint, piece int, length bigint"), limit=16)
    assert packing.packed_documents(rows([], "doc_id bigint, text string"), PATH).count() == 0
