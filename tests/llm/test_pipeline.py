import re
import zlib

import corpus_pipeline
from emberlog.llm import order_minhash, queries
from emberlog.llm.packing import WordIds
import public_tokenizers

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {}
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, given, SF)
        assert made.columns == docs.columns
        after[name] = {r["doc_id"]: r["text"] for r in made.collect()}
        given = made
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = after["toxicity"]
    assert clean.items() <= whole.items() and len(clean) > 0.7 * len(whole)

    best = {}
    for i, t in clean.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (0, i)), (-len(t or ""), i))
    distinct = after["exact_dedup"]
    assert set(distinct) == {i for _, i in best.values()}

    tokens = {i: (t or "").lower().split() for i, t in distinct.items()}
    ids, parent = sorted(distinct), {i: i for i in distinct}
    for n, j in enumerate(ids):
        for i in ids[:n]:
            a, b = sorted((len(tokens[i]), len(tokens[j])))
            if a >= 0.8 * b and order_minhash.alike(tokens[i], tokens[j], 0.8):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = {x: new if p == old else p for x, p in parent.items()}
    assert set(after["minhash_near_dedup"]) == {p for p in parent.values()}

    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.run(spark, SF).collect()
    expected = {i: len(words.encode(t or "")) // 4 + 1 for i, t in after["minhash_near_dedup"].items()}
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == expected


def test_queries_are_registered():
    from emberlog.plans.registry import QUERIES

    assert {int(n[2:].split("_")[0]) for n in QUERIES if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert "pipeline" in QUERIES and queries.remainder is not None


def test_remainder_is_that_of_the_text(spark):
    got = spark.range(50).select("id", queries.remainder("id", 10).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 10 for r in got)
