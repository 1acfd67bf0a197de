import zlib
from collections import Counter, defaultdict

from emberlog.llm.sharding import sharded

SCHEMA = "doc_id bigint, text string, source string, shard int, size string"


def test_laws(rows):
    data = [(i, f"text {i % 9} é", "hot" if i % 3 else f"s{i % 11}", 1, "x") for i in range(500)]
    data += [(500, None, None, None, None), (None, "", "hot", None, None), (7, "text 7 é", "hot", 1, "x"),
             (501, "long " * 40_000, "s1", None, None)]
    got = sharded(rows(data, SCHEMA), 7).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d[0] for d in data)
    slots, sources = defaultdict(list), defaultdict(Counter)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sources[r["source"]][r["shard"]] += 1
        assert r["law"] == "rows" and r["grown_shard"] is None
    texts = Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    assert set(slots) == set(range(7))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for counts in sources.values():  # each source in its share of every shard, up to a row for each source
        share = sum(counts.values()) / len(data)
        for shard in range(7):
            assert abs(counts[shard] - share * len(slots[shard])) <= 1 + share * len(sources)


def test_fewer_rows_than_shards_and_none(rows):
    got = sharded(rows([(i, "t", "s", 0, "") for i in range(5)], SCHEMA), 40).collect()
    assert len({r["shard"] for r in got}) == 5 and {r["slot"] for r in got} == {0}
    assert sharded(rows([], SCHEMA), 40).collect() == []


def test_seed_decides(rows):
    df = rows([(i, "t", "s", 0, "") for i in range(100)], SCHEMA)
    order = lambda seed: [r["doc_id"] for r in sorted(sharded(df, 4, seed=seed).collect(), key=lambda r: (r["shard"], r["slot"]))]  # noqa: E731,E501
    assert order(1) == order(1) != order(2)
