import hashlib
import re
from collections import defaultdict

from emberlog.llm.exact_dedup import copies, without_copies

SCHEMA = "doc_id bigint, text string, kept string, d string, size int"


def made(rows):
    data = [(n, f"text {n % 7}" + " " * (n % 3), "x", "y", n) for n in range(60)]
    data += [(100 + n, "the same  words\n", None, None, 1) for n in range(200)]
    data += [(1, None, "x", None, None), (2, "", None, None, None), (3, " \t\n\x0b\x0c\r", "z", None, None),
             (500, "a b", None, None, None), (501, "ab", None, None, None),
             (None, "null id", None, None, None), (None, "nullid", None, None, None),
             (700, "twice", None, None, None), (700, "twice", None, None, None),
             (800, "ä" * 100_000 + " ", None, None, None), (801, "ä" * 100_000, None, None, None)]
    return data, rows(data, SCHEMA)


def expected(data):
    groups = defaultdict(list)
    for row in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")].append(row)
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        yield text, members, best


def test_every_row_gets_its_group(rows):
    data, df = made(rows)
    for options in ({}, {"heavy": 2, "tracked": 16}):
        got = copies(df, **options).collect()
        assert len(got) == len(data)
        by = defaultdict(list)
        for r in got:
            by[r["text_sha256"]].append(r)
        for text, members, best in expected(data):
            mine = by.pop(hashlib.sha256(text.encode()).hexdigest())
            assert sorted(r["doc_id"] or -1 for r in mine) == sorted(m[0] or -1 for m in members)
            assert {r["keep_id"] for r in mine} == {best[0]}
            assert {r["group_size"] for r in mine} == {len(members)}
            assert [r["doc_id"] for r in mine if r["kept"]] == [best[0]]
        assert not by


def test_kept_documents_have_all_columns(rows):
    data, df = made(rows)
    got = without_copies(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1, len(r["text"] or "")) for r in got.collect()) == sorted(
        (best[0] or -1, len(best[1] or "")) for _, _, best in expected(data))


def test_empty_table(rows):
    assert copies(rows([], SCHEMA)).collect() == []
    assert without_copies(rows([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(rows):
    _, df = made(rows)
    plan = copies(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
