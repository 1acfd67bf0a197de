"""Commits of several writers, insert-or-ignore registries, seals and family attributions."""

import threading

from emberlog.sinks import commits, tables

KEY = ["ioc_type", "value", "case_id"]
SCHEMA = "ioc_type string, value string, case_id string, agent string"


def rows(spark, values, agent="a", case="c"):
    return spark.createDataFrame([("ipv4", v, case, agent) for v in values], SCHEMA)


def counted(df):
    return {r["ioc_type"]: r["new_rows"] for r in df.collect()}


def test_insert_or_ignore_and_odd_keys(spark, tmp_path):
    path = str(tmp_path / "r")
    assert counted(tables.insert_new(rows(spark, ["1", "2", "2", "", None], "b"), path, KEY)) == {"ipv4": 2}
    assert counted(tables.insert_new(rows(spark, ["2", "3"], "a"), path, KEY)) == {"ipv4": 1}
    assert counted(tables.insert_new(rows(spark, []), path, KEY)) == {}
    got = {(r["value"], r["agent"], r["version"], r["sealed"]) for r in tables.read_registry(spark, path).collect()}
    assert got == {("1", "b", 1, False), ("2", "b", 1, False), ("3", "a", 2, False)}


def test_slower_writer_settles_with_the_faster(spark, tmp_path, monkeypatch):
    """Another writer commits between our writing and our claim: no key is lost and none stored twice."""
    path, real, raced = str(tmp_path / "r"), commits._claim, []

    def claim(session, at, version, manifest):
        if not raced:
            raced.append(version)
            tables.insert_new(rows(spark, ["1", "2"], "fast"), path, KEY)
        return real(session, at, version, manifest)

    monkeypatch.setattr(commits, "_claim", claim)
    assert counted(tables.insert_new(rows(spark, ["2", "3"], "slow"), path, KEY)) == {"ipv4": 1}
    got = sorted((r["value"], r["agent"]) for r in tables.read_registry(spark, path).collect())
    assert got == [("1", "fast"), ("2", "fast"), ("3", "slow")]
    assert [m["version"] for m in commits.manifests(spark, path)] == [1, 2]


def test_writers_at_the_same_time(spark, tmp_path):
    path, new, failed = str(tmp_path / "r"), [], []

    def work(n):
        try:
            new.append(counted(tables.insert_new(rows(spark, map(str, range(n, n + 10)), str(n)), path, KEY)))
        except Exception as e:  # noqa: BLE001 - shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in (0, 5, 10)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = [r["value"] for r in tables.read_registry(spark, path).collect()]
    assert not failed and sorted(got, key=int) == [str(i) for i in range(20)]
    assert sum(n.get("ipv4", 0) for n in new) == 20


def test_a_writer_that_dies_before_its_claim_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    tables.insert_new(rows(spark, ["1"]), path, KEY)
    with monkeypatch.context() as m:
        m.setattr(commits, "_claim", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        try:
            tables.insert_new(rows(spark, ["2"]), path, KEY)
        except OSError:
            pass
    assert [r["value"] for r in tables.read_registry(spark, path).collect()] == ["1"]
    assert counted(tables.insert_new(rows(spark, ["2"]), path, KEY)) == {"ipv4": 1}


def test_seals_cover_what_is_there(spark, tmp_path):
    path = str(tmp_path / "r")
    tables.insert_new(rows(spark, ["1", "2"]).unionByName(rows(spark, ["1"], case="d")), path, KEY)
    cases = spark.createDataFrame([("c",), ("c",), ("none",)], "case_id string")
    assert tables.seal_cases(cases, path) == 2
    tables.insert_new(rows(spark, ["3"]), path, KEY)
    got = {(r["case_id"], r["value"]): r["sealed"] for r in tables.read_registry(spark, path).collect()}
    assert got == {("c", "1"): True, ("c", "2"): True, ("c", "3"): False, ("d", "1"): False}
    assert tables.seal_cases(cases, path) == 3


def test_findings_replaced_by_two_writers(spark, tmp_path):
    path = str(tmp_path / "f")
    cols = "finding_id string, case_id string, claim string, created string"
    tables.insert_findings(spark.createDataFrame([("f1", "1", "old", "t"), ("f2", "02", "b", "t")], cols), path)
    tables.insert_findings(spark.createDataFrame([("f1", "1", "new", "t")], cols), path)
    got = [(r["finding_id"], r["case_id"], r["claim"]) for r in tables.list_findings(spark, path).collect()]
    assert got == [("f1", "1", "new"), ("f2", "02", "b")]  # case ids stay text


def test_family_attributions_are_kept_once_per_case(spark, tmp_path):
    path = str(tmp_path / "a")
    hits = spark.createDataFrame([("c", "x", "s2"), ("c", "x", "s1"), ("d", "x", None)],
                                 "case_id string, family string, snippet string")
    key = ["family", "case_id"]
    assert tables.insert_new(tables.family_attributions(hits, "m"), path, key).first()["new_rows"] == 2
    assert tables.insert_new(tables.family_attributions(hits, "n"), path, key).count() == 0
    got = {(r["case_id"], r["snippet"], r["agent"]) for r in tables.read_registry(spark, path).collect()}
    assert got == {("c", "s1", "m"), ("d", None, "m")}
