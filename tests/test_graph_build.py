import datetime as dt

import pytest

from emberlog.fixed.graph import EDGE_KINDS, NODE_KINDS
from emberlog.operators import graph, graph_build as gb

T = [dt.datetime(2024, 1, 1, 0, 0, i) for i in range(10)]


def test_facts_merge_on_their_keys(spark):
    rows = [(5, 1, "old.exe", None, "h1", "s1", T[2]), (5, 1, "new.exe", "x", "h1", "s1", T[4]), (5, None, None, "y", None, "", T[1]),
            (6, 5, "b.exe", None, "h2", None, T[3])]
    log = spark.createDataFrame(rows, "pid int, ppid int, name string, cmdline string, host string, user string, ts timestamp_ntz")
    whole = gb.merged([gb.process_facts(log)])
    nodes = {(r["kind"], r["id"]): r for r in gb.nodes_of(whole).collect()}
    five = nodes["Process", "5"]
    # the parent of 6 is a fact of process 5 too; the last value that is there counts
    assert five["seen"] == 4 and five["first_seen"] == T[1] and five["last_seen"] == T[4]
    assert five["attrs"]["name"] == "new.exe" and five["attrs"]["cmdline"] == "x" and five["attrs"]["ppid"] == "1"
    assert set(nodes) == {("Process", "5"), ("Process", "1"), ("Process", "6"), ("Host", "h1"), ("Host", "h2"), ("User", "s1")}
    edges = {(r["kind"], r["src"], r["dst"]): r["seen"] for r in gb.edges_of(whole).collect()}
    assert edges == {("EXECUTED", "s1", "5"): 2, ("CHILD_OF", "5", "1"): 2, ("CHILD_OF", "6", "5"): 1,
                     ("RUNS_ON", "5", "h1"): 2, ("RUNS_ON", "6", "h2"): 1}


def test_devices_stay_apart_and_nothing_gives_nothing(spark):
    flows = spark.createDataFrame([("f1", "10.0.0.1", "::1", 1, 2, "tcp", 3, T[0])],
                                  "flow_id string, src string, dst string, sport int, dport int, proto string, bytes int, ts timestamp_ntz")
    parts = [gb.of_device(gb.flow_facts(flows), d) for d in ("a", "b")]
    whole = gb.merged(parts)
    nodes = {(r["kind"], r["id"]): r["attrs"] for r in gb.nodes_of(whole).collect()}
    assert len(nodes) == 6 and nodes["IPAddress", "a/::1"] == {"device": "a", "version": "6"}
    top, among = graph.capped_graph(gb.nodes_of(whole).select("kind", "id"), gb.edges_of(whole), 2)
    assert sorted(r["id"] for r in top.collect()) == ["a/f1", "b/f1"] and among.count() == 0
    assert gb.merged([gb.flow_facts(flows.limit(0))]).collect() == []


def test_all_kinds_come_from_logs(spark):
    from emberlog.plans.graph_queries import all_facts
    whole = gb.merged(all_facts(spark, "/root/testdata/sf0.001"))
    assert {r["kind"] for r in gb.nodes_of(whole).select("kind").distinct().collect()} == set(NODE_KINDS)
    assert {r["kind"] for r in gb.edges_of(whole).select("kind").distinct().collect()} == set(EDGE_KINDS)


def test_unknown_kinds_are_refused():
    with pytest.raises(ValueError):
        gb.node("Host", "h", colour="c")
    with pytest.raises(KeyError):
        gb.node("Planet", "h")
    with pytest.raises(ValueError):
        gb.edge("EATS", "a", "b")
