"""Queries over the typed entity graph, built from logs that `events` gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.operators import graph, graph_build as gb
from emberlog.plans.adapters import EVENT_K, events
from emberlog.plans.registry import query

HOST, USER, PID = "'h' || user_id % 20", "'S-1-5-' || user_id % 50", "user_id % 500"
#: Log -> columns; log number i holds the events whose number leaves i when divided by nine.
LOGS = {
    "process": {"pid": PID, "ppid": "user_id % 37", "name": "'proc' || k % 11", "cmdline": "'run ' || k", "host": HOST,
                "user": USER},
    "file": {"pid": PID, "path": "'C:/d/' || k % 300", "sha256": "md5('f' || k % 300)", "size": "k", "host": HOST,
             "action": "CASE WHEN k % 2 = 0 THEN 'write' ELSE 'load' END"},
    "registry": {"pid": PID, "key": "'HKLM/run' || k % 60", "hive": "'SOFTWARE'", "host": HOST},
    "socket": {"pid": PID, "owner": "'proc' || k % 11",
               "foreign_addr": "CASE WHEN k % 13 = 0 THEN '0.0.0.0' WHEN k % 7 = 0 THEN 'fe80::' || k "
                               "ELSE '203.0.113.' || k % 250 END"},
    "dns": {"query": "'d' || k || '.example'", "a1": "'198.51.100.' || k % 90", "a2": "'alias' || k % 3 || '.example'"},
    "flow": {"flow_id": "'f' || event_id", "src": "'10.0.0.' || user_id % 100", "dst": "'203.0.113.' || k % 250",
             "sport": "1000 + k", "dport": "443", "proto": "'tcp'", "bytes": "k * 10"},
    "event": {"event_id": "'ev' || event_id", "source": "'evtx'", "channel": "'Security'", "eid": "4624", "host": HOST,
              "user": USER, "pid": PID, "src_ip": "CASE WHEN k % 3 > 0 THEN '198.51.100.' || k END"},
    "mail": {"msg_id": "'m' || event_id", "subject": "'s' || k", "folder": "'Inbox'", "pst_path": "'box.pst'",
             "sender": "'U' || user_id || '@A' || k % 5 || '.example'", "r1": "'u' || k || '@b.example'",
             "r2": "CASE WHEN k % 2 = 0 THEN 'V' || k % 9 || '@c.example' END",
             "a": "CASE WHEN k % 4 = 0 THEN 'a' || k % 9 || '.pdf' END", "size": "k"},
    "stage": {"host": HOST, "stage": "CASE WHEN k % 2 = 0 THEN 'scan_recon' ELSE 'brute_force' END",
              "ip": "'198.51.100.' || k % 30"},
}
LOG_SQL = ", ".join(
    f"{name}_log AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())}, date_trunc('second', ts) AS ts "
    f"FROM (SELECT *, {EVENT_K} FROM events) WHERE event_id % 9 = {i})" for i, (name, columns) in enumerate(LOGS.items()))


def log(spark, sf, name: str) -> DataFrame:
    i = list(LOGS).index(name)
    return events(spark, sf).filter(F.col("event_id") % 9 == i).selectExpr(
        *[f"{e} AS {c}" for c, e in LOGS[name].items()], "date_trunc('second', ts) AS ts")


def all_facts(spark, sf) -> list[DataFrame]:
    dns = log(spark, sf, "dns").withColumn("answers", F.array("a1", "a2"))
    mail = log(spark, sf, "mail").withColumn("recipients", F.array("r1", "r2")).withColumn(
        "attachments", F.when(F.col("a").isNotNull(), F.array(F.struct(F.col("a").alias("name"), "size"))))
    stages = log(spark, sf, "stage").withColumn("ips", F.array("ip"))
    return [gb.process_facts(log(spark, sf, "process")), gb.file_facts(log(spark, sf, "file")),
            gb.registry_facts(log(spark, sf, "registry")), gb.socket_facts(log(spark, sf, "socket")), gb.dns_facts(dns),
            gb.flow_facts(log(spark, sf, "flow")), gb.event_facts(log(spark, sf, "event")), gb.mail_facts(mail),
            gb.stage_facts(stages)]


VERSION = "CASE WHEN contains({0}, ':') THEN '6' ELSE '4' END"
STAGE_ID = "host || ':log_corpus:' || stage"
DOMAIN = "split_part(lower({0}), '@', 2)"
#: Nodes by log: kind, id, properties; `n` facts are all rows whose id is there.
NODES = [
    ("process", "Process", "pid", {"ppid": "ppid", "name": "name", "cmdline": "cmdline", "host": "host", "start_utc": "ts"}),
    ("process", "Process", "ppid", {}), ("process", "Host", "host", {}), ("process", "User", '"user"', {"host": "host"}),
    ("file", "File", "path", {"sha256": "sha256", "size": "size", "host": "host"}), ("file", "Process", "pid", {"host": "host"}),
    ("file", "Hash", "sha256", {"algo": "'sha256'"}),
    ("registry", "RegistryKey", "key", {"hive": "hive", "host": "host", "last_write_utc": "ts"}),
    ("registry", "Process", "pid", {"host": "host"}),
    ("peer", "Process", "pid", {"name": "owner"}), ("peer", "IPAddress", "foreign_addr", {"version": VERSION.format("foreign_addr")}),
    ("dns", "Domain", "query", {}), ("dns", "IPAddress", "a1", {"version": "'4'"}), ("dns", "Domain", "a2", {}),
    ("flow", "NetworkFlow", "flow_id", {"src": "src", "dst": "dst", "sport": "sport", "dport": "dport", "proto": "proto",
                                        "bytes": "bytes", "start_utc": "ts"}),
    ("flow", "IPAddress", "src", {"version": "'4'"}), ("flow", "IPAddress", "dst", {"version": "'4'"}),
    ("event", "Event", "event_id", {"source": "source", "channel": "channel", "eid": "eid", "ts_utc": "ts", "host": "host"}),
    ("event", "Host", "host", {}), ("event", "User", '"user"', {}), ("event", "Process", "pid", {}),
    ("event", "IPAddress", "src_ip", {"version": "'4'"}),
    ("mail", "Email", "msg_id", {"subject": "subject", "folder": "folder", "pst_path": "pst_path", "sent_utc": "ts",
                                 "has_attachments": "CASE WHEN a IS NULL THEN '0' ELSE '1' END"}),
    *[("mail", "User", f"lower({c})", {"name": f"lower({c})"}) for c in ("sender", "r1", "r2")],
    *[("mail", "Domain", DOMAIN.format(c), {}) for c in ("sender", "r1", "r2")],
    ("mail", "File", "pst_path || ':' || msg_id || ':' || a", {"size": "size"}),
    ("stage", "Host", "host", {}), ("stage", "IPAddress", "ip", {"version": "'4'"}),
    ("stage", "Event", STAGE_ID, {"source": "'log_corpus'", "channel": "stage", "eid": "'0'", "host": "host"})]
EDGES = [
    ("process", "EXECUTED", '"user"', "pid"), ("process", "CHILD_OF", "pid", "ppid"), ("process", "RUNS_ON", "pid", "host"),
    ("file", "HASHES_TO", "path", "sha256"), ("file", "WROTE", "CASE WHEN action = 'write' THEN pid END", "path"),
    ("file", "LOADED", "CASE WHEN action = 'load' THEN pid END", "path"), ("registry", "WROTE_KEY", "pid", "key"),
    ("peer", "CONNECTED_TO", "pid", "foreign_addr"), ("dns", "RESOLVED_TO", "query", "a1"),
    ("flow", "FLOW_SRC", "flow_id", "src"), ("flow", "FLOW_DST", "flow_id", "dst"),
    ("event", "OBSERVED_ON", "event_id", "host"), ("event", "AUTHENTICATED_AS", "event_id", '"user"'),
    ("event", "RAISED_BY", "event_id", "pid"), ("event", "SOURCE_IP", "event_id", "src_ip"),
    ("mail", "SENT_FROM", "msg_id", "lower(sender)"), ("mail", "SENT_TO", "msg_id", "lower(r1)"),
    ("mail", "SENT_TO", "msg_id", "lower(r2)"),
    *[("mail", "EMAILS_ON_DOMAIN", f"lower({c})", DOMAIN.format(c)) for c in ("sender", "r1", "r2")],
    ("mail", "HAS_ATTACHMENT", "msg_id", "pst_path || ':' || msg_id || ':' || a"),
    ("stage", "OBSERVED_ON", STAGE_ID, "host"), ("stage", "SOURCE_IP", STAGE_ID, "ip")]


def _text(column: str, expression: str) -> str:
    return "strftime(ts, '%Y-%m-%d %H:%M:%S')" if expression == "ts" else f"CAST({expression} AS VARCHAR)"


NODE_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, CAST({id} AS VARCHAR) AS id, ts, MAP {{{', '.join(f'{chr(39)}{p}{chr(39)}: {_text(p, e)}' for p, e in props.items())}}}"
    f"::MAP(VARCHAR, VARCHAR) AS props FROM {name}_log" for name, kind, id, props in NODES)
EDGE_SQL = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, CAST({src} AS VARCHAR) AS src, CAST({dst} AS VARCHAR) AS dst, ts FROM {name}_log"
    for name, kind, src, dst in EDGES)
GRAPH_SQL = f"""{LOG_SQL}, peer_log AS (SELECT * FROM socket_log WHERE foreign_addr <> '0.0.0.0'),
  node_facts AS (SELECT * FROM ({NODE_SQL}) WHERE id <> ''), edge_facts AS (SELECT * FROM ({EDGE_SQL}) WHERE src <> '' AND dst <> '')"""


@query("graph_typed_nodes", f"""WITH {GRAPH_SQL},
p AS (SELECT kind, id, ts, unnest(map_entries(props)) AS e FROM node_facts),
v AS (SELECT kind, id, e.key AS name, max((ts, e.value))[2] AS value FROM p WHERE e.value IS NOT NULL GROUP BY ALL),
a AS (SELECT kind, id, string_agg(name || '=' || value, ';' ORDER BY name) AS attrs FROM v GROUP BY ALL)
SELECT kind, id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen, coalesce(any_value(attrs), '') AS attrs
FROM node_facts LEFT JOIN a USING (kind, id) GROUP BY kind, id""")
def graph_typed_nodes(spark, sf):
    shown = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return gb.nodes_of(gb.merged(all_facts(spark, sf))).withColumn("attrs", shown)


@query("graph_typed_edges", f"""WITH {GRAPH_SQL}
SELECT kind, src, dst, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen FROM edge_facts GROUP BY ALL""")
def graph_typed_edges(spark, sf):
    return gb.edges_of(gb.merged(all_facts(spark, sf))).drop("src_kind", "dst_kind")


@query("graph_bundle", f"""WITH {GRAPH_SQL},
n AS (SELECT DISTINCT 'dev' || d || '/' || id AS id, kind FROM node_facts, range(2) AS r(d)),
e AS (SELECT DISTINCT kind, 'dev' || d || '/' || src AS src, 'dev' || d || '/' || dst AS dst FROM edge_facts, range(2) AS r(d)),
k AS (SELECT col0 AS kind, col1 AS a, col2 AS b FROM (VALUES {', '.join(f"('{k}', '{a}', '{b}')" for k, (a, b) in gb.EDGE_KINDS.items())})),
ends AS (SELECT a AS kind, src AS id FROM e JOIN k USING (kind) UNION ALL SELECT b, dst FROM e JOIN k USING (kind)),
g AS (SELECT kind, id, count(*) AS degree FROM ends GROUP BY ALL)
SELECT kind, id, coalesce(degree, 0) AS degree FROM n LEFT JOIN g USING (kind, id) ORDER BY degree DESC, id, kind LIMIT 500""")
def graph_bundle(spark, sf):
    """The best-connected nodes of two devices with the same logs, kept apart by their names."""
    parts = [gb.of_device(f, f"dev{d}") for d in range(2) for f in all_facts(spark, sf)]
    whole = gb.merged(parts)
    top, _ = graph.capped_graph(gb.nodes_of(whole).select("kind", "id"), gb.edges_of(whole), 500)
    return top.select("kind", "id", "degree")
