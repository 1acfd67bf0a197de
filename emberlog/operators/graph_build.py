"""Typed entity graph built from logs.

Every log becomes facts by one projection: each row gives an array of nodes and edges, which is exploded,
so a log is read once for all kinds. Facts of all logs are merged on their keys by one aggregation, map-side
first: a node or edge has the times of its first and last fact, the number of its facts, and of each property
the last value by time (of equal times the larger one).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.fixed.graph import EDGE_KINDS, NO_PEER, NODE_KINDS
from emberlog.operators.common import explode_rows

PROPS = "array<struct<name: string, value: string>>"


def _column(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _fact(table: str, kind: str, src: Column, dst: Column, props: Column) -> Column:
    return F.struct(F.lit(table).alias("table"), F.lit(kind).alias("kind"), src.alias("id"), dst.alias("dst"),
                    props.alias("props"))


def node(kind: str, id, **props) -> Column:
    """A node of a row; none if its id is null or empty. Unknown kinds and properties are refused."""
    if unknown := set(props) - set(NODE_KINDS[kind]):
        raise ValueError(f"{kind} has no {sorted(unknown)}")
    key = _column(id)
    pairs = [F.struct(F.lit(name).alias("name"), _column(value).alias("value")) for name, value in props.items()]
    listed = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()) if pairs else F.array().cast(PROPS)
    return F.when(key.isNotNull() & (key != ""), _fact("node", kind, key, F.lit(""), listed.cast(PROPS)))


def edge(kind: str, src, dst, when: Column | None = None) -> Column:
    """An edge of a row; none if an end is null or empty, or `when` is not true."""
    if kind not in EDGE_KINDS:
        raise ValueError(f"no edge kind {kind}")
    a, b = _column(src), _column(dst)
    there = a.isNotNull() & b.isNotNull() & (a != "") & (b != "")
    return F.when(there if when is None else there & when, _fact("edge", kind, a, b, F.array().cast(PROPS)))


def facts(log: DataFrame, ts: str, one=(), lists=()) -> DataFrame:
    """table, kind, id, dst, props and ts of all nodes and edges (`one`) and arrays of them (`lists`) of a log."""
    found = F.filter(F.concat(F.array(*one), *lists), lambda f: f.isNotNull())
    return explode_rows(log, found, "_f", F.col(ts).alias("ts")).select("_f.*", "ts")


def merged(parts: list[DataFrame]) -> DataFrame:
    """The graph of all facts: table (node or edge), kind, id, dst, first_seen, last_seen, seen and attrs (a map)."""
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    # a fact counts through the empty property, whose value is null
    props = F.concat(F.array(F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("value"))), "props")
    key = ["table", "kind", "id", "dst"]
    per = explode_rows(rows, props, "_p", *key, "ts").groupBy(*key, F.col("_p.name").alias("name")).agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"),
        F.max(F.struct("ts", "_p.value"))["value"].alias("value"))
    whole = F.col("name") == ""
    attrs = F.sort_array(F.collect_list(F.when(~whole, F.struct("name", "value"))))
    return per.groupBy(*key).agg(
        F.max(F.when(whole, F.col("a"))).alias("first_seen"), F.max(F.when(whole, F.col("b"))).alias("last_seen"),
        F.max(F.when(whole, F.col("n"))).alias("seen"), F.map_from_entries(attrs).alias("attrs"))


def nodes_of(graph: DataFrame) -> DataFrame:
    """kind, id, first_seen, last_seen, seen, attrs."""
    return graph.filter("table = 'node'").drop("table", "dst")


def edges_of(graph: DataFrame) -> DataFrame:
    """kind, src_kind, src, dst_kind, dst, first_seen, last_seen, seen."""
    def ends(i: int) -> Column:
        kinds = F.create_map(*[F.lit(x) for k, v in EDGE_KINDS.items() for x in (k, v[i])])
        return F.element_at(kinds, F.col("kind"))
    return graph.filter("table = 'edge'").select(
        "kind", ends(0).alias("src_kind"), F.col("id").alias("src"), ends(1).alias("dst_kind"), "dst",
        "first_seen", "last_seen", "seen")


def of_device(rows: DataFrame, device: str) -> DataFrame:
    """Facts of one device for the union of several: ids get its name in front, and nodes the property device."""
    prefix = F.lit(device + "/")
    own = F.array(F.struct(F.lit("device").alias("name"), F.lit(device).alias("value")))
    is_node = F.col("table") == "node"
    return rows.withColumns({
        "id": F.concat(prefix, "id"), "dst": F.when(is_node, F.lit("")).otherwise(F.concat(prefix, "dst")),
        "props": F.when(is_node, F.concat("props", own)).otherwise(F.col("props")).cast(PROPS)})


# --- logs ------------------------------------------------------------------------------------------

def _address(value) -> Column:
    return node("IPAddress", value, version=F.when(_column(value).contains(":"), 6).otherwise(4))


def process_facts(rows: DataFrame) -> DataFrame:
    """Process starts: pid, ppid, name, cmdline, host, user, ts."""
    return facts(rows, "ts", [
        node("Process", "pid", ppid="ppid", name="name", cmdline="cmdline", host="host", start_utc="ts"),
        node("Process", "ppid"), node("Host", "host"), node("User", "user", host="host"),
        edge("EXECUTED", "user", "pid"), edge("CHILD_OF", "pid", "ppid"), edge("RUNS_ON", "pid", "host")])


def file_facts(rows: DataFrame) -> DataFrame:
    """Files that processes write or load: pid, path, sha256, size, host, action (write or load), ts."""
    action = F.col("action")
    return facts(rows, "ts", [
        node("File", "path", sha256="sha256", size="size", host="host"), node("Process", "pid", host="host"),
        node("Hash", "sha256", algo=F.lit("sha256")), edge("HASHES_TO", "path", "sha256"),
        edge("WROTE", "pid", "path", action == "write"), edge("LOADED", "pid", "path", action == "load")])


def registry_facts(rows: DataFrame) -> DataFrame:
    """Registry writes: pid, key, hive, host, ts."""
    return facts(rows, "ts", [
        node("RegistryKey", "key", hive="hive", host="host", last_write_utc="ts"), node("Process", "pid", host="host"),
        edge("WROTE_KEY", "pid", "key")])


def socket_facts(rows: DataFrame) -> DataFrame:
    """Sockets of processes: pid, owner, foreign_addr, ts; sockets without a peer or process are left out."""
    known = rows.filter(F.col("pid").isNotNull() & ~F.coalesce("foreign_addr", F.lit("")).isin(*NO_PEER))
    return facts(known, "ts", [
        node("Process", "pid", name=F.nullif(F.col("owner"), F.lit(""))), _address("foreign_addr"),
        edge("CONNECTED_TO", "pid", "foreign_addr")])


def dns_facts(rows: DataFrame) -> DataFrame:
    """Answers to queries: query, answers (an array), ts; names among the answers are domains without an edge."""
    numeric = r"^[0-9.]+$|:"
    def of(a):
        return F.when(a.rlike(numeric), _address(a)).otherwise(node("Domain", a))
    name = F.col("query")
    return facts(rows, "ts", [node("Domain", name)], [
        F.transform("answers", of),
        F.transform("answers", lambda a: edge("RESOLVED_TO", name, a, a.rlike(numeric)))])


def flow_facts(rows: DataFrame) -> DataFrame:
    """Flows: flow_id, src, dst, sport, dport, proto, bytes, ts."""
    props = {c: c for c in ("src", "dst", "sport", "dport", "proto", "bytes")}
    return facts(rows, "ts", [
        node("NetworkFlow", "flow_id", start_utc="ts", **props), _address("src"), _address("dst"),
        edge("FLOW_SRC", "flow_id", "src"), edge("FLOW_DST", "flow_id", "dst")])


def event_facts(rows: DataFrame) -> DataFrame:
    """Log events: event_id, source, channel, eid, host, user, pid, src_ip, ts."""
    return facts(rows, "ts", [
        node("Event", "event_id", source="source", channel="channel", eid="eid", ts_utc="ts", host="host"),
        node("Host", "host"), node("User", "user"), node("Process", "pid"), _address("src_ip"),
        edge("OBSERVED_ON", "event_id", "host"), edge("AUTHENTICATED_AS", "event_id", "user"),
        edge("RAISED_BY", "event_id", "pid"), edge("SOURCE_IP", "event_id", "src_ip")])


def stage_facts(rows: DataFrame, source: str = "log_corpus") -> DataFrame:
    """Attack stages per host: host, stage, ips (an array), ts; a stage is one event per host."""
    id = F.substring(F.concat_ws(":", "host", F.lit(source), "stage"), 1, 180)
    known = rows.filter((F.col("host") != "") & (F.col("stage") != ""))
    return facts(known, "ts", [
        node("Host", "host"), node("Event", id, source=F.lit(source), channel="stage", eid=F.lit(0), host="host"),
        edge("OBSERVED_ON", id, "host")], [
        F.transform("ips", _address), F.transform("ips", lambda a: edge("SOURCE_IP", id, a))])


def mail_facts(rows: DataFrame) -> DataFrame:
    """Mails: msg_id, subject, folder, pst_path, sender, recipients (an array), attachments (name, size), ts."""
    sender = F.lower("sender")
    none = F.array().cast("array<string>")
    recipients = F.transform(F.coalesce("recipients", none), F.lower)
    files = F.coalesce("attachments", F.array().cast("array<struct<name: string, size: bigint>>"))

    def domain(address):
        return F.nullif(F.regexp_extract(address, r"@([^@>\s]+)$", 1), F.lit(""))

    def path(f):
        return F.when(f["name"] != "", F.substring(F.concat_ws(":", "pst_path", "msg_id", f["name"]), 1, 180))
    people = F.concat(F.array(sender), recipients)
    return facts(rows, "ts", [
        node("Email", "msg_id", subject=F.substring("subject", 1, 200), folder="folder", pst_path="pst_path",
             sent_utc="ts", has_attachments=(F.size(files) > 0).cast("int")),
        edge("SENT_FROM", "msg_id", sender)], [
        F.transform(people, lambda p: node("User", p, name=p)),
        F.transform(people, lambda p: node("Domain", domain(p))),
        F.transform(people, lambda p: edge("EMAILS_ON_DOMAIN", p, domain(p))),
        F.transform(recipients, lambda p: edge("SENT_TO", "msg_id", p)),
        F.transform(files, lambda f: node("File", path(f), size=f["size"])),
        F.transform(files, lambda f: edge("HAS_ATTACHMENT", "msg_id", path(f)))])
