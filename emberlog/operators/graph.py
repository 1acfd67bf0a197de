"""Entity graph as node and edge tables, and the questions asked of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from emberlog import functions as fn
from emberlog.operators.common import small

def nodes(df: DataFrame, kind: str, column: str) -> DataFrame:
    """Nodes of one kind from a column."""
    return df.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("id")).filter(
        F.col("id").isNotNull()).distinct()


def edges(df: DataFrame, kind: str, src_kind: str, src: str, dst_kind: str, dst: str) -> DataFrame:
    """Edges of one kind between two columns."""
    return df.select(
        F.lit(kind).alias("kind"), F.lit(src_kind).alias("src_kind"),
        F.col(src).cast("string").alias("src"), F.lit(dst_kind).alias("dst_kind"),
        F.col(dst).cast("string").alias("dst")).filter(
        F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def merged(parts) -> DataFrame:
    """Union of node or edge tables with one row per key."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def degrees(edge_table: DataFrame) -> DataFrame:
    ends = edge_table.select(F.col("src_kind").alias("kind"), F.col("src").alias("id")).union(
        edge_table.select("dst_kind", "dst"))
    return ends.groupBy("kind", "id").agg(F.count("*").alias("degree"))


def capped_graph(node_table: DataFrame, edge_table: DataFrame, max_nodes: int):
    """The `max_nodes` best-connected nodes (ties by id) and the edges among them, a picture of the whole."""
    ranked = node_table.join(degrees(edge_table), ["kind", "id"], "left").na.fill(0, ["degree"])
    keep = ranked.orderBy(F.desc("degree"), "id", "kind").limit(max_nodes)
    src = small(keep.select(F.col("kind").alias("src_kind"), F.col("id").alias("src")))
    dst = small(keep.select(F.col("kind").alias("dst_kind"), F.col("id").alias("dst")))
    among = edge_table.join(src, ["src_kind", "src"], "left_semi").join(
        dst, ["dst_kind", "dst"], "left_semi")
    return keep, among


def top_destinations(flows: DataFrame, n: int) -> DataFrame:
    """The `n` addresses with the most flows, external ones marked."""
    return flows.groupBy(F.col("dst").alias("addr")).agg(F.count("*").alias("flows")).orderBy(
        F.desc("flows"), "addr").limit(n).withColumn("external", ~fn.is_private(F.col("addr")))


def entity_counts(node_table: DataFrame) -> DataFrame:
    return node_table.groupBy("kind").agg(F.count("*").alias("n"))


def stage_chain(stages: DataFrame, order=("scan_recon", "brute_force", "web_shell",
                                          "process_injection")) -> DataFrame:
    """Attack stages present over all hosts; one row when at least two are (columns host, stage)."""
    per = stages.filter(F.col("stage").isin(list(order))).select("host", "stage").distinct(
        ).groupBy("stage").agg(F.count("*").alias("hosts"))
    pos = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage"))
    return per.agg(F.count("*").alias("stages"), F.max("hosts").alias("max_hosts"), F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(pos.alias("p"), "stage"))),
                    lambda s: s["stage"]), " -> ").alias("chain")).filter(F.col("stages") >= 2)


def pivot_addresses(signals: DataFrame, min_hosts: int = 2) -> DataFrame:
    """External addresses in the signals of several hosts (columns host, ip)."""
    return signals.filter(fn.is_external(F.col("ip"))).select("host", "ip").distinct().groupBy(
        "ip").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= min_hosts)


def new_edges(candidate: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges not in the graph yet."""
    key = ["kind", "src_kind", "src", "dst_kind", "dst"]
    return candidate.select(*key).distinct().join(existing.select(*key), key, "left_anti")
