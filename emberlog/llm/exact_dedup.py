"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries sketch (Spark's `approx_top_k`: counters that are decremented together, merged over tasks)
names the digests that may be frequent. Their exact counts and winners are aggregated map-side, and the
verified ones, at most `heavy` rows, are broadcast: rows of frequent digests get their answer where they
are, without a shuffle. All other digests, each with few rows, are dealt out by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from emberlog.llm.common import only, saved


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space (space and U+0009 to U+000D); null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)


def copies(docs: DataFrame, id: str = "doc_id", text: str = "text", *, heavy: int = 1000,
           tracked: int = 10_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points stays, then that with the smallest id (null ids come last). Of
    rows that repeat in full exactly one is kept. Null texts are empty texts; an empty table gives no
    rows. `tracked` counters find every digest with more than 1/7500 of all rows; what the sketch names
    is counted exactly, so the result does not depend on it.
    """
    spark = docs.sparkSession
    rows = saved(only(docs, id, text).toDF("doc_id", "text").select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), digest_of(F.col("text")).alias("d"),
        F.monotonically_increasing_id().alias("row")), "digests")
    best = F.max_by(F.struct("doc_id", "row"), F.struct(
        "n", F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("row"))).alias("best")
    sketch = rows.agg(F.expr(f"approx_top_k(d, {heavy}, {tracked})").alias("top"))
    named = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("d"))
    # at most `heavy` rows on either side of this broadcast, whatever the size of the table
    winners = saved(rows.join(F.broadcast(named), "d", "left_semi").groupBy("d").agg(
        F.count("*").alias("size"), best), "winners")
    frequent = rows.join(F.broadcast(winners), "d").select(
        "doc_id", "d", "size", F.col("best.doc_id").alias("keep_id"),
        (F.col("row") == F.col("best.row")).alias("kept"))
    group = W.partitionBy("d")
    order = group.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"), "row")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = rows.join(F.broadcast(winners.select("d")), "d", "left_anti").select(
        "doc_id", "d", F.count("*").over(whole).alias("size"),
        F.first("doc_id").over(order).alias("keep_id"), (F.row_number().over(order) == 1).alias("kept"))
    columns = ["doc_id", "keep_id", F.col("size").cast("bigint").alias("group_size"), "kept",
               F.col("d").alias("text_sha256")]
    return frequent.select(*columns).unionByName(rest.select(*columns))


def without_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that `copies` keeps, with all their columns; of repeated rows one stays."""
    stay = copies(docs, id, text, **options).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_d"))
    digested = docs.withColumn("_emberlog_digest", digest_of(F.col(f"`{text}`")))
    same = digested[id].eqNullSafe(stay["_id"]) & (digested["_emberlog_digest"] == stay["_d"])
    first = W.partitionBy(F.col(f"`{id}`"), "_emberlog_digest").orderBy(F.desc(F.length(F.col(f"`{text}`"))))
    return digested.join(stay, same, "left_semi").withColumn(
        "_emberlog_row", F.row_number().over(first)).filter(F.col("_emberlog_row") == 1).select(
        *[F.col(f"`{c}`") for c in docs.columns])
