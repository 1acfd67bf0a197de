"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; the fraction (rank + 1/2) / size of the
source then spreads every source evenly over the whole order, so any cut of it holds each source in its
share of the mixture. Both orders are range sorts of narrow rows: a source with a third of all rows is
ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog.llm.common import numbered, only, saved


def sharded(docs: DataFrame, shards: int = 40, *, id: str = "doc_id", text: str = "text",
            source: str = "source", seed: int = 20, overhead: int = 16) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: shard sizes differ by one row at most. A shard has its share of every source up to
    one row and that share of the number of sources, whatever the shard's size. Size is the text's UTF-8
    bytes plus `overhead`; null texts have no bytes. A null source is a source of its own. Repeated rows
    are rows like any other. Slots count from 0 in each shard. `grown_shard` is null, as this law has no
    stable growth. An empty table gives no rows.
    """
    content = F.coalesce("text", F.lit(""))
    rows = only(docs, id, text, source).toDF("doc_id", "text", "source").select(
        "doc_id", "source", (F.octet_length(content) + overhead).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")).alias("key"))
    within = numbered(saved(rows, "sizes"), ["source", "key", "doc_id"], name="by_source")
    sources = within.groupBy("source").agg(F.min("position").alias("first"), F.count("*").alias("rows"))
    apart = within.join(sources.withColumnRenamed("source", "_source"),
                        F.col("source").eqNullSafe(F.col("_source")), "left")
    # the fraction as a double orders a source's rows rightly up to 2^52 of them; `key` breaks ties
    spread = apart.select("doc_id", "source", "size", "text_crc32", "key", (
        (F.col("position") - F.col("first") + 0.5) / F.col("rows")).alias("fraction"))
    total = rows.count()
    placed = numbered(spread, ["fraction", "key", "source", "doc_id"], name="interleaved")
    shard = F.expr(f"position * {shards} div {max(1, total)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), (F.col("position") - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
