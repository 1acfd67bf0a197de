"""Detectors over streams: windowed counts with watermarks, and re-ranking as findings arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberlog import functions as fn


def _window(rows: DataFrame, delay: str, size: str, keys) -> DataFrame:
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), *keys)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").alias("window_start"), *[c for c in df.columns if c != "w"])


def windowed_failures(rows: DataFrame, size: str = "1 hour", delay: str = "10 minutes",
                      minimum: int = 10) -> DataFrame:
    """Failures per principal and window; rows later than the watermark are dropped.

    State is one counter per open (window, principal), however many rows a principal has.
    """
    out = _window(rows.filter("failed"), delay, size, ["principal"]).agg(
        F.count("*").alias("failures"))
    return _flat(out.filter(F.col("failures") >= minimum))


def windowed_repeats(flows: DataFrame, size: str = "1 hour", delay: str = "10 minutes",
                     minimum: int = 10) -> DataFrame:
    """Repeated (source, destination, port) per window with bytes."""
    out = _window(flows, delay, size, ["src", "dst", "dport"]).agg(
        F.count("*").alias("flows"), F.sum("bytes").alias("total_bytes"))
    return _flat(out.filter(F.col("flows") >= minimum))


def windowed_errors(http: DataFrame, size: str = "1 hour", delay: str = "10 minutes",
                    minimum: int = 30) -> DataFrame:
    """4xx answers per public client and window."""
    bad = http.filter(F.col("status").startswith("4") & ~fn.is_private(F.col("src")))
    out = _window(bad, delay, size, ["src"]).agg(F.count("*").alias("errors"))
    return _flat(out.filter(F.col("errors") >= minimum))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream to Parquet until the available input is used up (exactly once per batch)."""
    return (stream.writeStream.outputMode(mode).format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_to_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a windowed stream over what is available; `path` then holds the state of all windows.

    Every micro-batch replaces the result whole (complete mode), so a batch that runs again does no harm.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(path)

    def replace(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(path)

    (stream.writeStream.outputMode("complete").foreachBatch(replace).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()).awaitTermination()


def refresh_rankings(findings: DataFrame, ledger_path: str, out_path: str, checkpoint: str):
    """Append new findings to the ledger and re-rank the cases they belong to.

    The ledger is partitioned by case and then by micro-batch: a batch that runs again after a failure
    replaces its own partitions, and only those of touched cases are read for the new ranking. Of a
    finding that came again in a later batch only the latest state counts.
    """
    from emberlog.operators.intel import ranked_hypotheses
    from emberlog.sinks.tables import latest

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("case_id", "batch").parquet(ledger_path)
        # case ids stay text whatever they look like, so their type is not guessed from folder names
        ledger = spark.read.schema(df.schema.add("batch", "long")).parquet(ledger_path)
        touched = ledger.filter(F.col("batch") == batch_id).select("case_id").distinct()
        current = latest(ledger.join(touched, "case_id", "left_semi"), ["case_id", "finding_id"], "batch")
        ranked_hypotheses(current.drop("batch")).write.mode("overwrite").parquet(
            f"{out_path}/batch={batch_id}")

    return (findings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
