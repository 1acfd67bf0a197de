"""Parquet tables that grow by atomic commits, for writers that don't know of each other.

A commit writes its rows to a folder of its own and then claims the next version number by linking a
manifest to it; that either succeeds as a whole or fails because another writer has the number. Readers
take the folders that manifests name, so they never see half a commit, and a lost executor or a killed
writer leaves at most a folder that no manifest names. There is one small manifest per commit.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

Settle = Callable[[DataFrame, DataFrame], DataFrame]


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as Hadoop spells it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, store.makeQualified(at)


def _claim(spark: SparkSession, path: str, version: int, manifest: dict) -> bool:
    """Publish a manifest as this version; false when the version is taken.

    Local and mounted folders link a finished file, elsewhere a finished file is renamed; stores whose
    rename replaces a file silently (some object stores) are not safe for two writers.
    """
    store, folder = _hadoop(spark, f"{path}/versions")
    store.mkdirs(folder)
    target = f"{folder.toString()}/{version:012d}.json"
    text = json.dumps(manifest)
    if urlparse(target).scheme == "file":
        local = unquote(urlparse(target).path)
        draft = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(draft, "w") as out:
            out.write(text)
        try:
            os.link(draft, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    draft = hadoop_path(f"{folder.toString()}/.{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    won = not store.exists(hadoop_path(target)) and store.rename(draft, hadoop_path(target))
    if not won:
        store.delete(draft, False)
    return bool(won)


def manifests(spark: SparkSession, path: str, after: int = 0) -> list[dict]:
    """Manifests of the commits after a version, in order: version, kind, folder and schema."""
    store, folder = _hadoop(spark, f"{path}/versions")
    if not store.exists(folder):
        return []
    names = [(int(s.getPath().getName()[:12]), s.getPath().toString()) for s in store.listStatus(folder)
             if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith(".")]
    wanted = sorted(n for n in names if n[0] > after)
    if not wanted:
        return []
    read = {r["_file"]: r["value"] for r in spark.read.text([p for _, p in wanted], wholetext=True).select(
        "value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file")).collect()}
    return [{"version": v, **json.loads(read[p.rsplit("/", 1)[1]])} for v, p in wanted]


def read(spark: SparkSession, path: str, commits: list[dict]) -> DataFrame:
    """Rows of these commits, which have one schema, and the version that brought each."""
    schema = StructType.fromJson(commits[-1]["schema"])
    rows = spark.read.schema(schema.add("commit", "string")).option("basePath", f"{path}/data").parquet(
        *[f"{path}/data/commit={c['folder']}" for c in commits])
    # one row per commit
    versions = spark.createDataFrame([(c["folder"], c["version"]) for c in commits], "commit string, version bigint")
    return rows.join(F.broadcast(versions), "commit").drop("commit")


def append(rows: DataFrame, path: str, kind: str = "rows", settle: Settle | None = None, partition_by=()) -> dict:
    """Commit rows; returns the manifest.

    `settle(rows, committed)` takes out what the table has; it is applied to all commits before the first
    try, and to the commits of other writers whenever one of them was faster. Without it rows are
    appended as they are.
    """
    spark = rows.sparkSession
    schema = rows.schema
    before = [m for m in manifests(spark, path)]
    known = [m for m in before if m["kind"] == kind]
    if settle is not None and known:
        rows = settle(rows, read(spark, path, known))
    last = before[-1]["version"] if before else 0
    while True:
        folder = uuid.uuid4().hex
        rows.write.partitionBy(*partition_by).parquet(f"{path}/data/commit={folder}")
        manifest = {"kind": kind, "folder": folder, "schema": schema.jsonValue()}
        while not _claim(spark, path, last + 1, manifest):
            newer = manifests(spark, path, last)
            last = newer[-1]["version"]
            newer = [m for m in newer if m["kind"] == kind]
            if settle is not None and newer:
                mine = read(spark, path, [manifest | {"version": 0}]).drop("version")
                rows = settle(mine, read(spark, path, newer))
                break
        else:
            return manifest | {"version": last + 1}
