"""Helpers of the operators in this folder: written intermediates, global positions, worker caches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from emberlog.session import ship


#: Bins of a counting table, and their number in one row of a task's counts.
BINS, CHUNK = 1 << 26, 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, `spark.checkpoint.dir`; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("emberlog.scratch", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="emberlog-scratch-")
        spark.conf.set("emberlog.scratch", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/emberlog-{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    It is computed once, its lineage ends here, and a lost executor costs nothing but its own tasks.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._emberlog_path = path
    return out


def numbered(rows: DataFrame, order: list[str | Column], position: str = "position",
             name: str = "numbered") -> DataFrame:
    """The rows with their place from 0 in the total order, without a single-task sort.

    One range shuffle sorts the rows; places inside a partition come from the row number there, and a
    table of one row per partition adds what stands before it. Ties get any order, fixed once written.
    """
    inside = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_emberlog_id", F.monotonically_increasing_id()), name).withColumn(
        "_emberlog_part", F.shiftright("_emberlog_id", 33)).withColumn(
        "_emberlog_row", F.col("_emberlog_id").bitwiseAND((1 << 33) - 1))
    before = F.coalesce(F.sum("_emberlog_n").over(W.orderBy("_emberlog_part").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    # one row per shuffle partition, so its size is bounded by the partition count
    starts = inside.groupBy("_emberlog_part").agg(F.count("*").alias("_emberlog_n")).select(
        "_emberlog_part", before.alias("_emberlog_before"))
    return inside.join(F.broadcast(starts), "_emberlog_part").withColumn(
        position, F.col("_emberlog_row") + F.col("_emberlog_before")).drop(
        "_emberlog_part", "_emberlog_row", "_emberlog_id", "_emberlog_before")


class Memo(dict):
    """A bounded cache of a pure function, for use inside a Python worker.

    `map(memo.__getitem__, keys)` runs at the speed of dict lookups. When `limit` entries are held they
    become the old generation, and the older one goes; entries in use come back on their next miss.
    """

    def __init__(self, compute: Callable, limit: int = 200_000) -> None:
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """What is computed in this block passes at most `rows` rows at a time between Spark and Python.

    Spark's usual 10 000 whole texts are held several times over, by the JVM and by each Python worker; as
    many as Parquet's reader decodes at a time, 4096, are held by it.
    """
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in before.items():
        spark.conf.set(key, str(min(int(value), rows) if int(value) > 0 else rows))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def only(docs: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so extra columns can clash with nothing."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def attach(rows: DataFrame, table: DataFrame, keys: list[str], size: str, heavy: int = 1000) -> DataFrame:
    """Inner join of rows with a table of one row per key, of which `size` counts the key's rows.

    The `heavy` largest keys, so a bounded number, are broadcast and leave their rows where they are; any
    other key has less than 1/heavy of the rows and goes through an ordinary shuffle.
    """
    hot = saved(table.orderBy(F.desc(size), *keys).limit(heavy), "hot")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def is_set(bits: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Whether the bits of these bins are set."""
    return (bits[bins >> 3] >> (7 - (bins & 7)).astype(np.uint8) & 1).astype(bool)


def full_bins(rows: DataFrame, found: Callable[[pa.RecordBatch], Iterator[np.ndarray]], least: int) -> np.ndarray:
    """One bit per bin of a counting table: whether `least` or more of what is found fall into it.

    `found` gives the bins of a batch. A bin's count is at least that of each thing in it, so what falls
    into a bin that isn't full occurs less often than `least`. Tasks count up to `least`, at most 255,
    which is enough to tell; they pass on the bins in use, the sums are made by a shuffle over chunks of
    bins, and the driver gets one bit per bin (8 MB).
    """
    cap = min(least, 255)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, few, held = None, [], 0
        for batch in batches:
            for bins in found(batch):
                if counts is None and (held := held + len(bins)) <= CHUNK:
                    few.append(bins)
                    continue
                if counts is None:
                    counts, bins, few = np.zeros(BINS, dtype=np.uint8), np.concatenate([*few, bins]), []
                used, n = np.unique(bins, return_counts=True)
                counts[used] = np.minimum(counts[used] + n, cap)
        if counts is None:  # no table for a few bins
            used, n = np.unique(np.concatenate([np.zeros(0, np.int64), *few]), return_counts=True)
            n = np.minimum(n, cap).astype(np.uint8)
        else:
            used = np.flatnonzero(counts != 0)
            n = counts[used]
        edges = np.flatnonzero(np.diff(used // CHUNK, prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(used)]):
            part = used[lo:hi]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(part[0]) // CHUNK], pa.int32()),
                 pa.array([(part % CHUNK).astype(np.uint16).tobytes()], pa.binary()),
                 pa.array([n[lo:hi].tobytes()], pa.binary())], names=["chunk", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, places, counts in zip(*(batch.column(c) for c in range(3))):
                total = sums.setdefault(chunk.as_py(), np.zeros(CHUNK, dtype=np.uint8))
                at = np.frombuffer(places.as_py(), dtype=np.uint16)
                more = total[at].astype(np.int64) + np.frombuffer(counts.as_py(), dtype=np.uint8)
                total[at] = np.minimum(more, cap)
        for chunk, total in sums.items():
            bits = np.packbits(total >= cap)
            if bits.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits.tobytes()], pa.binary())],
                                                 names=["chunk", "bits"])

    out = np.zeros(BINS // 8, dtype=np.uint8)
    counted = rows.mapInArrow(count, "chunk int, places binary, counts binary").repartition("chunk")
    for chunk, bits in counted.mapInArrow(add, "chunk int, bits binary").collect():
        out[chunk * CHUNK // 8:(chunk + 1) * CHUNK // 8] = np.frombuffer(bits, dtype=np.uint8)
    return out


def forget(df: DataFrame | None) -> None:
    """Delete what `saved` has written for a DataFrame that nothing will read any more."""
    path = getattr(df, "_emberlog_path", None)
    if path is not None:
        hadoop_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64."""
    out = np.full(max(1, n), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in UTF-8 text, the same in every process, and where they start.

    Words are what white space (space and U+0009 to U+000D) parts.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    letters = b[inside].astype(np.uint64) + np.uint64(1)
    letters *= powers(int(lengths.max()))[np.arange(len(letters)) - np.repeat(first, lengths)]
    return mix(np.add.reduceat(letters, first)), starts
