"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Pin what results depend on; leave sizing to the cluster's own settings.

    UTC keeps times comparable, AQE coalesces small shuffles and splits skewed join partitions.
    A checkpoint directory is taken from `spark.checkpoint.dir` and never invented here.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local(cores: str | int = "*", memory: str = "8g", **conf) -> SparkSession:
    """A local session for tests and benches."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("emberlog")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.session.timeZone", "UTC"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the executors, once per application.

    Functions that run in Python workers are pickled by reference, so workers must be able to import
    this package even if it is not installed there and the session was started from another folder.
    """
    context = spark.sparkContext
    if _SHIPPED.get("to") == context.applicationId:
        return spark
    package = Path(__file__).resolve().parent
    zipped = Path(tempfile.mkdtemp(prefix="emberlog-")) / "emberlog.zip"
    with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(zipped))
    _SHIPPED["to"] = context.applicationId
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share (`spark.checkpoint.dir`).

    A local session without that setting gets a temporary folder; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="emberlog-scratch-")
    return f"{base.rstrip('/')}/emberlog-{name}-{uuid.uuid4().hex}"
