"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName("linkloom")
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset and everything runs in one process (``local``, ``local[...]``: tests), a temporary folder is made and
    removed at exit; on any other master an unset folder is an error, as no machine-local folder may stand in for it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="linkloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused place in the shared folder, removed when the application ends.

    Results are lazy scans of what is written there, so nothing may be removed before.
    """
    path = f"{shared_dir(spark).rstrip('/')}/linkloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a scan of what was written.

    Cuts the lineage: a lost executor costs no recomputation of what is behind the table. Unlike
    checkpoint() the result is columnar, so later reads prune columns and the planner knows its size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
