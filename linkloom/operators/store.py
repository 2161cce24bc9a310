"""Sinks and the versioned store (SNK-1 to SNK-9, ST-19)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Somebody else has written since the version was read."""


class Store:
    """SNK-8, SNK-9: one table in versions. A write makes a new version folder, then creates the pointer of the next number.

    Creating a pointer that exists fails, on every file system with atomic creation, so of two writers that read the same version one wins and the other
    tries again on what the first has written. Readers see whole versions only.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._cached: tuple[int, DataFrame] | None = None

    def version(self) -> int:
        """The current version, 0 before the first write."""
        marks = self._p(f"{self.path}/versions")
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(marks)), default=0) if self._fs.exists(marks) else 0

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._p(f"{self.path}/versions/{version}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version's rows, the current one unless given; None where nothing was written yet."""
        v = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/data/{self._folder(v)}") if v else None

    def cached(self) -> DataFrame | None:
        """ST-19: the current version, kept in memory until there is another one."""
        v = self.version()
        if self._cached is None or self._cached[0] != v:
            if self._cached:
                self._cached[1].unpersist()
            df = self.read(v) if v else None
            self._cached = (v, df.persist()) if df is not None else None
        return self._cached[1] if self._cached else None

    def replace(self, df: DataFrame, expected: int, partition_by: list[str] | None = None) -> int:
        """SNK-9: the whole table anew, as the version after ``expected``; Conflict where that is there already."""
        name = uuid.uuid4().hex
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/data/{name}")
        pointer = self._p(f"{self.path}/versions/{expected + 1}")
        try:
            stream = self._fs.create(pointer, False)
        except Exception as e:
            self._fs.delete(self._p(f"{self.path}/data/{name}"), True)
            raise Conflict(f"version {expected + 1} is there already") from e
        stream.write(bytearray(name.encode()))
        stream.close()
        return expected + 1

    def update(self, change, attempts: int = 3) -> int:
        """SNK-8: ``change`` (current rows or None -> new rows) applied and written, again on what others wrote meanwhile, ``attempts`` times."""
        for left in range(attempts - 1, -1, -1):
            v = self.version()
            try:
                return self.replace(change(self.read(v) if v else None), v)
            except Conflict:
                if not left:
                    raise
        raise Conflict("no attempt was made")


def write_results(df: DataFrame, path: str) -> None:
    """SNK-1, SNK-2: results by job; writing a job again replaces its part only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def results_json(df: DataFrame, key: str = "job_id") -> DataFrame:
    """SNK-1: each row as JSON, for the edge."""
    return df.select(key, F.to_json(F.struct(*(c for c in df.columns if c != key))).alias("body"))


def manifest(fragments: DataFrame) -> DataFrame:
    """SNK-3: fragments (site_idx, ordinal, ...) in one list, numbered in scan order without one task for all: places come from counts per site and the order within."""
    from pyspark.sql import Window as W

    sizes = fragments.groupBy("site_idx").agg(F.count("*").alias("_n"))
    # One row a site: the running sum is over sites, not files.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("site_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("site_idx").orderBy("ordinal"))
    return fragments.withColumn("_i", inside).join(starts, "site_idx").withColumn("place", F.col("_start") + F.col("_i")).drop("_start", "_i")


def csv_field(c: Column | str) -> Column:
    """A value as CSV writes it: quoted where it holds a quote, comma or line end, quotes doubled; null is empty."""
    v = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """SNK-4 to SNK-7: (line): rows as CSV text; booleans are yes and no."""
    kinds = dict(df.dtypes)
    shown = [F.when(F.col(c), "yes").otherwise("no") if kinds[c] == "boolean" else F.col(c) for c in columns]
    return df.select(F.concat_ws(",", *(csv_field(v) for v in shown)).alias("line"))


def write_csv(df: DataFrame, columns: list[str], path: str, header: list[str] | None = None) -> None:
    """The same into files with CRLF lines, every part with the header."""
    kinds = dict(df.dtypes)
    shown = [(F.when(F.col(c), "yes").otherwise("no") if kinds[c] == "boolean" else F.col(c)).alias(h) for c, h in zip(columns, header or columns)]
    df.select(*shown).write.mode("overwrite").option("header", "true").option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def without_scheme(c: Column | str) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "(?i)^https?://", "")
