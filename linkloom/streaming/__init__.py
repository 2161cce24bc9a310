"""Structured Streaming forms of the incremental operators (ST-12, ST-3, ST-9).

Batches of observations or scan results arrive as files; each micro-batch goes through the same operator as a batch job does, so stream and batch
cannot differ. Queries run with ``availableNow`` by default: they take what is there, commit and end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from linkloom.operators import hashindex
from linkloom.operators.store import Store


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """One query over all there is; ``each`` gets a micro-batch and its id, and may be called twice with the same id after a failure."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(stream: DataFrame, store: Store, key: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """ST-9: the last row of each key, kept in a store. Applying a batch twice changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        new = batch.filter(F.col(key).isNotNull() & (F.col(key) != ""))

        def change(old: DataFrame | None) -> DataFrame:
            every = new if old is None else old.unionByName(new)
            rest = [c for c in every.columns if c != key]
            return every.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(key, "_l.*").select(*every.columns)

        store.update(change)

    return run(stream, each, checkpoint)


def indexed(stream: DataFrame, observations: Store, index: Store, checkpoint: str) -> StreamingQuery:
    """ST-3: observations are appended to their log, and the index is what replaying the log gives for the files of the batch; others stay.

    Late rows fall into their place in time. A batch that comes twice changes nothing, as repeated observations are one.
    """

    def each(batch: DataFrame, _: int) -> None:
        files = batch.select("file_ref").filter("file_ref is not null").distinct()

        def log(old: DataFrame | None) -> DataFrame:
            return batch if old is None else old.unionByName(batch).dropDuplicates(["file_ref", "ordinal", "hash", "observed_at"])

        observations.update(log)

        def change(old: DataFrame | None) -> DataFrame:
            fresh = hashindex.replayed_index(observations.read().join(files, "file_ref", "left_semi"))
            return fresh if old is None else old.join(files, "file_ref", "left_anti").unionByName(fresh)

        index.update(change)

    return run(stream, each, checkpoint)


def windowed_arrivals(stream: DataFrame, at: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Arrivals per window of event time; rows later than ``late`` are left out of the stream's counts. Works on batches too."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_at", late)
    return timed.groupBy(F.window("_at", window).alias("_w"), "job_id").agg(F.count("*").alias("n")).select(F.col("_w.start").alias("window_start"), "job_id", "n")
