"""The hash index and its maintenance (ST-3 to ST-6, DST-3, SRT-6, HSH history).

A batch of observations is replayed in one plan: windows per file over (observed_at, ordinal) find runs of one (hash, algo); a run is closed by
a rotation (same algo, other hash: it enters the history) or by an upgrade of the algo (it is replaced). What the index held before is the
first row of its file, so merging a batch and replaying all batches are the same plan.

A file's window is bounded by its observations in the batch, not by the table; repeated confirmations of one state are cut to the first
and last of a run before anything is kept.

Defined cases: observations without file, hash or time take no part; a null algo is full-sha256; equal times are ordered by ordinal; text values
carry over confirmations and upgrades and end with a rotation; history is oldest first, at most 20 entries, none older than 730 days
before the last rotation; entries without time stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.keys import blank_to_null, clean_hash, effective_algo

MAX_DAYS, MAX_ENTRIES = 730, 20
LATEST = ("file_name", "size", "etag", "site_path", "library")


def pruned(entries: Column, since: Column) -> Column:
    """ST-4: an array of entries (observed_at, ...), oldest first, without what is older than MAX_DAYS before ``since``; the last MAX_ENTRIES."""
    fresh = F.filter(entries, lambda e: e["observed_at"].isNull() | since.isNull() | (e["observed_at"] >= since - F.expr(f"INTERVAL {MAX_DAYS} DAYS")))
    return F.when(F.size(fresh) > MAX_ENTRIES, F.slice(fresh, -MAX_ENTRIES, MAX_ENTRIES)).otherwise(fresh)


def clean_observations(observations: DataFrame) -> DataFrame:
    rows = observations.select(
        "file_ref", clean_hash("hash").alias("hash"), effective_algo("algo").alias("algo"), "observed_at", "ordinal", "job_id",
        blank_to_null("text_hash").alias("text_hash"), F.when(blank_to_null("text_hash").isNotNull(), F.col("simhash64")).alias("simhash64"), *LATEST,
    )
    usable = rows.filter("file_ref is not null and file_ref != '' and hash is not null and observed_at is not null")
    return usable.dropDuplicates(["file_ref", "observed_at", "ordinal", "hash", "algo"])


def replayed_runs(observations: DataFrame) -> DataFrame:
    """ST-3: one row per run of (hash, algo) of a file: run, hash, algo, observed_at (first), confirmed_at and confirmed_by (last), text values, rotates, rotated_at."""
    by = W.partitionBy("file_ref").orderBy("observed_at", "ordinal", "hash", "algo")
    rows = clean_observations(observations)
    before = F.lag(F.struct("hash", "algo")).over(by)
    rows = rows.withColumn("_b", before)
    changed = F.col("_b").isNull() | (F.col("_b.hash") != F.col("hash")) | (F.col("_b.algo") != F.col("algo"))
    rotated = F.col("_b").isNotNull() & (F.col("_b.algo") == F.col("algo")) & (F.col("_b.hash") != F.col("hash"))
    upto = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"run": F.sum(changed.cast("int")).over(upto), "_seg": F.sum(rotated.cast("int")).over(upto)})
    carried = W.partitionBy("file_ref", "_seg").orderBy("observed_at", "ordinal", "hash", "algo").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(carried) for c in ("text_hash", "simhash64")})
    last = F.max_by(F.struct("observed_at", "job_id", "text_hash", "simhash64", *LATEST), F.struct("observed_at", "ordinal"))
    runs = rows.groupBy("file_ref", "run", "hash", "algo").agg(F.min("observed_at").alias("observed_at"), last.alias("_l"))
    order = W.partitionBy("file_ref").orderBy("run")
    following = F.lead(F.struct("algo", "observed_at")).over(order)
    runs = runs.withColumn("_n", following)
    return runs.select(
        "file_ref", "run", "hash", "algo", "observed_at", F.col("_l.observed_at").alias("confirmed_at"), F.col("_l.job_id").alias("confirmed_by"), "_l.text_hash", "_l.simhash64",
        *(F.col(f"_l.{c}").alias(c) for c in LATEST), (F.col("_n").isNotNull() & (F.col("_n.algo") == F.col("algo"))).alias("rotates"), F.col("_n").isNull().alias("is_current"), F.col("_n.observed_at").alias("ended_at"),
    )


def kept_history(runs: DataFrame) -> DataFrame:
    """ST-3, ST-4: the history entries that stay: those rotated out, not older than 730 days before the last rotation, the last 20 of a file."""
    rotated = runs.filter("rotates")
    last = rotated.groupBy("file_ref").agg(F.max("ended_at").alias("_last"))
    fresh = rotated.join(last, "file_ref").filter(F.col("observed_at") >= F.col("_last") - F.expr(f"INTERVAL {MAX_DAYS} DAYS"))
    place = F.row_number().over(W.partitionBy("file_ref").orderBy(F.col("run").desc()))
    return fresh.withColumn("_r", place).filter(F.col("_r") <= MAX_ENTRIES).drop("_r", "_last")


def replayed_index(observations: DataFrame) -> DataFrame:
    """ST-3: the whole index after all observations, history in an array, oldest first."""
    runs = replayed_runs(observations)
    entry = F.struct("observed_at", "run", "hash", "algo", F.col("confirmed_by").alias("observed_by"), "text_hash", "simhash64")
    past = kept_history(runs).groupBy("file_ref").agg(F.array_sort(F.collect_list(entry)).alias("previous"))
    now = runs.filter("is_current").select(
        "file_ref", F.col("hash").alias("current_hash"), "algo", *LATEST, F.col("confirmed_at").alias("last_confirmed_at"), F.col("confirmed_by").alias("last_confirmed_by"),
        F.col("observed_at").alias("current_hash_observed_at"), "text_hash", "simhash64",
    )
    return now.join(past, "file_ref", "left")


def merged_batch(index: DataFrame, batch: DataFrame) -> DataFrame:
    """ST-3 for one batch with one row per file at most: a full join and the rules as cases; files not in the batch stay as they are."""
    new = clean_observations(batch)
    new = new.groupBy("file_ref").agg(F.max_by(F.struct(*(c for c in new.columns if c != "file_ref")), F.struct("observed_at", "ordinal")).alias("n"))
    old = index.withColumn("_old", F.lit(True)).withColumn("algo", effective_algo("algo")).withColumn("current_hash", clean_hash("current_hash"))
    joined = old.join(new, "file_ref", "full")
    there, here = F.col("_old").isNotNull(), F.col("n").isNotNull()
    upgraded = there & here & (F.col("algo") != F.col("n.algo"))
    confirmed = there & here & ~upgraded & (F.col("current_hash") == F.col("n.hash"))
    rotated = there & here & ~upgraded & ~confirmed
    kind = dict(index.dtypes)["previous"]
    empty = F.array().cast(kind)
    fields = index.schema["previous"].dataType.elementType.names
    values = {"hash": F.col("current_hash"), "algo": F.col("algo"), "observed_at": F.col("current_hash_observed_at"), "observed_by": F.col("last_confirmed_by"), "text_hash": F.col("text_hash"), "simhash64": F.col("simhash64")}
    entry = F.array(F.struct(*(values[f].alias(f) for f in fields))).cast(kind)
    grown = pruned(F.concat(F.coalesce("previous", empty), entry), F.col("n.observed_at"))
    text = lambda c: F.when(~here, F.col(c)).when(upgraded | confirmed, F.coalesce(F.col(f"n.{c}"), F.col(c))).otherwise(F.col(f"n.{c}"))
    return joined.select(
        "file_ref",
        F.when(here, F.col("n.hash")).otherwise(F.col("current_hash")).alias("current_hash"),
        F.when(here, F.col("n.algo")).otherwise(F.col("algo")).alias("algo"),
        *(F.when(here, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in LATEST),
        F.when(here, F.col("n.observed_at")).otherwise(F.col("last_confirmed_at")).alias("last_confirmed_at"),
        F.when(here, F.col("n.job_id")).otherwise(F.col("last_confirmed_by")).alias("last_confirmed_by"),
        F.when(here & ~confirmed, F.col("n.observed_at")).otherwise(F.col("current_hash_observed_at")).alias("current_hash_observed_at"),
        text("text_hash").alias("text_hash"),
        text("simhash64").alias("simhash64"),
        F.when(rotated, grown).otherwise(F.coalesce("previous", empty)).alias("previous"),
        F.when(~there, "new").when(~here, "absent").when(upgraded, "upgraded").when(confirmed, "confirmed").otherwise("rotated").alias("change"),
    )


def overlaid(index: DataFrame, versions: DataFrame, now: Column) -> DataFrame:
    """ST-5, DST-3: recovered versions (file_ref, hash, algo, observed_at) put into the history: existing entries win, the current content stays out.

    Gives one row per entry of the new history: file_ref, hash, algo, observed_at, is_new; oldest first by observed_at, pruned.
    """
    own = index.select("file_ref", F.concat_ws(":", effective_algo("algo"), clean_hash("current_hash")).alias("_current"), F.coalesce("previous", F.array().cast(dict(index.dtypes)["previous"])).alias("_p"))
    old = own.select("file_ref", "_current", F.posexplode("_p").alias("_pos", "p")).select("file_ref", "_current", "_pos", clean_hash("p.hash").alias("hash"), effective_algo("p.algo").alias("algo"), F.col("p.observed_at").alias("observed_at"), F.lit(False).alias("is_new"))
    new = versions.select("file_ref", clean_hash("hash").alias("hash"), effective_algo("algo").alias("algo"), "observed_at").join(own.select("file_ref", "_current"), "file_ref")
    new = new.filter(F.concat_ws(":", "algo", "hash") != F.col("_current")).select("file_ref", "_current", F.lit(1 << 30).alias("_pos"), "hash", "algo", "observed_at", F.lit(True).alias("is_new"))
    known = old.select("file_ref", "algo", "hash").distinct()
    fresh = new.filter("hash is not null").join(known, ["file_ref", "algo", "hash"], "left_anti").groupBy("file_ref", "_current", "_pos", "algo", "hash", "is_new").agg(F.min("observed_at").alias("observed_at"))
    every = old.unionByName(fresh).filter(F.col("observed_at").isNull() | (F.col("observed_at") >= now - F.expr(f"INTERVAL {MAX_DAYS} DAYS")))
    place = F.row_number().over(W.partitionBy("file_ref").orderBy(F.col("observed_at").desc_nulls_last(), F.col("_pos").desc(), F.col("hash").desc()))
    return every.withColumn("_r", place).filter(F.col("_r") <= MAX_ENTRIES).select("file_ref", "hash", "algo", "observed_at", "is_new")


def inverted(index: DataFrame) -> DataFrame:
    """ST-6: (algo, hash, n_files, first_ref): the index by content; files stay rows of the index."""
    rows = index.select(effective_algo("algo").alias("algo"), clean_hash("current_hash").alias("hash"), "file_ref").filter("hash is not null and file_ref != ''").distinct()
    return rows.groupBy("algo", "hash").agg(F.count("*").alias("n_files"), F.min("file_ref").alias("first_ref"))
