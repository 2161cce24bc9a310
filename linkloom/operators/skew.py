"""Per-key results where a few keys hold most records: two-stage salted aggregation.

Heavy keys get a salt appended; partial results are made per (key, salt) and merged by key. The salt is a hash of
what is counted as distinct, so that it spreads like a random one, stays the same when a lost task runs again, and
keeps each distinct source within one salt: partial distinct counts add up exactly.

Heavy keys are those above ``1 / max_heavy`` of all records, at most ``max_heavy`` keys, so their broadcast is bounded.

Defined cases: records with a null or blank key are left out; a null source counts as one source of its own; null
or unknown sites are hidden; repeated rows count as links, not as sources; empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HEAVY = 1000


def salted_counts(records: DataFrame, key: str, source: list[str], visible: str, n_salts: int = 64, max_heavy: int = MAX_HEAVY, weight: str | None = None) -> DataFrame:
    """(key, n_links, n_sources, visible_sources, hidden_count) of every key.

    ``visible`` is a boolean column; a source is visible if any of its rows is. ``weight`` is the number of
    records a row stands for.
    """
    n = F.col(weight) if weight else F.lit(1).cast("long")
    rows = records.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_s{i}") for i, c in enumerate(source)), F.coalesce(F.col(visible), F.lit(False)).alias("_visible"), n.alias("_n"))
    rows = rows.filter(F.col("_key").isNotNull() & (F.col("_key") != ""))
    names = [f"_s{i}" for i in range(len(source))]
    total = rows.agg(F.sum("_n").alias("n")).first()["n"] or 0
    heavy = rows.groupBy("_key").agg(F.sum("_n").alias("_all")).filter(F.col("_all") * max_heavy > total).select("_key", F.lit(True).alias("_heavy"))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*names), F.lit(n_salts))).otherwise(F.lit(0).cast("long"))
    salted = rows.join(F.broadcast(heavy), "_key", "left").withColumn("_salt", salt)
    sources = salted.groupBy("_key", "_salt", *names).agg(F.sum("_n").alias("_n"), F.max("_visible").alias("_visible"))
    partial = sources.groupBy("_key", "_salt").agg(F.sum("_n").alias("_n"), F.count("*").alias("_sources"), F.count_if("_visible").alias("_seen"))
    return partial.groupBy(F.col("_key").alias(key)).agg(
        F.sum("_n").alias("n_links"),
        F.sum("_sources").alias("n_sources"),
        F.sum("_seen").alias("visible_sources"),
        (F.sum("_sources") - F.sum("_seen")).alias("hidden_count"),
    )
