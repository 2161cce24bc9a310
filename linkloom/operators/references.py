"""References to records that do not exist.

A Bloom filter of the parent keys is broadcast; a reference it rejects is an orphan for certain. Only those it
lets pass are joined exactly with the parents; then orphans are counted per relation and period.

The filter is blocked: each key sets four bits of one 64-bit word, the words are a table (block, bits). Its
size is proven: at most ``max_words`` rows, whatever the number of parents. Beyond the size for which it is
meant more references pass and are joined exactly; the result stays the same.

Defined cases: references without key or relation are no references; parents without key are ignored; a null period is
reported as null; repeated references are counted, their key is reported once; no parents at all makes
every reference an orphan; empty references give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import materialize

BITS_PER_KEY = 16
MAX_WORDS = 1 << 20


def _block(n_words: int) -> Column:
    return F.pmod(F.xxhash64("relation", "key"), F.lit(n_words)).alias("_block")


def _mask() -> Column:
    bits = F.xxhash64(F.lit(7), "key", "relation")
    word = None
    for i in range(4):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", bits, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int"))
        word = bit if word is None else word.bitwiseOR(bit)
    return word.alias("_mask")


def bloom_words(parents: DataFrame, n_words: int) -> DataFrame:
    """(_block, _bits): the filter's non-zero words, at most n_words rows."""
    return parents.select(_block(n_words), _mask()).groupBy("_block").agg(F.bit_or("_mask").alias("_bits"))


def find_orphans(references: DataFrame, parents: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """Orphan references: the rows of ``references`` whose (relation, key) no row of ``parents`` has.

    references: relation, key, ref_key, period, n_refs (already counted per distinct row, which keeps hot
    keys to one row a period); parents: relation, key. Adds ``proof``: ``filter`` or ``join``.
    """
    known = materialize(parents.select("relation", "key").filter("key is not null and relation is not null").distinct(), "parents")
    n_words = max(1, min(max_words, known.count() * BITS_PER_KEY // 64))
    words = bloom_words(known, n_words)
    usable = references.filter("key is not null and relation is not null")
    probed = usable.withColumns({"_block": _block(n_words), "_mask": _mask()}).join(F.broadcast(words), "_block", "left")
    passed = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    flagged = materialize(probed.withColumn("_passed", passed).drop("_block", "_mask", "_bits"), "references")
    certain = flagged.filter(~F.col("_passed")).withColumn("proof", F.lit("filter"))
    checked = flagged.filter("_passed").join(known, ["relation", "key"], "left_anti").withColumn("proof", F.lit("join"))
    return certain.unionByName(checked).drop("_passed")


def report(orphans: DataFrame) -> DataFrame:
    """(kind, period, n_keys, n_refs): distinct orphan keys and references per relation and period."""
    per_key = orphans.groupBy("relation", "period", "ref_key").agg(F.sum("n_refs").alias("n_refs"))
    return per_key.groupBy(F.col("relation").alias("kind"), "period").agg(F.count("*").alias("n_keys"), F.sum("n_refs").alias("n_refs"))
