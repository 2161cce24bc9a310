"""Near-duplicates with small edits: adaptive multi-match prefixes.

A fingerprint is a set of N_TOKENS tokens, one per block of bits: (block, value). Fingerprints within RADIUS bits
differ in at most RADIUS tokens, so they share at least N_TOKENS - RADIUS. Tokens are ordered by their frequency, rare
ones first, over the whole input; then two such sets share at least ``l`` tokens among the first RADIUS + l of each, for
every level l. The levels trade keys for candidates: a longer prefix gives more keys, but more tokens must be
shared before a pair is verified.

Each record chooses its own level by estimated cost: keys to emit plus expected partners under them, from the
token frequencies. As a pair is sought from one side only, that side's level decides, and the other side is
indexed under all levels in use. Records meet under a choice of ``l`` shared prefix tokens, so that no list of a single
frequent token is ever walked.

The frequency table has N_TOKENS * 256 rows whatever the input, which bounds what is sent to every task.

Defined cases: versions without text or content take no part; equal contents are no pair, equal fingerprints of different
contents are one of distance 0; a file is never paired with itself; repeats count once; empty input gives no pairs.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 3
N_TOKENS = 8
LEVELS = (1, 2, 3, 4)
#: Cost of a key to write, sort and read, as a multiple of that of a candidate to verify.
KEY_COST = 4.0


def _tokens(x: Column) -> Column:
    return F.array(*(F.call_function("shiftrightunsigned", x, F.lit(8 * b)).bitwiseAND(F.lit(255)).cast("int") + F.lit(256 * b) for b in range(N_TOKENS)))


def ordered_tokens(prints: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, int]:
    """Adds _t: tokens by frequency then id, and _p: their shares of all records; returns the number of records too."""
    counts = prints.select(F.explode(_tokens(F.col("simhash"))).alias("token")).groupBy("token").count().collect()
    frequency = [0] * (256 * N_TOKENS)
    for row in counts:
        frequency[row["token"]] = row["count"]
    total = sum(frequency[:256])
    known = F.from_json(F.lit(json.dumps(frequency)), "array<bigint>")
    pairs = F.array_sort(F.transform(_tokens(F.col("simhash")), lambda t: F.struct(F.element_at(known, t + 1).alias("f"), t.alias("t"))))
    spread = prints.withColumn("_o", pairs)
    return spread.select(*prints.columns, F.col("_o.t").alias("_t"), F.transform("_o.f", lambda f: f / F.lit(max(1, total))).alias("_p")), total


def _choices(level: int, radius: int) -> list[tuple[int, ...]]:
    return list(combinations(range(radius + level), level))


def level_cost(level: int, total: int, radius: int = RADIUS) -> Column:
    """Keys to emit plus expected candidates under them, taking tokens as independent."""
    choices = _choices(level, radius)
    expected = None
    for chosen in choices:
        share = F.lit(float(total))
        for i in chosen:
            share = share * F.col("_p")[i]
        expected = share if expected is None else expected + share
    return F.lit(KEY_COST * len(choices)) + expected


def _keys(level: int, radius: int) -> Column:
    keys = []
    for chosen in _choices(level, radius):
        word = F.lit(level).cast("long")
        for i in chosen:
            word = word * F.lit(2048) + F.col("_t")[i]
        keys.append(word)
    return F.array(*keys)


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(a, b, distance), a < b: all pairs of distinct fingerprints within radius. prints: distinct simhash."""
    levels = tuple(x for x in levels if radius + x <= N_TOKENS)
    spread, total = ordered_tokens(prints, radius)
    costs = [level_cost(x, total, radius) for x in levels]
    level = F.lit(levels[-1])
    best = F.least(*costs) if len(costs) > 1 else costs[0]
    for x, cost in reversed(list(zip(levels, costs))):
        level = F.when(cost <= best, F.lit(x)).otherwise(level)
    chosen = spread.withColumn("_level", level)
    used = sorted(r["_level"] for r in chosen.select("_level").distinct().collect())
    own = None
    for x in used:
        own = F.when(F.col("_level") == x, _keys(x, radius)) if own is None else own.when(F.col("_level") == x, _keys(x, radius))
    if own is None:
        return prints.select(F.col("simhash").alias("a"), F.col("simhash").alias("b"), F.lit(0).alias("distance")).limit(0)
    asked = chosen.select(F.col("simhash").alias("a"), F.explode(own).alias("_key"))
    held = chosen.select(F.col("simhash").alias("b"), F.explode(F.concat(*(_keys(x, radius) for x in used))).alias("_key"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return asked.join(held, "_key").filter((F.col("a") < F.col("b")) & (distance <= radius)).select("a", "b", distance.alias("distance")).distinct()


def near_files(versions: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(file_ref_a, file_ref_b), a < b: files with near versions of different content.

    versions: file_ref, content, simhash. Pairs are sought among distinct fingerprints and only the ones found are
    spread to contents and files, so that copies cost nothing until they are output.
    """
    held = versions.filter("simhash is not null and content is not null").select("file_ref", "content", "simhash").distinct()
    prints = held.select("simhash").distinct()
    contents = held.select("simhash", "content").distinct()
    apart = near_fingerprints(prints, radius).select("a", "b")
    one, two = (contents.select(F.col("simhash").alias(s), F.col("content").alias(f"c_{s}")) for s in ("a", "b"))
    spread = apart.join(one, "a").join(two, "b").filter(F.col("c_a") != F.col("c_b"))
    equal = one.join(two.withColumnRenamed("b", "a"), "a").filter(F.col("c_a") < F.col("c_b")).select("a", F.col("a").alias("b"), "c_a", "c_b")
    pairs = spread.select("a", "b", "c_a", "c_b").unionByName(equal)
    x, y = (held.select(F.col("simhash").alias(s), F.col("content").alias(f"c_{s}"), F.col("file_ref").alias(f"f_{s}")) for s in ("a", "b"))
    files = pairs.join(x, ["a", "c_a"]).join(y, ["b", "c_b"]).filter(F.col("f_a") != F.col("f_b"))
    return files.select(F.least("f_a", "f_b").alias("file_ref_a"), F.greatest("f_a", "f_b").alias("file_ref_b")).distinct()
