"""Text functions (HSH-5 to HSH-10): normal form, text hash, shingles and the 64-bit fingerprint."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.keys import col

NEAR = 3
NO_DISTANCE = 64
N_BITS = 64


def normal_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """HSH-5: adds the compatibility form in lower case with single blanks; only texts that are not ASCII leave the JVM."""

    @F.pandas_udf("string")
    def compatible(values):
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(out, F.when(raw.rlike(r"^\p{ASCII}*$"), raw).otherwise(compatible(raw)))
    return df.withColumn(out, F.btrim(F.regexp_replace(F.lower(out), r"(?U)[\s ﻿]+", " ")))


def text_hash(c: Column | str) -> Column:
    """HSH-6: sha256 of a normal text, "" of none."""
    t = F.coalesce(col(c), F.lit(""))
    return F.when(t == "", F.lit("")).otherwise(F.sha2(t, 256))


def shingles(c: Column | str) -> Column:
    """HSH-7: all runs of three words, or the one run of all words where there are at most three."""
    words = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    n = F.size(words)
    triples = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= 3, F.array(F.array_join(words, " "))).otherwise(triples)


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """HSH-8: (key, simhash64): a bit is set where more shingles have it than not, repeats counted; null without words.

    Votes are partial sums in the map stage, so a long text or a repeated key is no single task's work.
    """
    each = df.select(key, F.explode(shingles(text)).alias("_s")).select(key, F.conv(F.substring(F.sha2("_s", 256), 1, 16), 16, -10).cast("bigint").alias("_h"))
    votes = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"_v{i}") for i in range(N_BITS)]
    counted = each.groupBy(key).agg(*votes)
    word = F.lit(0).cast("bigint")
    for i in range(N_BITS):
        bit = (1 << i) - (1 << 64 if i == 63 else 0)
        word = word.bitwiseOR(F.when(F.col(f"_v{i}") > 0, F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return counted.select(key, word.alias("simhash64"))


def distance(a: Column | str, b: Column | str) -> Column:
    """HSH-9: differing bits; 64 where one is missing."""
    return F.coalesce(F.bit_count(col(a).bitwiseXOR(col(b))), F.lit(NO_DISTANCE))


def is_near(a: Column | str, b: Column | str) -> Column:
    """HSH-10: at most NEAR bits apart."""
    return distance(a, b) <= NEAR


def hex_fingerprint(c: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(col(c)), 16, "0"))
