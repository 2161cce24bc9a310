"""Duplicate signals over the hash index (JN-4 to JN-8, JN-16, AGG-5, AGG-6, FLT-5, FLT-9, ACL-3, ACL-4, SRT-1, SRT-2).

``base`` is the index with lower-case hashes, the effective algo and suppressed files taken out; all signals start there. A file that
comes twice is the record confirmed last. Pairs have the smaller file_ref first. Every pair join is on equality (hash, name, band of the
fingerprint), so none is a product of the tables; a name or ancestor that many files share gives as many pairs as the signal has.

Defined cases: files without reference or hash take no part; a null algo is full-sha256; null names have no same-name signal;
versions without text are in no near or diverged signal; empty tables give empty signals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text, urls
from linkloom.functions.keys import blank_to_null, clean_hash, effective_algo
from linkloom.operators import acl

BANDS = 4
CAPS = {"exact": 200, "stale": 500, "same_name": 500, "near": 500, "diverged": 500}
MOST = 5000


@dataclass
class Allowlist:
    """FLT-5: hashes and path globs take files out of all signals, name globs out of same-name only."""

    hashes: Sequence[str] = ()
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def hash_allowed(df: DataFrame, listed: DataFrame, column: str = "current_hash") -> DataFrame:
    """Rows whose hash is not in ``listed`` (hash), in any case; small lists are sent to all tasks by the planner."""
    out = listed.select(F.lower("hash").alias("_h")).distinct()
    return df.join(out, F.lower(column) == F.col("_h"), "left_anti")


def base(index: DataFrame, allow: Allowlist = Allowlist()) -> DataFrame:
    """The index's files once each, in clean form, without those that the allowlist suppresses."""
    rows = index.select(
        "file_ref", clean_hash("current_hash").alias("current_hash"), effective_algo("algo").alias("algo"), blank_to_null("file_name").alias("file_name"), "size",
        blank_to_null("site_path").alias("site_path"), blank_to_null("library").alias("library"), "current_hash_observed_at", blank_to_null("text_hash").alias("text_hash"),
        F.when(blank_to_null("text_hash").isNotNull(), F.col("simhash64")).alias("simhash64"), "previous", "last_confirmed_at",
    ).filter("file_ref is not null and file_ref != '' and current_hash is not null")
    order = F.struct("last_confirmed_at", F.coalesce(F.size("previous"), F.lit(0)), "current_hash_observed_at", "current_hash", "algo", "file_name", "size", "site_path", "library", "text_hash", "simhash64")
    best = F.max_by(F.struct(*(c for c in rows.columns if c != "file_ref")), order)
    once = rows.groupBy("file_ref").agg(best.alias("_b")).select("file_ref", "_b.*").drop("last_confirmed_at")
    once = once.filter(~urls.matches_any("file_ref", allow.paths)).withColumn("name_allowed", ~urls.matches_any("file_name", allow.names))
    if allow.hashes:
        once = once.filter(~F.col("current_hash").isin(*(h.lower() for h in allow.hashes)))
    return once


def history(files: DataFrame) -> DataFrame:
    """(file_ref, pos, hash, algo, observed_at, text_hash, simhash64) of previous versions."""
    each = files.select("file_ref", F.posexplode("previous").alias("pos", "p"))
    return each.select("file_ref", "pos", clean_hash("p.hash").alias("hash"), effective_algo("p.algo").alias("algo"), F.col("p.observed_at").alias("observed_at"), blank_to_null("p.text_hash").alias("text_hash"), F.col("p.simhash64").alias("simhash64")).filter("hash is not null")


def exact_members(files: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """AGG-5, SRT-1: one row per member of a group of two or more, with group_size. ``visible``: ACL-3, only visible members count."""
    if visible is not None:
        files = acl.flagged(files, "site_path", visible).filter("is_visible").drop("is_visible")
    sizes = files.groupBy("algo", "current_hash").agg(F.count("*").alias("group_size")).filter("group_size >= 2")
    return files.join(sizes, ["algo", "current_hash"]).select("algo", "current_hash", "group_size", "file_ref", "file_name", "site_path", "library", "size", "current_hash_observed_at")


def exact_groups(files: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """AGG-5 as groups: (algo, current_hash, group_size, first_ref, total_size); members stay rows in ``exact_members``."""
    rows = exact_members(files, visible)
    return rows.groupBy("algo", "current_hash").agg(F.count("*").alias("group_size"), F.min("file_ref").alias("first_ref"), F.sum("size").alias("total_size"))


def exact_of(targets: DataFrame, files: DataFrame) -> DataFrame:
    """JN-4: (target_ref, file_ref, ...): other files with a target's content. targets: file_ref."""
    mine = files.join(targets.select("file_ref").distinct(), "file_ref", "left_semi").select(F.col("file_ref").alias("target_ref"), "algo", "current_hash")
    return mine.join(files, ["algo", "current_hash"]).filter("target_ref != file_ref").select("target_ref", "file_ref", "file_name", "site_path", "library", "size", "current_hash", "current_hash_observed_at")


def stale_pairs(files: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """JN-5: (stale_ref, authoritative_ref, diverged_at, ...): the first entry in the other file's history that has my current content."""
    mine = files if targets is None else files.join(targets.select("file_ref").distinct(), "file_ref", "left_semi")
    me = mine.select(F.col("file_ref").alias("stale_ref"), "algo", F.col("current_hash").alias("hash"), F.col("site_path").alias("stale_site"))
    first = history(files).groupBy("file_ref", "algo", "hash").agg(F.min(F.struct("pos", "observed_at")).alias("_m"))
    current = files.select("file_ref", F.col("algo").alias("_algo"), F.col("current_hash").alias("authoritative_hash"), F.col("site_path").alias("authoritative_site"))
    old = first.select("file_ref", "algo", "hash", F.col("_m.observed_at").alias("diverged_at")).join(current, "file_ref")
    pairs = me.join(old, ["algo", "hash"]).filter((F.col("stale_ref") != F.col("file_ref")) & ~((F.col("_algo") == F.col("algo")) & (F.col("authoritative_hash") == F.col("hash"))))
    return pairs.select("stale_ref", "stale_site", F.col("hash").alias("stale_hash"), F.col("file_ref").alias("authoritative_ref"), "authoritative_site", "authoritative_hash", "diverged_at")


def same_name_pairs(files: DataFrame) -> DataFrame:
    """JN-6: pairs of equal names, in any case, with different content."""
    named = files.filter("name_allowed and file_name is not null").withColumn("_name", F.lower("file_name"))
    shared = named.groupBy("_name").agg(F.count("*").alias("_n")).filter("_n >= 2").select("_name")
    named = named.join(shared, "_name", "left_semi")
    side = lambda s: named.select("_name", *(F.col(c).alias(f"{c}_{s}") for c in ("file_ref", "file_name", "site_path", "size", "algo", "current_hash")))
    apart = ~((F.col("algo_a") == F.col("algo_b")) & (F.col("current_hash_a") == F.col("current_hash_b")))
    pairs = side("a").join(side("b"), "_name").filter((F.col("file_ref_a") < F.col("file_ref_b")) & apart)
    return pairs.select("file_ref_a", "file_ref_b", "site_path_a", "site_path_b", "file_name_a", "file_name_b", F.col("size_a").eqNullSafe(F.col("size_b")).alias("same_size"))


def near_pairs(files: DataFrame, radius: int = text.NEAR) -> DataFrame:
    """JN-7, SRT-2: pairs of current versions at most ``radius`` bits apart with different content.

    With more bands than bits that may differ, a near pair has one band equal: pairs meet there, distinct fingerprints first, so that copies
    are spread out only for pairs that are found.
    """
    seen = files.filter("simhash64 is not null").select("file_ref", "site_path", "algo", "current_hash", "simhash64")
    width = 64 // (radius + 1)
    bands = F.array(*(F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("simhash64", width * b).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for b in range(radius + 1)))
    prints = seen.select("simhash64").distinct()
    keyed = prints.select("simhash64", F.explode(bands).alias("k"))
    one, two = (keyed.select(F.col("simhash64").alias(s), "k") for s in ("sim_a", "sim_b"))
    apart = one.join(two, "k").filter("sim_a < sim_b").withColumn("distance", text.distance("sim_a", "sim_b")).filter(F.col("distance") <= radius).select("sim_a", "sim_b", "distance").distinct()
    equal = prints.select(F.col("simhash64").alias("sim_a"), F.col("simhash64").alias("sim_b"), F.lit(0).alias("distance"))
    side = lambda s: seen.select(F.col("simhash64").alias(f"sim_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("file_ref", "site_path", "algo", "current_hash")))
    pairs = apart.unionByName(equal).join(side("a"), "sim_a").join(side("b"), "sim_b")
    pairs = pairs.filter(~((F.col("algo_a") == F.col("algo_b")) & (F.col("current_hash_a") == F.col("current_hash_b"))) & ((F.col("sim_a") != F.col("sim_b")) | (F.col("file_ref_a") < F.col("file_ref_b"))))
    low = F.col("file_ref_a") < F.col("file_ref_b")
    pick = lambda c: (F.when(low, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_a"), F.when(low, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_b"))
    return pairs.select(*pick("file_ref"), *pick("site_path"), "distance")


def diverged_pairs(files: DataFrame) -> DataFrame:
    """JN-8: pairs with a common ancestor by text hash, unequal now and neither in the other's history; the ancestor seen first is reported.

    Of equal times the smaller text hash counts, so the result does not depend on an order of rows.
    """
    old = history(files)
    texts = old.filter("text_hash is not null").groupBy("file_ref", "text_hash").agg(F.min("observed_at").alias("at"))
    shared = texts.groupBy("text_hash").agg(F.count("*").alias("_n")).filter("_n >= 2").select("text_hash")
    texts = texts.join(shared, "text_hash", "left_semi")
    side = lambda s: texts.select("text_hash", F.col("file_ref").alias(f"file_ref_{s}"), F.col("at").alias(f"at_{s}"))
    met = side("a").join(side("b"), "text_hash").filter("file_ref_a < file_ref_b")
    first = met.groupBy("file_ref_a", "file_ref_b").agg(F.min(F.struct(F.least("at_a", "at_b").alias("at"), "text_hash")).alias("_m"))
    now = lambda s: files.select(F.col("file_ref").alias(f"file_ref_{s}"), F.col("site_path").alias(f"site_path_{s}"), F.col("algo").alias(f"algo_{s}"), F.col("current_hash").alias(f"hash_{s}"))
    pairs = first.join(now("a"), "file_ref_a").join(now("b"), "file_ref_b").filter(~((F.col("algo_a") == F.col("algo_b")) & (F.col("hash_a") == F.col("hash_b"))))
    entry = old.select("file_ref", "algo", "hash").distinct()
    for mine, other in (("a", "b"), ("b", "a")):
        known = entry.select(F.col("file_ref").alias("_f"), F.col("algo").alias("_a"), F.col("hash").alias("_h"))
        pairs = pairs.join(known, (F.col(f"file_ref_{other}") == F.col("_f")) & (F.col(f"algo_{mine}") == F.col("_a")) & (F.col(f"hash_{mine}") == F.col("_h")), "left_anti")
    return pairs.select("file_ref_a", "file_ref_b", "site_path_a", "site_path_b", F.col("_m.text_hash").alias("ancestor_text_hash"), F.col("_m.at").alias("ancestor_observed_at"))


def both_visible(pairs: DataFrame, a: str, b: str, visible: DataFrame | None) -> DataFrame:
    """ACL-3: pairs of which both sides are visible."""
    once = acl.flagged(pairs, a, visible).filter("is_visible").drop("is_visible")
    return acl.flagged(once, b, visible).filter("is_visible").drop("is_visible")


def report(files: DataFrame, visible: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five signals, trimmed to what a reader may see (``None``: everything)."""
    return {
        "exact": exact_groups(files, visible),
        "stale": both_visible(stale_pairs(files), "stale_site", "authoritative_site", visible),
        "same_name": both_visible(same_name_pairs(files), "site_path_a", "site_path_b", visible),
        "near": both_visible(near_pairs(files), "site_path_a", "site_path_b", visible),
        "diverged": both_visible(diverged_pairs(files), "site_path_a", "site_path_b", visible),
    }


def totals(signals: dict[str, DataFrame]) -> DataFrame:
    """AGG-6: (signal, total): groups, distinct stale files, and pairs."""
    counted = {k: F.count_distinct("stale_ref") if k == "stale" else F.count("*") for k in signals}
    parts = [df.agg(counted[k].alias("total")).select(F.lit(k).alias("signal"), "total") for k, df in signals.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cap_of(signal: str, asked: int | None = None) -> int:
    return min(asked, MOST) if asked and asked > 0 else CAPS[signal]


def capped(df: DataFrame, signal: str, order: list[Column], asked: int | None = None) -> DataFrame:
    """FLT-9: the first rows of a report by ``order``; totals are counted before. The cap is the feature."""
    return df.orderBy(*order).limit(cap_of(signal, asked))


def signals_of(targets: DataFrame, files: DataFrame) -> DataFrame:
    """JN-16: (target_ref, signal, file_ref, site_path, same_size, diverged_at) for given files: exact, stale and same-name in one table."""
    mine = targets.select("file_ref").distinct()
    none_t, none_b = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("boolean")
    exact = exact_of(mine, files).select("target_ref", F.lit("exact").alias("signal"), "file_ref", "site_path", none_b.alias("same_size"), none_t.alias("diverged_at"))
    stale = stale_pairs(files, mine).select(F.col("stale_ref").alias("target_ref"), F.lit("stale").alias("signal"), F.col("authoritative_ref").alias("file_ref"), F.col("authoritative_site").alias("site_path"), none_b.alias("same_size"), F.col("diverged_at").cast("timestamp_ntz").alias("diverged_at"))
    named = files.filter("name_allowed and file_name is not null").withColumn("_name", F.lower("file_name"))
    own = named.join(mine, "file_ref", "left_semi").select(F.col("file_ref").alias("target_ref"), "_name", F.col("algo").alias("_a"), F.col("current_hash").alias("_h"), F.col("size").alias("_size"))
    same = own.join(named, "_name").filter((F.col("target_ref") != F.col("file_ref")) & ~((F.col("_a") == F.col("algo")) & (F.col("_h") == F.col("current_hash"))))
    same = same.select("target_ref", F.lit("same_name").alias("signal"), "file_ref", "site_path", F.col("size").eqNullSafe(F.col("_size")).alias("same_size"), none_t.alias("diverged_at"))
    return exact.unionByName(stale).unionByName(same)


def gated_signals(found: DataFrame, visible: DataFrame | None) -> DataFrame:
    """ACL-4: (target_ref, signal, visible_count, hidden_count) of signals_of."""
    marked = acl.flagged(found, "site_path", visible)
    return marked.groupBy("target_ref", "signal").agg(F.count_if("is_visible").alias("visible_count"), F.count_if(~F.col("is_visible")).alias("hidden_count"))
