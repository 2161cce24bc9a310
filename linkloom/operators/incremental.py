"""Incremental scans (JN-9 to JN-11, ST-9 to ST-11, AGG-13): what to scan again, and merging what was scanned into the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls


def pages_to_scan(pages: DataFrame, state: DataFrame) -> DataFrame:
    """JN-9: pages (page_url, modified, ...) with ``is_unchanged``: the state knows the page with this time."""
    known = state.select("page_url", F.col("modified").alias("_m")).filter("_m is not null").distinct().withColumn("_k", F.lit(True))
    met = (pages["page_url"] == known["page_url"]) & (pages["modified"] == known["_m"])
    return pages.join(known, met, "left").select(*(pages[c] for c in pages.columns), F.coalesce("_k", F.lit(False)).alias("is_unchanged"))


def files_to_scan(files: DataFrame, state: DataFrame) -> DataFrame:
    """JN-10: files (file_ref, etag, ...) with ``is_unchanged``: the state knows the file with this etag, which is not empty."""
    known = state.select("file_ref", F.nullif("etag", F.lit("")).alias("_e")).filter("_e is not null").distinct().withColumn("_k", F.lit(True))
    met = (files["file_ref"] == known["file_ref"]) & (files["etag"] == known["_e"])
    return files.join(known, met, "left").select(*(files[c] for c in files.columns), F.coalesce("_k", F.lit(False)).alias("is_unchanged"))


def verified_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """JN-11: links whose list form names a file, with ``exists``; each distinct (site, path) is looked up once and fans back to its links.

    Links of which nothing can be verified are not in the result. A missing file makes the reason ``file-not-found`` or ``both``.
    """
    named = urls.list_form_target(links, "url", "id_path").filter("id_path is not null")
    asked = named.select("id_path").distinct()
    present = files.select(F.lower("file_ref").alias("_f")).distinct().withColumn("_there", F.lit(True))
    checked = asked.join(present, F.lower("id_path") == F.col("_f"), "left").select("id_path", F.coalesce("_there", F.lit(False)).alias("exists"))
    out = named.join(checked, "id_path").withColumn("had_fragment", urls.has_search_fragment("url"))
    reason = F.when(~F.col("exists"), F.when(F.col("had_fragment"), "both").otherwise("file-not-found")).when(F.col("had_fragment"), "search-fragment")
    return out.withColumn("verified_reason", reason).drop("had_fragment")


def verify_stats(checked: DataFrame) -> DataFrame:
    """AGG-13: candidates (distinct paths), those not found, and the links these stand for."""
    return checked.agg(F.count_distinct("id_path").alias("candidates"), F.count_distinct(F.when(~F.col("exists"), F.col("id_path"))).alias("not_found"), F.count_if(~F.col("exists")).alias("links_not_found"))


def rolled_forward(state: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """ST-9: scanned rows replace the state's rows of their key; rows without a key are skipped, the rest of the state stays."""
    new = scanned.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return state.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def carried_forward(state: DataFrame, reused: DataFrame, key: str, at: Column, job: Column) -> DataFrame:
    """ST-10: keys that were looked at and not scanned again get the new time and job of confirmation; unknown keys are ignored."""
    seen = reused.select(key).distinct().withColumn("_seen", F.lit(True))
    out = state.join(seen, key, "left")
    hit = F.coalesce("_seen", F.lit(False))
    return out.withColumns({"confirmed_at": F.when(hit, at).otherwise(F.col("confirmed_at")), "confirmed_by": F.when(hit, job).otherwise(F.col("confirmed_by"))}).select(*state.columns)


def finalized(state: DataFrame, results: DataFrame, key: str, failed_sites: DataFrame, at: Column, job: Column) -> DataFrame:
    """ST-11: results (state columns, error, is_reused): errors and failed sites are left out, reused rows are carried, the others merged."""
    fine = results.filter("error is null or error = ''").join(failed_sites.select("site").distinct(), "site", "left_anti")
    fresh = fine.filter("not is_reused").withColumns({"confirmed_at": at, "confirmed_by": job}).select(*state.columns)
    return rolled_forward(carried_forward(state, fine.filter("is_reused"), key, at, job), fresh, key)
