"""Orphan assets (JN-3, AGG-10, ST-18): page assets without a backlink, per site, behind a gate on the age of the index."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls

WARN_MINUTES, BLOCK_MINUTES = 60, 360


def orphans(assets: DataFrame, flat: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """JN-3: assets (site_path, url, name, size, modified) whose key no backlink has; assets without a key are left out.

    ``sites`` (source_site_path) restricts to the sites whose pages were scanned. Distinct keys on the right keep a hot target one row.
    """
    keyed = urls.file_key(assets, "url", "canonical_key").filter("canonical_key != ''")
    if sites is not None:
        keyed = keyed.join(sites.select(F.col("source_site_path").alias("_s")).distinct(), F.lower(urls.site_of_file("url")) == F.col("_s"), "left_semi")
    free = keyed.join(flat.select("canonical_key").filter("canonical_key != ''").distinct(), "canonical_key", "left_anti")
    return free.select("site_path", "url", "name", urls.page_folder("url").alias("page_folder"), "size", "modified", "canonical_key")


def totals(assets: DataFrame, found: DataFrame) -> DataFrame:
    """AGG-10: (sites, files, orphans) in one row."""
    of = lambda df: df.select(F.lower(urls.site_of_file("url")).alias("_s"), "url")
    a = of(assets).agg(F.count_distinct("_s").alias("sites"), F.count("*").alias("files"))
    return a.crossJoin(found.agg(F.count("*").alias("orphans")))


def staleness(updated_at: datetime | None, now: datetime, acknowledged: bool = False) -> tuple[str, int | None]:
    """ST-18: (ok, warn or block, age in minutes); an index without a time blocks unless acknowledged."""
    if updated_at is None:
        return ("ok" if acknowledged else "block"), None
    age = max(0, int((now - updated_at).total_seconds() // 60))
    if age > BLOCK_MINUTES and not acknowledged:
        return "block", age
    return ("warn" if age > WARN_MINUTES else "ok"), age
