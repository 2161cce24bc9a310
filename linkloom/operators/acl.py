"""Who sees what (ACL-1 to ACL-6). Sites are compared in lower case; ``None`` for the visible sites stands for an administrator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIEW_BIT, EDIT_BIT = 1, 4


def visible_set(visible: DataFrame) -> DataFrame:
    """(_site): the distinct sites of a reader."""
    return visible.select(F.lower("site_path").alias("_site")).filter("_site is not null and _site != ''").distinct()


def flagged(df: DataFrame, site: Column | str, visible: DataFrame | None, name: str = "is_visible") -> DataFrame:
    """Adds a flag; rows without a site are hidden from readers. The planner sends the visible sites to all tasks while they are few."""
    if visible is None:
        return df.withColumn(name, F.lit(True))
    mine = visible_set(visible).withColumn("_seen", F.lit(True))
    key = F.lower(F.col(site) if isinstance(site, str) else site)
    return df.withColumn("_acl_key", key).join(mine, F.col("_acl_key") == F.col("_site"), "left").withColumn(name, F.coalesce("_seen", F.lit(False))).drop("_acl_key", "_site", "_seen")


def readable_sites(sites: DataFrame, visible: DataFrame | None, permissions: DataFrame | None = None, bit: int = VIEW_BIT) -> DataFrame:
    """ACL-1: the sites a user may read: all for an administrator, else the visible ones, or where that set is empty those whose permission bits have ``bit``."""
    if visible is None:
        return sites
    if permissions is not None and visible_set(visible).isEmpty():
        allowed = permissions.filter(F.col("bits").bitwiseAND(F.lit(bit)) != 0).select("site_path")
        return flagged(sites, "site_path", allowed).filter("is_visible").drop("is_visible")
    return flagged(sites, "site_path", visible).filter("is_visible").drop("is_visible")


def gate(entries: DataFrame, site: str, visible: DataFrame | None, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """ACL-2: (visible rows, hidden count per keys)."""
    marked = flagged(entries, site, visible)
    hidden = marked.groupBy(*keys).agg(F.count_if(~F.col("is_visible")).alias("hidden_count"))
    return marked.filter("is_visible").drop("is_visible"), hidden


def trimmed(rows: DataFrame, site: str, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ACL-5, ACL-6: (rows of allowed sites, dropped sites); exact spelling."""
    mine = allowed.select(F.col("site_path").alias(site)).distinct()
    kept = rows.join(mine, site, "left_semi")
    return kept, rows.select(site).filter(F.col(site).isNotNull()).distinct().join(mine, site, "left_anti")
