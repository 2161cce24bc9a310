"""Backlinks: which sources point at a target (JN-1, JN-2, ST-1, ST-2, ST-6 to ST-8, AGG-9, AGG-14 to AGG-16, DST-1, SRT-3).

Flat entries are the working form: one row per (target key, source). Slices are the stored form: one row per source with its sorted
targets, under a row of meta data per site and kind, as a slice without sources differs from no slice.

Skew: an entry is made per (source, key) with a map-side distinct, so a source that repeats a link ships it once; a hot target's entries
stay rows and are never gathered in one value. Only a source's own targets are gathered, whose number is that of the links of one page.

Defined cases: links without key make no entries; repeated links count once per source; a source with several titles has the
first in order of page and link; null sites are the site "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import urls

ENTRY = ("canonical_key", "source_kind", "source_site", "source_site_path", "source_site_url", "source_title", "source_url", "source_updated_at")
UNTITLED = {"page": "(untitled page)", "document": "(unnamed file)"}


def entries(links: DataFrame, scanned_at: Column | str) -> DataFrame:
    """DST-1, ST-7: flat entries, one per source and distinct target key.

    links: site, source_kind, source_id, source_url, source_title, canonical_key and what ``scanned_at`` names.
    """
    at = F.col(scanned_at) if isinstance(scanned_at, str) else scanned_at
    site = F.coalesce("site", F.lit(""))
    title = F.coalesce("source_title", F.when(F.col("source_kind") == "document", F.lit(UNTITLED["document"])).otherwise(F.lit(UNTITLED["page"])))
    return links.select(
        urls.path_only("canonical_key").alias("canonical_key"),
        "source_kind",
        urls.site_label(site).alias("source_site"),
        F.lower(site).alias("source_site_path"),
        urls.absolute_url(site).alias("source_site_url"),
        title.alias("source_title"),
        urls.absolute_url("source_url").alias("source_url"),
        at.alias("source_updated_at"),
    ).filter("canonical_key != ''").distinct()


def lookup(refs: DataFrame, flat: DataFrame, ref: str = "file_ref") -> DataFrame:
    """JN-1, JN-2: every reference with its backlinks, each (kind, url) once with its first title; references without any have nulls.

    The whole batch is one join, whatever the number of references.
    """
    keyed = urls.file_key(refs.select(ref).distinct(), ref, "canonical_key")
    keyed = keyed.withColumn("canonical_key", F.nullif("canonical_key", F.lit("")))
    first = flat.groupBy("canonical_key", "source_kind", "source_url").agg(F.min(F.struct("source_updated_at", "source_title", "source_site", "source_site_path", "source_site_url")).alias("_e"))
    single = first.select("canonical_key", "source_kind", "source_url", "_e.source_title", "_e.source_site", "_e.source_site_path", "_e.source_site_url", "_e.source_updated_at")
    return keyed.join(single, "canonical_key", "left")


def slices(links: DataFrame, sites: DataFrame, job_id: Column, scanned_at: Column) -> tuple[DataFrame, DataFrame]:
    """ST-1, AGG-16: (meta, sources) of one scan; a scanned site without sources has a meta row of its own. sites: site, kind."""
    flat = entries(links, scanned_at).filter("source_site_path != ''")
    title = F.min("source_title")
    own = flat.groupBy(F.col("source_site_path").alias("site_path"), F.col("source_kind").alias("kind"), F.col("source_url").alias("url"))
    sources = own.agg(title.alias("title"), F.array_sort(F.collect_set("canonical_key")).alias("links_to"))
    named = sites.filter("site is not null and site != ''")
    meta = named.groupBy(F.lower("site").alias("site_path"), "kind").agg(F.min("site").alias("_raw"))
    meta = meta.select("site_path", "kind", urls.site_label("_raw").alias("label"), urls.absolute_url("_raw").alias("url"), scanned_at.alias("updated_at"), job_id.alias("from_job_id"))
    return meta, sources


def merged(old_meta: DataFrame, old_sources: DataFrame, meta: DataFrame, sources: DataFrame, scanned: DataFrame, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """ST-2: slices of scanned sites replace those of their kind; a scanned site without a slice, the other kind and other sites stay.

    scanned: site_path, kind. ``partial`` is for scans of single sources: they replace these sources only.
    """
    keys = ["site_path", "kind"]
    now = scanned.select(F.lower("site_path").alias("site_path"), "kind").distinct()
    new_meta = meta.join(now, keys, "left_semi")
    new_sources = sources.join(new_meta.select(*keys), keys, "left_semi")
    gone = [*keys, "url"] if partial else keys
    replaced = new_sources.select(*gone).distinct() if partial else new_meta.select(*keys)
    kept_meta = old_meta.join(new_meta.select(*keys), keys, "left_anti")
    return kept_meta.unionByName(new_meta), old_sources.join(replaced, gone, "left_anti").unionByName(new_sources)


def inflated(meta: DataFrame, sources: DataFrame) -> DataFrame:
    """ST-6: flat entries out of slices."""
    each = sources.select("site_path", "kind", F.col("url").alias("source_url"), F.col("title").alias("source_title"), F.explode("links_to").alias("canonical_key"))
    known = meta.select("site_path", "kind", F.col("label").alias("source_site"), F.col("url").alias("source_site_url"), F.col("updated_at").alias("source_updated_at"))
    return each.join(known, ["site_path", "kind"]).select(
        "canonical_key", F.col("kind").alias("source_kind"), "source_site", F.col("site_path").alias("source_site_path"), "source_site_url", "source_title", "source_url", "source_updated_at"
    )


def latest_jobs(jobs: DataFrame, kinds: list[str]) -> DataFrame:
    """ST-8: of each kind the latest completed job with results: one row a kind."""
    usable = jobs.filter(F.col("kind").isin(*kinds) & (F.col("status") == "completed") & F.col("results_available"))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.col("started_at").desc(), "job_id"))
    # Partial tops per kind keep the window small: job tables are headers only.
    return usable.withColumn("_r", place).filter("_r = 1").drop("_r")


def freshest(meta: DataFrame, built_at: Column) -> DataFrame:
    """AGG-15: (freshest): the newest slice, or when the index was built."""
    return meta.agg(F.coalesce(F.max("updated_at"), built_at).alias("freshest"))


def rebuild_stats(meta: DataFrame) -> DataFrame:
    """AGG-14: sites with slices of pages and of documents."""
    site = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("site_path")))
    return meta.agg(F.count_distinct("site_path").alias("sites"), site("page").alias("sites_with_pages"), site("document").alias("sites_with_documents"))


def page_scanned_sites(flat: DataFrame) -> DataFrame:
    """AGG-9: sites with a source of kind page and one address each."""
    return flat.filter("source_kind = 'page'").groupBy("source_site_path").agg(F.min("source_site_url").alias("site_url"))
