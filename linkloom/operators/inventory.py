"""Link inventory reports (AGG-1 to AGG-4, AGG-7, AGG-8, FLT-1 to FLT-3, FLT-6 to FLT-8, DST-2, JN-12 to JN-15, SRT-5, SRT-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REPORTED_CLASSES = ("sharing-link", "office-online", "spo-internal", "malformed-spo-link")
LINK_KEY = ("job_id", "source_id", "link_idx")


def distinct_links(links: DataFrame) -> DataFrame:
    """Links once each: repeated rows of one (job_id, source_id, link_idx) are one link."""
    return links.dropDuplicates(list(LINK_KEY))


def tally(links: DataFrame, by: list[str]) -> DataFrame:
    """AGG-1, AGG-2: (by..., dimension, value, n): links in all, by class and by source, in one aggregate."""
    rows = links.select(*by, "link_class", "source")
    sets = [[*by, "link_class"], [*by, "source"], by]
    grouped = rows.groupingSets(sets, *by, "link_class", "source").agg(F.count("*").alias("n"), F.grouping("link_class").alias("_c"), F.grouping("source").alias("_s"))
    dimension = F.when(F.col("_c") == 0, "class").when(F.col("_s") == 0, "source").otherwise("all")
    return grouped.select(*by, dimension.alias("dimension"), F.when(F.col("_c") == 0, F.col("link_class")).when(F.col("_s") == 0, F.col("source")).alias("value"), "n")


def totals(links: DataFrame, errors: Column | None = None) -> DataFrame:
    """AGG-3, AGG-4: (sites, sources, links, errors) of what is given; trimmed rows give the totals of a reader."""
    wrong = F.count_if(errors) if errors is not None else F.lit(0).cast("bigint")
    return links.agg(F.count_distinct(F.lower("site")).alias("sites"), F.count_distinct("source_kind", "source_url").alias("sources"), F.count("*").alias("links"), wrong.alias("errors"))


def filtered(links: DataFrame, site: str = "", cls: str = "", source: str = "", text: str = "") -> DataFrame:
    """FLT-1: all given conditions hold; text is found in title, url or text, in any case. "" is no condition."""
    out = links
    for column, value in (("site", site), ("link_class", cls), ("source", source)):
        if value:
            out = out.filter(F.col(column) == value)
    if text:
        hay = F.lower(F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in ("source_title", "url", "text"))))
        out = out.filter(F.contains(hay, F.lit(text.lower())))
    return out


def options(links: DataFrame) -> DataFrame:
    """FLT-2: (field, value): the distinct sources and sites to choose from."""
    each = links.select(F.explode(F.array(F.struct(F.lit("source").alias("field"), F.col("source").alias("value")), F.struct(F.lit("site").alias("field"), F.col("site").alias("value")))).alias("x"))
    return each.select("x.*").filter("value is not null and value != ''").distinct()


def picker(sites: DataFrame, text: str = "") -> DataFrame:
    """FLT-3: sites whose title or path holds ``text``, each with its hub and the hub's size; sites without a hub come last."""
    t = text.lower()
    found = sites.filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(t)) | F.contains(F.lower("site_path"), F.lit(t))) if t else sites
    group = F.coalesce("hub_id", F.lit("__standalone__"))
    named = found.withColumn("hub_group", group)
    sizes = named.groupBy("hub_group").agg(F.count("*").alias("group_size"))
    return named.join(sizes, "hub_group").select("hub_group", (F.col("hub_group") == "__standalone__").cast("int").alias("group_order"), "group_size", "site_path", "title")


def errors_listed(site_errors: DataFrame, page_errors: DataFrame) -> DataFrame:
    """FLT-6: (scope, site, subject, error): errors of sites and of pages in one list."""
    a = site_errors.select(F.lit("site").alias("scope"), "site", F.lit("").alias("subject"), "error")
    b = page_errors.select(F.lit("page").alias("scope"), "site", F.col("page_url").alias("subject"), "error")
    return a.unionByName(b).filter("error is not null and error != ''")


def promoted(files: DataFrame, sites: list[str]) -> tuple[DataFrame, DataFrame]:
    """FLT-7, ST-22: (files of the chosen sites, their distinct sites), sites in any case."""
    kept = files.filter(F.lower("site").isin(*(s.lower() for s in sites))) if sites else files
    return kept, kept.select(F.lower("site").alias("site")).filter("site is not null").distinct()


def rollup(files: DataFrame, included: Column) -> DataFrame:
    """AGG-7: counts and bytes per site, library, extension and in all, for files that a scan would include or leave out."""
    rows = files.select(F.lower("site").alias("site"), "library", F.when(included, "included").otherwise("excluded").alias("bucket"), F.lower("extension").alias("extension"), "length")
    sets = [["site"], ["site", "library"], ["site", "bucket", "extension"], ["bucket", "extension"], []]
    out = rows.groupingSets(sets, "site", "library", "bucket", "extension").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.grouping_id().alias("_g"))
    level = {0b0111: "site", 0b0011: "library", 0b0100: "site-extension", 0b1100: "extension", 0b1111: "all"}
    names = F.create_map(*(F.lit(x) for k, v in level.items() for x in (k, v)))
    return out.select(F.element_at(names, F.col("_g").cast("int")).alias("level"), "site", "library", "bucket", "extension", "files", "bytes")


def selected_sum(rolled: DataFrame, sites: list[str]) -> DataFrame:
    """AGG-8: files and bytes over chosen sites of a rollup."""
    own = rolled.filter((F.col("level") == "site") & F.col("site").isin(*(s.lower() for s in sites)))
    return own.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def top_extensions(rolled: DataFrame, k: int = 8) -> DataFrame:
    """FLT-8: the k most frequent extensions of each bucket; ties by name. The rollup is small whatever the files."""
    own = rolled.filter("level = 'extension'")
    place = F.row_number().over(W.partitionBy("bucket").orderBy(F.col("files").desc(), F.col("extension").asc_nulls_first()))
    return own.withColumn("place", place).filter(F.col("place") <= k).select("bucket", "extension", "files", "bytes", "place")


def canonical_report(links: DataFrame) -> DataFrame:
    """DST-2: links that have a better address, once per (page, url), the first in order of job, page and link."""
    own = links.filter(F.col("link_class").isin(*REPORTED_CLASSES) & (F.coalesce("suggestion", F.lit("")) != ""))
    shown = F.struct("job_id", "source_id", "link_idx", F.coalesce(F.nullif("source_title", F.lit("")), "source_url").alias("source"), "site", "source_kind", F.coalesce("text", F.lit("")).alias("text"), F.col("suggestion").alias("suggested"), "link_class")
    first = own.groupBy("source_url", F.col("url").alias("current")).agg(F.min(shown).alias("f"))
    return first.select("f.source", "source_url", "f.site", "f.source_kind", "f.text", "current", "f.suggested", "f.link_class")


def siblings(links: DataFrame) -> DataFrame:
    """JN-13: per link with a key, the other links with it: of the same kind of source and of another, as counts.

    Counts come from one aggregate per (key, kind), so a hot key costs one row a kind and no pair of links is made.
    """
    keyed = links.filter("canonical_key is not null and canonical_key != ''")
    per = keyed.groupBy("canonical_key", "source_kind").agg(F.count("*").alias("_n"))
    of_key = per.groupBy("canonical_key").agg(F.sum("_n").alias("_all"))
    counted = per.join(of_key, "canonical_key").select("canonical_key", "source_kind", (F.col("_n") - 1).alias("same_kind"), (F.col("_all") - F.col("_n")).alias("other_kind"))
    return keyed.join(counted, ["canonical_key", "source_kind"]).select(*LINK_KEY, "canonical_key", "source_kind", "same_kind", "other_kind")


def unified(pages: DataFrame, documents: DataFrame, by: list[str]) -> DataFrame:
    """JN-12: one inventory out of a page and a document scan: counters add up per site, times widen."""
    every = pages.unionByName(documents)
    return every.groupBy(*by).agg(F.count("*").alias("links"), F.count_distinct("source_kind", "source_url").alias("sources"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))


def paired_jobs(jobs: DataFrame) -> DataFrame:
    """JN-14: (job_id, sibling_job_id): jobs that name each other or one of which names the other, each pair once, the pages job first."""
    named = jobs.filter("sibling_job_id is not null and sibling_job_id != ''").select("job_id", "kind", "sibling_job_id")
    other = jobs.select(F.col("job_id").alias("sibling_job_id"), F.col("kind").alias("sibling_kind"))
    met = named.join(other, "sibling_job_id").filter("job_id != sibling_job_id")
    first = (F.col("kind") == "pages") | ((F.col("sibling_kind") != "pages") & (F.col("job_id") < F.col("sibling_job_id")))
    a, b = F.when(first, F.col("job_id")).otherwise(F.col("sibling_job_id")), F.when(first, F.col("sibling_job_id")).otherwise(F.col("job_id"))
    pairs = met.select(a.alias("job_id"), b.alias("sibling_job_id")).distinct()
    return pairs.groupBy("job_id").agg(F.min("sibling_job_id").alias("sibling_job_id"))


def companions(jobs: DataFrame) -> DataFrame:
    """JN-15: for every job the newest other job of the opposite kind with results."""
    usable = jobs.filter("results_available and kind in ('pages', 'documents')")
    newest = usable.groupBy(F.when(F.col("kind") == "pages", "documents").otherwise("pages").alias("kind")).agg(F.max(F.struct("started_at", "job_id")).alias("_c"))
    return jobs.filter("kind in ('pages', 'documents')").join(newest, "kind").select("job_id", "kind", F.col("_c.job_id").alias("companion"))
