"""Find and replace in pages, and recycling (WB-1 to WB-6, AGG-11, AGG-12, FLT-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls

HEAVY = "&#58;"
RECYCLE_STATUS = {200: "recycled", 404: "not-found", 403: "forbidden"}


def scoped(links: DataFrame, sites: list[str] = (), page_ids: list[int] = ()) -> DataFrame:
    """FLT-4: links of the given sites and pages, in exact spelling; an empty list is no restriction."""
    out = links
    if sites:
        out = out.filter(F.col("site").isin(*sites))
    if page_ids:
        out = out.filter(F.col("source_id").isin(*page_ids))
    return out


def substring_plan(links: DataFrame, find: str, replacement: str) -> DataFrame:
    """WB-1: (site, source_id, raw_url, url, new_url), once each: all occurrences of ``find`` in the urls of page links; nothing that stays as it is.

    Documents cannot be written back, so only pages are planned.
    """
    pages = links.filter((F.col("source_kind") == "page") & F.contains("url", F.lit(find)))
    planned = pages.select("site", "source_id", "source_url", "raw_url", "url", F.replace("url", F.lit(find), F.lit(replacement)).alias("new_url"))
    return planned.filter("new_url != url").distinct()


def canonical_plan(links: DataFrame, key: str, replacement: str) -> DataFrame:
    """WB-2: the same for whole urls whose canonical key is ``key``."""
    pages = links.filter((F.col("source_kind") == "page") & (F.col("canonical_key") == key) & (F.col("url") != replacement))
    return pages.select("site", "source_id", "source_url", "raw_url", "url", F.lit(replacement).alias("new_url")).distinct()


def canvas_encoded(url: Column, original: Column) -> Column:
    """WB-3: a url as a canvas writes it: heavily, where the original was."""
    out = url
    for char, name in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    heavy = out
    for char, name in ((":", "&#58;"), ("{", "&#123;"), ("}", "&#125;")):
        heavy = F.replace(heavy, F.lit(char), F.lit(name))
    return F.when(F.contains(original, F.lit(HEAVY)), heavy).otherwise(out)


def occurrences(text: Column, part: Column) -> Column:
    return F.when(part == "", F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))


def replaced(canvas: Column, changes: Column) -> Column:
    """WB-4: (canvas, n) after all changes (raw_url, new_url) in turn; each is tried as written, then with its ampersands encoded.

    n counts true occurrences.
    """

    def one(acc: Column, c: Column) -> Column:
        raw = c["raw_url"]
        encoded = F.regexp_replace(raw, "&(?!amp;|lt;|gt;|quot;|apos;|#)", "&amp;")
        find = F.when(~F.contains(acc["canvas"], raw) & F.contains(acc["canvas"], encoded), encoded).otherwise(raw)
        new = canvas_encoded(c["new_url"], find)
        n = F.when(new == find, F.lit(0)).otherwise(occurrences(acc["canvas"], find))
        return F.struct(F.when(n > 0, F.replace(acc["canvas"], find, new)).otherwise(acc["canvas"]).alias("canvas"), (acc["n"] + n).cast("int").alias("n"))

    return F.aggregate(changes, F.struct(canvas.alias("canvas"), F.lit(0).alias("n")), one)


def page_results(plan: DataFrame, pages: DataFrame, scanned: DataFrame, dry_run: bool = True, conflicts: DataFrame | None = None) -> DataFrame:
    """WB-5: (site, source_id, status, matches, canvas, layout): one row per planned page.

    not-found: the page is gone; stale: its etag is not that of the scan (scanned: site, page_id, etag); no-match: nothing was found in it;
    preview on a dry run; conflict where the write would meet another one (conflicts: site, page_id); else applied.
    A page's changes are gathered in one array, as they are the links of one page.
    """
    changes = plan.groupBy("site", "source_id").agg(F.array_sort(F.collect_set(F.struct("raw_url", "new_url"))).alias("_changes"))
    now = pages.groupBy(F.lower("site").alias("_s"), F.col("page_id").alias("_p")).agg(F.max_by(F.struct("etag", "canvas", "layout"), F.struct("modified", "etag")).alias("_now"))
    then = scanned.groupBy(F.lower("site").alias("_s2"), F.col("page_id").alias("_p2")).agg(F.max("etag").alias("_then"))
    out = changes.join(now, (F.lower("site") == F.col("_s")) & (F.col("source_id") == F.col("_p")), "left").join(then, (F.lower("site") == F.col("_s2")) & (F.col("source_id") == F.col("_p2")), "left")
    if conflicts is None:
        out = out.withColumn("_c", F.lit(None).cast("boolean"))
    else:
        met = conflicts.select(F.lower("site").alias("_s3"), F.col("page_id").alias("_p3"), F.lit(True).alias("_c")).distinct()
        out = out.join(met, (F.lower("site") == F.col("_s3")) & (F.col("source_id") == F.col("_p3")), "left")
    out = out.withColumns({"_canvas": replaced(F.coalesce("_now.canvas", F.lit("")), F.col("_changes")), "_layout": replaced(F.coalesce("_now.layout", F.lit("")), F.col("_changes"))})
    n = F.col("_canvas.n") + F.col("_layout.n")
    status = (
        F.when(F.col("_s").isNull(), "not-found")
        .when(F.col("_then").isNotNull() & ~F.col("_then").eqNullSafe(F.col("_now.etag")), "stale")
        .when(n == 0, "no-match")
        .when(F.lit(dry_run), "preview")
        .when(F.coalesce("_c", F.lit(False)), "conflict")
        .otherwise("applied")
    )
    return out.select("site", "source_id", status.alias("status"), F.when(F.col("_s").isNull(), 0).otherwise(n).alias("matches"), F.col("_canvas.canvas").alias("canvas"), F.col("_layout.canvas").alias("layout"))


def summary(results: DataFrame) -> DataFrame:
    """AGG-11: counts by status; pages that are gone count as errors."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return results.agg(F.count("*").alias("pages"), of("applied").alias("applied"), of("preview").alias("preview"), of("stale").alias("stale"), of("conflict").alias("conflict"), of("no-match").alias("no_match"), of("error", "not-found").alias("errors"))


def recycled(assets: DataFrame, writable: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """WB-6: (url, site, status): what recycling an asset would do or did. responses: url, code; without them it is a dry run.

    Sites without the right to write are left out with a status of their own; nothing in any storage is touched.
    """
    own = assets.select("url", urls.site_of_file("url").alias("site")).distinct()
    may = writable.select(F.lower("site_path").alias("_s")).distinct().withColumn("_may", F.lit(True))
    out = own.join(may, F.lower("site") == F.col("_s"), "left")
    if responses is None:
        status = F.lit("preview")
    else:
        out = out.join(responses.groupBy(F.col("url").alias("_u")).agg(F.max("code").alias("_code")), F.col("url") == F.col("_u"), "left")
        known = F.create_map(*(F.lit(x) for p in RECYCLE_STATUS.items() for x in p))
        status = F.coalesce(F.element_at(known, F.col("_code").cast("int")), F.lit("error"))
    return out.select("url", "site", F.when(F.col("_may").isNull(), "site-not-writable").otherwise(status).alias("status"))


def recycle_summary(results: DataFrame) -> DataFrame:
    """AGG-12: counts by status; sites that are not writable count as errors."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return results.agg(F.count("*").alias("files"), of("recycled").alias("recycled"), of("preview").alias("preview"), of("not-found").alias("not_found"), of("forbidden").alias("forbidden"), of("error", "site-not-writable").alias("errors"))
