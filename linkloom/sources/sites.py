"""Sources of sites, pages, files and assets (SRC-1 to SRC-12) as operators over listing tables.

Listings are tables or files that a crawler leaves; the operators filter and shape them, so predicates and columns are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions import urls
from linkloom.functions.keys import TENANT_HOST, col

NO_ID = "00000000-0000-0000-0000-000000000000"
SYSTEM_LIBRARIES = ("Site Pages", "Form Templates", "Style Library")
SUPPORTED = ("word", "excel", "powerpoint", "pdf")
MB = 1 << 20
FILE_CAP_MB = (1, 100, 500)
VERSIONS = (20, 100)


def enumerated_sites(found: DataFrame, tenant: str = TENANT_HOST) -> DataFrame:
    """SRC-1: (site_path, url, title, template, hub_id, is_hub) of search rows (path, title, template, site_id, department_id, ordinal).

    Personal and foreign hosts, system paths, the app catalogue and the search centre are left out; a path counts once in any case, the
    first row of it; a site is a hub where its id is its department's.
    """
    guid = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\{|\}$", ""))
    host = F.lower(F.regexp_extract("path", r"(?i)^https?://([^/:?#]+)", 1))
    way = F.regexp_replace(F.regexp_extract("path", r"(?i)^https?://[^/?#]+([^?#]*)", 1), "/$", "")
    rows = found.select(
        F.when(way == "", "/").otherwise(way).alias("site_path"), F.col("path").alias("url"), F.coalesce("title", F.lit("")).alias("title"), "template",
        guid(F.col("department_id")).alias("_d"), guid(F.col("site_id")).alias("_i"), host.alias("_h"), "ordinal",
    )
    low = F.lower("site_path")
    rows = rows.filter((F.col("_h") == tenant) & ~low.startswith("/_") & ~low.rlike("^/sites/(appcatalog(/|$)|search$)"))
    has = (F.col("_d") != "") & (F.col("_d") != NO_ID)
    best = F.min(F.struct("ordinal", "site_path", "url", "title", "template", F.when(has, F.col("_d")).alias("hub_id"), (has & (F.col("_d") == F.col("_i"))).alias("is_hub")))
    return rows.groupBy(low.alias("_k")).agg(best.alias("_b")).select("_b.*").drop("ordinal")


def hubs(sites: DataFrame) -> DataFrame:
    """SRC-2: (hub_id, title, site_path) of hubs; the path stands in for a missing title."""
    return sites.filter("is_hub and hub_id is not null").select("hub_id", F.coalesce(F.nullif("title", F.lit("")), "site_path").alias("title"), "site_path")


def site_pages(pages: DataFrame, site: str | None = None, page_ids: list[int] = ()) -> DataFrame:
    """SRC-3: pages of a site (any case), of some ids where given; a site without pages gives no rows. Titles come from the leaf."""
    own = pages.filter(F.lower("site") == site.lower()) if site else pages
    return own.filter(F.col("page_id").isin(*page_ids)) if page_ids else own


def page_by_id(pages: DataFrame, site: str, page_id: int) -> DataFrame:
    """SRC-4: the newest state of one page with its etag; no row where it is gone."""
    own = pages.filter((F.lower("site") == site.lower()) & (F.col("page_id") == page_id))
    return own.groupBy("site", "page_id").agg(F.max_by(F.struct(*(c for c in pages.columns if c not in ("site", "page_id"))), F.struct("modified", "etag")).alias("_p")).select("site", "page_id", "_p.*")


def enumerated_files(files: DataFrame, max_mb: int | None = None, modified_after: object | None = None, include_other: bool = False) -> DataFrame:
    """SRC-6: files of document libraries that a scan takes: named, dated, not empty and not above the cap; other types only if asked for."""
    low, usual, high = FILE_CAP_MB
    cap = min(max(max_mb, low), high) if max_mb else usual
    out = files.filter("file_name is not null and file_name != '' and file_ref is not null and file_ref != '' and modified is not null")
    out = out.filter((F.col("length") > 0) & (F.col("length") <= cap * MB) & ~F.coalesce("library", F.lit("")).isin(*SYSTEM_LIBRARIES))
    if modified_after is not None:
        out = out.filter(F.col("modified") > F.lit(modified_after))
    extension = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    kind = F.when(extension.isin("docx", "docm", "dotx", "dotm"), "word").when(extension.isin("xlsx", "xlsm", "xltx", "xltm"), "excel").when(extension.isin("pptx", "pptm", "potx", "potm", "ppsx", "ppsm"), "powerpoint").when(extension == "pdf", "pdf").otherwise("other")
    out = out.withColumns({"extension": extension, "file_type": kind})
    return out if include_other else out.filter(F.col("file_type") != "other")


def file_places(refs: DataFrame, ref: str = "file_ref") -> DataFrame:
    """SRC-7: adds site (/sites/x, /teams/x or /) and library, the first segment below it."""
    site = urls.site_of_file(ref)
    below = F.when(site == "", F.col(ref)).otherwise(F.substring(ref, F.length(site) + 1, F.length(ref)))
    return refs.withColumns({"place_site": F.when(site == "", "/").otherwise(site), "place_library": F.regexp_extract(below, "^/([^/]+)/", 1)})


def file_bytes(spark, path: str) -> DataFrame:
    """SRC-8: (file_ref, file_name, modified, length, content) of a folder of files, read in parallel."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("file_ref"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("modificationTime").alias("modified"), "length", "content")


def walked_assets(folders: DataFrame, assets: DataFrame, root: str = "/siteassets/sitepages") -> DataFrame:
    """SRC-9: files of all folders that can be reached from a site's asset root; failing and ``_`` folders (and what is below) are skipped.

    folders: url, failed. Which folders are reachable needs no walk: a folder is where none of the folders above it is skipped.
    """
    skipped = folders.filter(F.coalesce("failed", F.lit(False)) | F.col("url").rlike("/_[^/]*$")).select(F.lower("url").alias("_skip")).distinct()
    named = assets.withColumn("_row", F.monotonically_increasing_id())
    parts = F.split(F.lower("url"), "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = named.filter(F.contains(F.lower("url"), F.lit(f"{root}/")))
    hit = inside.select("_row", F.explode(above).alias("_skip")).join(skipped, "_skip", "left_semi").select("_row").distinct()
    return inside.join(hit, "_row", "left_anti").drop("_row")


def folder_listing(listings: DataFrame, body: str = "body") -> DataFrame:
    """SRC-10: (site_path, kind, url, name, size, modified) of folder listings in JSON, flat or with ``results``; bad sizes are 0, ``_`` folders are left out."""
    item = "struct<ServerRelativeUrl:string,Name:string,Length:string,TimeLastModified:string>"
    read = lambda kind: F.coalesce(
        F.from_json(F.get_json_object(body, f"$.{kind}.results"), f"array<{item}>"), F.when(F.ltrim(F.get_json_object(body, f"$.{kind}")).startswith("["), F.from_json(F.get_json_object(body, f"$.{kind}"), f"array<{item}>"))
    )
    files = listings.select("site_path", F.explode(read("Files")).alias("f")).filter("f.ServerRelativeUrl is not null and f.Name is not null")
    size = F.coalesce(F.try_to_number(F.regexp_extract("f.Length", r"^\s*(-?\d+)", 1), F.lit("S999999999999999")).cast("bigint"), F.lit(0))
    files = files.select("site_path", F.lit("file").alias("kind"), F.col("f.ServerRelativeUrl").alias("url"), F.col("f.Name").alias("name"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), F.coalesce("f.TimeLastModified", F.lit("")).alias("modified"))
    folders = listings.select("site_path", F.explode(read("Folders")).alias("f")).filter("f.ServerRelativeUrl is not null and (f.Name is null or not startswith(f.Name, '_'))")
    folders = folders.select("site_path", F.lit("folder").alias("kind"), F.col("f.ServerRelativeUrl").alias("url"), F.col("f.Name").alias("name"), F.lit(0).cast("bigint").alias("size"), F.lit("").alias("modified"))
    return files.unionByName(folders)


def recent_versions(versions: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-12: of each file's versions (file_ref, version, created, is_current) the last ``limit`` old ones, with ``place`` from the oldest.

    The limit is the feature: 20 unless asked, at most 100.
    """
    n = min(limit, VERSIONS[1]) if limit and limit > 0 else VERSIONS[0]
    old = versions.filter("not is_current")
    down = F.row_number().over(W.partitionBy("file_ref").orderBy(F.col("created").desc(), F.col("version").desc()))
    kept = old.withColumn("_r", down).filter(F.col("_r") <= n).drop("_r")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("file_ref").orderBy("created", "version")))


def lower_or_none(c: Column | str) -> Column:
    return F.lower(F.nullif(col(c), F.lit("")))
