"""Queries of the URL functions (URL-1 to URL-20) and of link extraction (EXT-1 to EXT-7, SRC-5), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import html, office, urls
from linkloom.sources.tables import table

KEY = ["job_id", "source_id", "link_idx"]
GLOBS = ["/sites/*/Policies/**", "**/*copy*.docx", "/teams/**/case 1???/*"]


def _links(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return table(spark, root, "links").select(*KEY, *columns)


def url1_normalize(spark: SparkSession, root: str) -> DataFrame:
    return urls.normalized(_links(spark, root, "url"), "url", "key")


def url2_classify(spark: SparkSession, root: str) -> DataFrame:
    return _links(spark, root, "url").select(*KEY, urls.link_class("url").alias("link_class"))


def url3_search_fragment(spark: SparkSession, root: str) -> DataFrame:
    return _links(spark, root, "url").filter(urls.has_search_fragment("url"))


def url4_all_items(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").select("file_ref", urls.all_items_url("file_ref").alias("view_url"))


def url5_suggest(spark: SparkSession, root: str) -> DataFrame:
    rows = _links(spark, root, "url").withColumn("cls", urls.link_class("url"))
    return rows.select(*KEY, urls.suggestion("url", "cls").alias("suggestion")).filter("suggestion != ''")


def url6_suggest_internal(spark: SparkSession, root: str) -> DataFrame:
    rows = _links(spark, root, "url").withColumn("cls", urls.link_class("url"))
    return rows.select(*KEY, urls.suggestion("url", "cls", include_internal=True).alias("suggestion")).filter("suggestion != ''")


def url7_classify_all(spark: SparkSession, root: str) -> DataFrame:
    return urls.classified(_links(spark, root, "url")).drop("url")


def url8_classify_documents(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "links").filter("source_kind = 'document'").select(*KEY, "url")
    return urls.classified_document_links(rows).drop("url")


def url9_backfill(spark: SparkSession, root: str) -> DataFrame:
    rows = _links(spark, root, "url", "link_class", "suggestion", "normalized_key", "canonical_key")
    return urls.backfilled(rows).select(*KEY, "link_class", "upgraded", F.coalesce("suggestion", F.lit("")).alias("suggestion"), F.coalesce("canonical_key", F.lit("")).alias("canonical_key"))


def url10_path_only(spark: SparkSession, root: str) -> DataFrame:
    return _links(spark, root, "canonical_key").select(*KEY, urls.path_only("canonical_key").alias("key"))


def url11_file_keys(spark: SparkSession, root: str) -> DataFrame:
    return urls.file_key(table(spark, root, "files").select("file_ref"), "file_ref", "key")


def url12_absolute(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "assets").select("url", urls.absolute_url("url").alias("absolute"))


def url13_site_labels(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "links").select("site").distinct().select("site", urls.site_label("site").alias("label"))


def url14_site_slugs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "links").select("site").distinct().select("site", urls.site_slug("site").alias("slug"))


def url15_page_folders(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "assets").select("url", urls.page_folder("url").alias("folder"))


def url16_site_of_file(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").select("file_ref", urls.site_of_file("file_ref").alias("site"))


def url17_list_form_targets(spark: SparkSession, root: str) -> DataFrame:
    rows = urls.list_form_target(_links(spark, root, "url"), "url", "id_path").drop("url").filter("id_path is not null")
    return rows.withColumn("site", urls.site_of_file("id_path"))


def url18_library_urls(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").select("file_ref", urls.library_url("file_ref").alias("library_url"))


def url19_valid_sites(spark: SparkSession, root: str) -> DataFrame:
    return urls.site_paths_checked(table(spark, root, "links").select("site").distinct(), "site")


def url20_globs(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "hash_index").select("file_ref")
    return rows.select("file_ref", *(F.coalesce(F.col("file_ref"), F.lit("")).rlike(urls.glob_pattern(g)).alias(f"g{i}") for i, g in enumerate(GLOBS))).filter("g0 or g1 or g2")


# ---- extraction


def ext1_anchors(spark: SparkSession, root: str) -> DataFrame:
    """Every anchor of every page's canvas in order."""
    pages = table(spark, root, "raw_pages").select("site", "page_id", F.posexplode(html.anchors("canvas")).alias("pos", "a"))
    return pages.select("site", "page_id", "pos", "a.raw_url", "a.url", F.coalesce("a.text", F.lit("")).alias("text"))


def ext2_entities(spark: SparkSession, root: str) -> DataFrame:
    """Urls as a canvas writes them, with heavy references, decoded again: what comes out is the url."""
    heavy = F.regexp_replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(":"), F.lit("&#58;")), "/", "&#x2f;")
    return _links(spark, root, "url").filter("url is not null").select(*KEY, html.decoded_entities(heavy).alias("url"))


def _with_controls(spark: SparkSession, root: str) -> DataFrame:
    """Pages whose canvas has controls: the table's canvases are the rich text of one control, put into it here; its payload is a quick link to the page."""
    pages = table(spark, root, "raw_pages")
    start = '<div data-sp-controldata="{&quot;id&quot;&#58;&quot;w'
    kind = '&quot;,&quot;webPartId&quot;&#58;&quot;C70391EA-0B10-4EE9-B2B4-006D3FCAD0CD&quot;}"><div data-sp-webpartdata="{&quot;title&quot;&#58;&quot;'
    items, end = "&quot;,&quot;items&quot;&#58;[{&quot;url&quot;&#58;&quot;", '&quot;}]}">'
    control = F.concat(F.lit(start), F.col("page_id").cast("string"), F.lit(kind), F.col("leaf"), F.lit(items), F.col("page_url"), F.lit(end))
    return pages.withColumn("canvas", F.concat(control, F.coalesce("canvas", F.lit("")), F.lit("</div></div>")))


def ext3_controls(spark: SparkSession, root: str) -> DataFrame:
    rows = _with_controls(spark, root).select("site", "page_id", F.posexplode(html.controls("canvas")).alias("pos", "c"))
    return rows.select("site", "page_id", "pos", F.length("c.control").alias("n_control"), F.length("c.payload").alias("n_payload"), F.coalesce("c.rich_text", F.lit("")).alias("rich_text"))


def ext4_payload_urls(spark: SparkSession, root: str) -> DataFrame:
    """Urls of nested payloads made of the links' fields: one in an object with a title, one in a dictionary, one in a list."""
    u, t = F.coalesce("url", F.lit("")), F.coalesce("text", F.lit(""))
    payload = F.to_json(F.struct(t.alias("title"), F.struct(u.alias("linkUrl"), F.struct(u.alias("src")).alias("deep")).alias("inner"), F.struct(u.alias("items[0].url")).alias("links"), F.array(F.struct(u.alias("href"))).alias("items")))
    rows = _links(spark, root, "url", "text").select(*KEY, payload.alias("payload"))
    walked = html.payload_links(rows, "payload", "found").select(*KEY, F.posexplode("found").alias("pos", "l"))
    return walked.select(*KEY, "pos", "l.url", F.coalesce("l.text", F.lit("")).alias("text"))


def ext5_canvas_links(spark: SparkSession, root: str) -> DataFrame:
    pages = _with_controls(spark, root).select("site", "page_id", "canvas")
    return html.canvas_links(pages, "canvas", ["site", "page_id"]).select("site", "page_id", "_i", "url", F.coalesce("text", F.lit("")).alias("text"), "source", "instance_id").withColumnRenamed("_i", "pos")


def ext6_page_inventory(spark: SparkSession, root: str) -> DataFrame:
    """All links of every page, classified: canvas, layout, banner."""
    found = html.page_links(_with_controls(spark, root))
    rows = urls.classified(found)
    return rows.select("site", "page_id", "title", "link_idx", "url", F.coalesce("text", F.lit("")).alias("text"), "source", "link_class", "canonical_key")


def ext7_file_types(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").select("file_ref", office.file_type("file_name").alias("family"))


def src5_banners(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "raw_pages")
    field = F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct(F.col("banner_url").alias("Url")))).otherwise(F.col("banner_url"))
    return pages.select("site", "page_id", html.banner_url(field).alias("banner")).filter("banner is not null")


QUERIES = {f.__name__: f for f in (
    url1_normalize, url2_classify, url3_search_fragment, url4_all_items, url5_suggest, url6_suggest_internal, url7_classify_all, url8_classify_documents, url9_backfill, url10_path_only,
    url11_file_keys, url12_absolute, url13_site_labels, url14_site_slugs, url15_page_folders, url16_site_of_file, url17_list_form_targets, url18_library_urls, url19_valid_sites, url20_globs,
    ext1_anchors, ext2_entities, ext3_controls, ext4_payload_urls, ext5_canvas_links, ext6_page_inventory, ext7_file_types, src5_banners,
)}

# ---- SQL

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({c}, ''), '^[\s\x{{00a0}}\x{{feff}}]+', ''), '[\s\x{{00a0}}\x{{feff}}]+$', '')"


def encode_sql(c: str) -> str:
    out = f"url_encode({c})"
    for plain, escaped in (("!", "%21"), ("''", "%27"), ("(", "%28"), (")", "%29"), ("*", "%2A"), ("~", "%7E")):
        out = f"replace({out}, '{escaped}', '{plain}')"
    return out


def norm_sql(name: str, source: str, url: str, out: str, depth: int = 2) -> str:
    """CTEs that end in ``name``: all columns of ``source`` and ``out``, the key of ``url``."""
    p = f"{name}_"
    parts = [
        f"{p}a AS (SELECT *, regexp_replace({trim_sql(url)}, '[\\t\\n\\r]', '', 'g') AS {p}t FROM {source})",
        f"{p}b AS (SELECT *, regexp_matches({p}t, '^https?://', 'i') AS {p}abs, CASE WHEN regexp_matches({p}t, '^https?://', 'i') THEN regexp_replace({p}t, '^https?:/+', '//', 'i') WHEN {p}t[1] IN ('/', '\\') THEN {p}t ELSE '/' || {p}t END AS {p}r FROM {p}a)",
        f"{p}c AS (SELECT *, replace(regexp_extract({p}r, '^([^?#]*)', 1), '\\', '/') AS {p}w, regexp_extract({p}r, '^[^?#]*\\?([^#]*)', 1) AS {p}q FROM {p}b)",
        f"{p}d AS (SELECT *, CASE WHEN {p}abs THEN regexp_replace(regexp_replace(lower(regexp_extract({p}w, '^//([^/]*)', 1)), '^.*@', ''), ':[0-9]*$', '') ELSE '' END AS {p}h, coalesce(nullif(regexp_replace({p}w, '^//[^/]*', ''), ''), '/') AS {p}y FROM {p}c)",
        f"{p}e AS (SELECT *, regexp_replace(url_decode(translate({p}y, '{UP}', '{LOW}')), '^/:[wxpo]:(/[rs])?/', '/', 'i') AS {p}p FROM {p}d)",
        f"{p}f AS (SELECT *, ({p}t = '' OR regexp_matches({p}t, '^/:u:/g/', 'i') OR ({p}abs AND {p}h = '') OR regexp_matches({p}p, '/_layouts/15/doc\\.aspx$', 'i')) AS {p}none, regexp_matches({p}p, '/forms/(allitems|dispform)\\.aspx$', 'i') AS {p}form, url_decode(replace(regexp_extract({p}q, '(?:^|&)id=([^&]*)', 1), '+', ' ')) AS {p}id FROM {p}e)",
    ]
    last, inner = f"{p}f", "''"
    if depth:
        parts.append(norm_sql(f"{p}i", last, f"{p}id", f"{p}k", depth - 1))
        last = f"{p}i"
        inner = f"CASE WHEN {p}k = '' THEN '' WHEN {p}k[1] = '/' THEN {p}h || {p}k ELSE {p}k END"
    key = f"CASE WHEN {p}none THEN '' WHEN {p}form THEN {inner} ELSE {p}h || CASE WHEN length({p}p) > 1 THEN regexp_replace({p}p, '/$', '') ELSE {p}p END END"
    parts.append(f"{name} AS (SELECT *, {key} AS {out} FROM {last})")
    return ",\n".join(parts)


def class_sql(url: str) -> str:
    t = trim_sql(url)
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({t}, '^https?:/+([^/\\\\?#]*)', 1, 'i')), '^.*@', ''), ':[0-9]*$', '')"
    bad = fragment_sql(t)
    return f"""CASE WHEN {t} = '' THEN 'unknown' WHEN {t}[1] = '#' THEN 'anchor-only' WHEN regexp_matches({t}, '^mailto:', 'i') THEN 'mailto' WHEN regexp_matches({t}, '^tel:', 'i') THEN 'tel'
 WHEN regexp_matches({t}, '^javascript:', 'i') THEN 'javascript'
 WHEN regexp_matches({t}, '^(https?://[^/]+)?/:[a-z]:/[a-z]/', 'i') THEN CASE WHEN regexp_matches({t}, '/:[wxpo]:', 'i') THEN 'office-online' ELSE 'sharing-link' END
 WHEN regexp_matches({t}, '/_layouts/15/doc\\.aspx', 'i') THEN 'doc-aspx'
 WHEN regexp_matches({t}, '^https?://', 'i') THEN CASE WHEN {host} = '' THEN 'unknown' WHEN {host} = 'intranet.example' THEN CASE WHEN {bad} THEN 'malformed-spo-link' ELSE 'spo-internal' END WHEN {host} = 'oldfarm.example' THEN 'onprem' ELSE 'external' END
 WHEN {t}[1] = '/' THEN CASE WHEN {bad} THEN 'malformed-spo-link' ELSE 'relative' END ELSE 'unknown' END"""


def fragment_sql(t: str) -> str:
    return f"(regexp_matches({t}, '/forms/allitems\\.aspx\\?', 'i') AND regexp_matches({t}, '^[^#]*#(.*&)?search=', 'is'))"


def view_sql(path: str) -> str:
    p = f"regexp_extract(coalesce({path}, ''), '^([^?#]*)', 1)"
    parts = f"list_filter(string_split({p}, '/'), lambda s: s <> '')"
    last = f"{parts}[-1]"
    joined = lambda a: f"('/' || array_to_string(list_transform({a}, lambda s: {encode_sql('s')}), '/'))"
    lib = joined(f"{parts}[1:3]")
    return f"""CASE WHEN {p}[1] = '/' AND NOT regexp_matches({p}, '/forms/(allitems|dispform)\\.aspx$', 'i') AND len({parts}) >= 3 AND len(list_filter({parts}, lambda s: s[1] = '_')) = 0
 AND regexp_matches({last}, '\\.[a-z0-9]{{1,8}}$', 'i') AND NOT regexp_matches({last}, '\\.(aspx|asmx|asp|html|htm|php|jsp|master|mht|mhtml)$', 'i')
 THEN 'https://intranet.example' || {lib} || '/Forms/AllItems.aspx?id=' || {joined(parts)} || '&parent=' || {lib} ELSE '' END"""


def suggest_sql(name: str, source: str, url: str, internal: bool = False) -> str:
    """CTEs that end in ``name``: all columns of ``source``, cls and suggested."""
    p = f"{name}_"
    inside = f"WHEN cls = 'spo-internal' THEN {view_sql(f'url_decode({p}p)')}" if internal else ""
    return f"""{p}a AS (SELECT *, {class_sql(url)} AS cls, regexp_replace(coalesce({url}, ''), '^https?://[^/]+', '', 'i') AS {p}p FROM {source}),
{p}b AS (SELECT *, CASE WHEN cls = 'office-online' THEN regexp_extract({p}p, '^/:[wxpo]:/[rs]/(.+)$', 1, 'i') WHEN cls = 'sharing-link' THEN regexp_extract({p}p, '^/:b:/[rs]/(.+)$', 1, 'i') ELSE '' END AS {p}tail FROM {p}a),
{p}c AS (SELECT *, '/' || url_decode({p}tail) AS {p}w FROM {p}b),
{name} AS (SELECT *, CASE WHEN {p}tail <> '' THEN {view_sql(f'{p}w')} WHEN cls = 'malformed-spo-link' AND instr({url}, '#') > 1 THEN regexp_extract({url}, '^([^#]*)', 1, 's') {inside} ELSE '' END AS suggested FROM {p}c)"""


_K = "job_id, source_id, link_idx"
_KEYED = "('spo-internal', 'onprem', 'relative', 'office-online', 'malformed-spo-link')"
_ANCHOR = r"""<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>"""
_ANCHORS = rf"""anchored AS (SELECT site, page_id, unnest(regexp_extract_all(canvas, '{_ANCHOR}', 1, 'is')) AS raw_url, unnest(regexp_extract_all(canvas, '{_ANCHOR}', 2, 'is')) AS inner_html,
  unnest(range(len(regexp_extract_all(canvas, '{_ANCHOR}', 1, 'is')))) AS pos FROM raw_pages)"""


def plain_sql(c: str) -> str:
    """Named entities and tags of the test data."""
    out = c
    for name, char in (("&amp;", "&"), ("&quot;", '"'), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        out = f"replace({out}, '{name}', '{char}')"
    return out


_TEXT = trim_sql(plain_sql("regexp_replace(inner_html, '<[^>]+>', '', 'g')"))
_FOUND = f"""found AS (
  SELECT site, page_id, 0 AS part, pos AS i, {plain_sql('raw_url')} AS url, {_TEXT} AS text, 'anchor' AS source FROM anchored
  UNION ALL SELECT site, page_id, 0, 1000000, page_url, '', 'quickLinks' FROM raw_pages
  UNION ALL SELECT site, page_id, 2, 0, banner_url, '', 'banner' FROM raw_pages WHERE banner_url <> '')"""
SQL = {
    "url1_normalize": f"WITH {norm_sql('n', 'links', 'url', 'nkey')} SELECT {_K}, url, nkey AS key FROM n",
    "url2_classify": f"SELECT {_K}, {class_sql('url')} AS link_class FROM links",
    "url3_search_fragment": f"SELECT {_K}, url FROM links WHERE {fragment_sql('url')}",
    "url4_all_items": f"SELECT file_ref, {view_sql('file_ref')} AS view_url FROM files",
    "url5_suggest": f"WITH {suggest_sql('s', 'links', 'url')} SELECT {_K}, suggested AS suggestion FROM s WHERE suggested <> ''",
    "url6_suggest_internal": f"WITH {suggest_sql('s', 'links', 'url', True)} SELECT {_K}, suggested AS suggestion FROM s WHERE suggested <> ''",
    "url7_classify_all": f"""WITH base AS (SELECT {_K}, url FROM links), {suggest_sql('s', 'base', 'url')}, {norm_sql('n', 's', 'url', 'nkey')}, {norm_sql('m', 'n', 'suggested', 'mkey')}
SELECT {_K}, cls AS link_class, CASE WHEN cls IN {_KEYED} THEN nkey ELSE '' END AS normalized_key, suggested AS suggestion,
  coalesce(nullif(CASE WHEN cls IN {_KEYED} THEN nkey ELSE '' END, ''), mkey) AS canonical_key, CASE WHEN cls = 'malformed-spo-link' THEN 'search-fragment' END AS malformed_reason FROM m""",
    "url8_classify_documents": f"WITH c AS (SELECT *, {class_sql('url')} AS cls FROM links WHERE source_kind = 'document') SELECT {_K}, cls AS link_class, '' AS normalized_key, CASE WHEN cls = 'malformed-spo-link' THEN 'search-fragment' END AS malformed_reason FROM c",
    "url9_backfill": f"""WITH u AS (SELECT {_K}, url, suggestion AS old_suggestion, normalized_key AS old_normal, canonical_key AS old_key, coalesce(link_class IN ('spo-internal', 'relative') AND {fragment_sql('url')}, false) AS upgraded, link_class AS old_class FROM links),
base AS (SELECT *, CASE WHEN upgraded THEN 'malformed-spo-link' ELSE old_class END AS c FROM u), {suggest_sql('s', 'base', 'url', True).replace(class_sql('url') + ' AS cls', 'c AS cls')},
filled AS (SELECT *, coalesce(nullif(old_suggestion, ''), suggested) AS sug FROM s), {norm_sql('n', 'filled', 'url', 'nkey')}, {norm_sql('m', 'n', 'sug', 'mkey')}
SELECT {_K}, c AS link_class, upgraded, sug AS suggestion, coalesce(nullif(old_key, ''), nullif(old_normal, ''), CASE WHEN c IN {_KEYED} THEN nullif(nkey, '') END, mkey) AS canonical_key FROM m""",
    "url10_path_only": f"SELECT {_K}, CASE WHEN starts_with(canonical_key, 'intranet.example/') THEN canonical_key[17:] ELSE coalesce(canonical_key, '') END AS key FROM links",
    "url11_file_keys": f"WITH base AS (SELECT file_ref, 'https://intranet.example' || file_ref AS u FROM files), {norm_sql('n', 'base', 'u', 'nkey')} SELECT file_ref, CASE WHEN starts_with(nkey, 'intranet.example/') THEN nkey[17:] ELSE nkey END AS key FROM n",
    "url12_absolute": "SELECT url, CASE WHEN coalesce(url, '') = '' OR regexp_matches(url, '^https?://', 'i') THEN coalesce(url, '') WHEN url[1] = '/' THEN 'https://intranet.example' || url ELSE 'https://intranet.example/' || url END AS absolute FROM assets",
    "url13_site_labels": "SELECT DISTINCT site, CASE WHEN regexp_matches(site, '/(sites|teams)/[^/]+', 'i') THEN regexp_extract(site, '/(?:sites|teams)/([^/]+)', 1, 'i') WHEN replace(coalesce(site, ''), '/', '') = '' THEN 'root' ELSE list_filter(string_split(site, '/'), lambda s: s <> '')[-1] END AS label FROM links",
    "url14_site_slugs": "SELECT DISTINCT site, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(site, '')), '^/sites/', ''), '^/', ''), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')[1:200], ''), 'root') AS slug FROM links",
    "url15_page_folders": "SELECT url, regexp_extract(coalesce(url, ''), '/SiteAssets/SitePages/([^/]+)', 1, 'i') AS folder FROM assets",
    "url16_site_of_file": "SELECT file_ref, regexp_extract(coalesce(file_ref, ''), '^(/(?:sites|teams)/[^/]+)/', 1, 'i') AS site FROM files",
    "url17_list_form_targets": f"""WITH a AS (SELECT {_K}, url, url_decode(url_decode(replace(regexp_extract(replace(regexp_extract(regexp_extract(url, '^([^#]*)', 1), '\\?(.*)$', 1), '&amp;', '&'), '(?:^|&)id=([^&]*)', 1), '+', ' '))) AS id_path
  FROM links WHERE regexp_matches(url, '/forms/allitems\\.aspx\\?', 'i'))
SELECT {_K}, id_path, regexp_extract(id_path, '^(/(?:sites|teams)/[^/]+)/', 1, 'i') AS site FROM a WHERE regexp_matches(id_path, '^/(sites|teams)/[^/]+/', 'i')""",
    "url18_library_urls": "SELECT file_ref, CASE WHEN regexp_matches(file_ref, '^/(sites|teams)/', 'i') THEN regexp_extract(file_ref, '^(/(?:sites|teams)/[^/]+/[^/]+)/', 1, 'i') ELSE regexp_extract(coalesce(file_ref, ''), '^(/[^/]+)/', 1) END AS library_url FROM files",
    "url19_valid_sites": f"WITH s AS (SELECT DISTINCT site, CASE WHEN {trim_sql('site')}[1] = '/' THEN {trim_sql('site')} ELSE '/' || {trim_sql('site')} END AS checked_path FROM links) SELECT site, checked_path, regexp_matches(checked_path, '^/sites/[a-z0-9-]+$|^/$') AS is_valid FROM s",
    "url20_globs": "WITH g AS (SELECT file_ref, " + ", ".join(f"regexp_matches(coalesce(file_ref, ''), '{urls.glob_pattern(g)}') AS g{i}" for i, g in enumerate(GLOBS)) + " FROM hash_index) SELECT * FROM g WHERE g0 OR g1 OR g2",
    "ext1_anchors": f"WITH {_ANCHORS} SELECT site, page_id, pos, raw_url, {plain_sql('raw_url')} AS url, {_TEXT} AS text FROM anchored",
    "ext2_entities": f"SELECT {_K}, {plain_sql('url')} AS url FROM links WHERE url IS NOT NULL",
    "ext3_controls": r"""SELECT site, page_id, 0 AS pos, length('{&quot;id&quot;&#58;&quot;w' || page_id || '&quot;,&quot;webPartId&quot;&#58;&quot;C70391EA-0B10-4EE9-B2B4-006D3FCAD0CD&quot;}') AS n_control,
  length('{&quot;title&quot;&#58;&quot;' || leaf || '&quot;,&quot;items&quot;&#58;[{&quot;url&quot;&#58;&quot;' || page_url || '&quot;}]}') AS n_payload, regexp_extract(coalesce(canvas, ''), '<div[^>]*\bdata-sp-rte=["''][^"'']*["''][^>]*>(.*?)</div>', 1, 'is') AS rich_text FROM raw_pages""",
    "ext4_payload_urls": f"""SELECT {_K}, pos, url, CASE WHEN pos = 2 THEN 'items[0].url' WHEN pos = 3 THEN '' ELSE coalesce(text, '') END AS text FROM links, range(4) AS r(pos) WHERE url <> '' AND NOT starts_with(url, 'data:')""",
    "ext5_canvas_links": f"""WITH {_ANCHORS}, n AS (SELECT site, page_id, len(regexp_extract_all(canvas, '{_ANCHOR}', 1, 'is')) AS n FROM raw_pages)
SELECT site, page_id, pos, {plain_sql('raw_url')} AS url, {_TEXT} AS text, 'anchor' AS source, 'w' || page_id AS instance_id FROM anchored
UNION ALL SELECT site, page_id, len(regexp_extract_all(coalesce(canvas, ''), '{_ANCHOR}', 1, 'is')), page_url, '', 'quickLinks', 'w' || page_id FROM raw_pages""",
    "ext6_page_inventory": f"""WITH numbered AS (SELECT *, row_number() OVER () AS rn FROM raw_pages),
anchored AS (SELECT rn, site, page_id, unnest(regexp_extract_all(canvas, '{_ANCHOR}', 1, 'is')) AS raw_url, unnest(regexp_extract_all(canvas, '{_ANCHOR}', 2, 'is')) AS inner_html, unnest(range(len(regexp_extract_all(canvas, '{_ANCHOR}', 1, 'is')))) AS pos FROM numbered),
every AS (SELECT rn, 0 AS part, pos AS i, {plain_sql('raw_url')} AS url, {_TEXT} AS text, 'anchor' AS source FROM anchored UNION ALL SELECT rn, 0, 1000000, page_url, '', 'quickLinks' FROM numbered UNION ALL SELECT rn, 2, 0, banner_url, '', 'banner' FROM numbered WHERE banner_url <> ''),
placed AS (SELECT e.*, p.site, p.page_id, coalesce(nullif(p.leaf, ''), '#' || p.page_id) AS title, row_number() OVER (PARTITION BY e.rn ORDER BY part, i) - 1 AS link_idx FROM every e JOIN numbered p USING (rn)),
{suggest_sql('s', 'placed', 'url')}, {norm_sql('n', 's', 'url', 'nkey')}, {norm_sql('m', 'n', 'suggested', 'mkey')}
SELECT site, page_id, title, link_idx, url, text, source, cls AS link_class, coalesce(nullif(CASE WHEN cls IN {_KEYED} THEN nkey ELSE '' END, ''), mkey) AS canonical_key FROM m""",
    "ext7_file_types": """WITH e AS (SELECT file_ref, lower(regexp_extract(regexp_extract(coalesce(file_name, ''), '^([^?#]*)', 1), '\\.([^.]*)$', 1)) AS x FROM files)
SELECT file_ref, CASE WHEN x IN ('docx', 'docm', 'dotx', 'dotm') THEN 'docx' WHEN x IN ('xlsx', 'xlsm', 'xltx', 'xltm') THEN 'xlsx' WHEN x IN ('pptx', 'pptm', 'potx', 'potm', 'ppsx', 'ppsm') THEN 'pptx' WHEN x = 'pdf' THEN 'pdf' ELSE 'unsupported' END AS family FROM e""".replace("\\\\", "\\"),
    "src5_banners": "SELECT site, page_id, banner_url AS banner FROM raw_pages WHERE banner_url <> ''",
}
