"""Queries of backlinks, orphans, duplicates, inventory and visibility (JN, AGG, DST, FLT, ACL, SRT, ST-1 to ST-8, SNK-4 to SNK-7), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.keys import micros
from linkloom.operators import acl, backlinks, duplicates, inventory, orphans, replace, store
from linkloom.plans.link_queries import KEY, norm_sql
from linkloom.sources.tables import table

HOT = "/sites/tool-crib/Shared Documents/Guides/Leave Calendar.pdf"
ALLOW = duplicates.Allowlist(paths=["/sites/tool-crib/**"], names=["*.pdf"])


def _scanned(spark: SparkSession, root: str) -> DataFrame:
    """Links with the time of their scan; jobs are headers, so the planner sends them to all tasks."""
    jobs = table(spark, root, "jobs").select("job_id", F.col("started_at").alias("scanned_at")).dropDuplicates(["job_id"])
    return table(spark, root, "links").join(jobs, "job_id", "left")


def _flat(spark: SparkSession, root: str) -> DataFrame:
    return backlinks.entries(_scanned(spark, root), "scanned_at")


def _visible(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "visible_sites")


def _us(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: micros(c) for c in columns})


# ---- backlinks


def dst1_source_targets(spark: SparkSession, root: str) -> DataFrame:
    """Each source's distinct targets."""
    return _flat(spark, root).select("canonical_key", "source_kind", "source_url").distinct()


def st7_one_shot_index(spark: SparkSession, root: str) -> DataFrame:
    return _us(_flat(spark, root), "source_updated_at")


def srt3_flat_by_key(spark: SparkSession, root: str) -> DataFrame:
    return _us(_flat(spark, root), "source_updated_at").orderBy(*backlinks.ENTRY)


def jn1_lookup(spark: SparkSession, root: str) -> DataFrame:
    one = spark.createDataFrame([(HOT,)], "file_ref string")
    return _us(backlinks.lookup(one, _flat(spark, root)), "source_updated_at")


def jn2_lookup_batch(spark: SparkSession, root: str) -> DataFrame:
    found = backlinks.lookup(table(spark, root, "files"), _flat(spark, root))
    return found.groupBy("file_ref").agg(F.count("source_url").alias("n_backlinks"), F.min("source_url").alias("first_source"))


def acl2_backlink_gate(spark: SparkSession, root: str) -> DataFrame:
    found = backlinks.lookup(table(spark, root, "files"), _flat(spark, root)).filter("source_url is not null")
    seen, hidden = acl.gate(found, "source_site_path", _visible(spark, root), ["file_ref"])
    return hidden.join(seen.groupBy("file_ref").agg(F.count("*").alias("visible_count")), "file_ref", "left").fillna(0, ["visible_count"])


def _slices(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    links = _scanned(spark, root)
    sites = links.select("site", F.col("source_kind").alias("kind"))
    return backlinks.slices(links, sites, F.lit("all"), F.lit(None).cast("timestamp_ntz"))


def st1_slices(spark: SparkSession, root: str) -> DataFrame:
    meta, sources = _slices(spark, root)
    counted = sources.groupBy("site_path", "kind").agg(F.count("*").alias("n_sources"), F.sum(F.size("links_to")).alias("n_targets"))
    return meta.select("site_path", "kind", "label", "url").join(counted, ["site_path", "kind"], "left").fillna(0, ["n_sources", "n_targets"])


def agg16_targets_of_source(spark: SparkSession, root: str) -> DataFrame:
    _, sources = _slices(spark, root)
    return sources.select("site_path", "kind", "url", "title", F.array_join("links_to", "|").alias("links_to"))


def _halves(spark: SparkSession, root: str) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame], DataFrame]:
    """The index of 2024's jobs, that of 2025's page jobs, and the (site, kind) scanned in these."""
    links = _scanned(spark, root)
    none = F.lit(None).cast("timestamp_ntz")
    made = []
    for rows in (links.filter("scanned_at < '2025-01-01'"), links.filter("scanned_at >= '2025-01-01' and source_kind = 'page'")):
        made.append(backlinks.slices(rows, rows.select("site", F.col("source_kind").alias("kind")), F.lit("j"), none))
    scanned = links.filter("scanned_at >= '2025-01-01' and source_kind = 'page' and site != ''").select(F.lower("site").alias("site_path"), F.col("source_kind").alias("kind")).distinct()
    return made[0], made[1], scanned


def st2_merged_slices(spark: SparkSession, root: str) -> DataFrame:
    old, new, scanned = _halves(spark, root)
    _, sources = backlinks.merged(*old, *new, scanned)
    return sources.select("site_path", "kind", "url", F.size("links_to").alias("n_targets"))


def st6_inflated(spark: SparkSession, root: str) -> DataFrame:
    meta, sources = _slices(spark, root)
    return backlinks.inflated(meta, sources).drop("source_updated_at")


def st8_latest_jobs(spark: SparkSession, root: str) -> DataFrame:
    return backlinks.latest_jobs(table(spark, root, "jobs"), ["pages", "documents"]).select("kind", "job_id")


def st8_rebuilt_index(spark: SparkSession, root: str) -> DataFrame:
    """The index out of the latest completed job of each kind alone: what other jobs knew is gone."""
    latest = backlinks.latest_jobs(table(spark, root, "jobs"), ["pages", "documents"]).select("job_id")
    return _us(backlinks.entries(_scanned(spark, root).join(latest, "job_id", "left_semi"), "scanned_at"), "source_updated_at")


def agg9_page_scanned_sites(spark: SparkSession, root: str) -> DataFrame:
    return backlinks.page_scanned_sites(_flat(spark, root))


def agg14_rebuild_stats(spark: SparkSession, root: str) -> DataFrame:
    return backlinks.rebuild_stats(_slices(spark, root)[0])


def agg15_freshest(spark: SparkSession, root: str) -> DataFrame:
    meta = _scanned(spark, root).select(F.col("scanned_at").alias("updated_at"))
    return backlinks.freshest(meta, F.lit("1970-01-01").cast("timestamp_ntz")).select(micros("freshest").alias("freshest"))


# ---- orphans


def _orphans(spark: SparkSession, root: str, covered: bool = False) -> DataFrame:
    flat = _flat(spark, root)
    return orphans.orphans(table(spark, root, "assets"), flat, backlinks.page_scanned_sites(flat) if covered else None)


def jn3_orphans(spark: SparkSession, root: str) -> DataFrame:
    return _us(_orphans(spark, root), "modified")


def jn3_orphans_of_scanned_sites(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root, True).select("url", "canonical_key")


def agg10_orphan_totals(spark: SparkSession, root: str) -> DataFrame:
    return orphans.totals(table(spark, root, "assets"), _orphans(spark, root))


# ---- duplicates


def _files(spark: SparkSession, root: str, allow: duplicates.Allowlist = duplicates.Allowlist()) -> DataFrame:
    return duplicates.base(table(spark, root, "hash_index"), allow)


def agg5_exact_groups(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.exact_groups(_files(spark, root))


def agg5_exact_members(spark: SparkSession, root: str) -> DataFrame:
    return _us(duplicates.exact_members(_files(spark, root)), "current_hash_observed_at")


def srt1_exact_by_size(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.exact_groups(_files(spark, root)).orderBy(F.col("group_size").desc(), "algo", "current_hash")


def _targets(spark: SparkSession, root: str) -> DataFrame:
    """The files of one library, as a batch of lookups."""
    return table(spark, root, "hash_index").filter("library = 'Policies'").select("file_ref").distinct()


def jn4_exact_of_files(spark: SparkSession, root: str) -> DataFrame:
    return _us(duplicates.exact_of(_targets(spark, root), _files(spark, root)), "current_hash_observed_at")


def jn5_stale(spark: SparkSession, root: str) -> DataFrame:
    return _us(duplicates.stale_pairs(_files(spark, root)), "diverged_at")


def jn6_same_name(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.same_name_pairs(_files(spark, root))


def jn7_near(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.near_pairs(_files(spark, root))


def srt2_near_by_distance(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.near_pairs(_files(spark, root)).orderBy("distance", "file_ref_a", "file_ref_b")


def jn8_diverged(spark: SparkSession, root: str) -> DataFrame:
    return _us(duplicates.diverged_pairs(_files(spark, root)), "ancestor_observed_at")


def jn16_signals(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.signals_of(_targets(spark, root), _files(spark, root)).select("target_ref", "signal", "file_ref", "same_size", micros("diverged_at").alias("diverged_at"))


def acl4_signal_gate(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.gated_signals(duplicates.signals_of(_targets(spark, root), _files(spark, root)), _visible(spark, root))


def acl3_visible_report(spark: SparkSession, root: str) -> DataFrame:
    """Totals of the report that a reader sees."""
    return duplicates.totals(duplicates.report(_files(spark, root), _visible(spark, root)))


def agg6_report_totals(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.totals(duplicates.report(_files(spark, root)))


def flt5_allowlisted_totals(spark: SparkSession, root: str) -> DataFrame:
    """Totals without a path and a name, and without the hashes of an allowlist table: those of the index that more than 20 files have."""
    index = table(spark, root, "hash_index")
    often = index.groupBy(F.lower("current_hash").alias("hash")).agg(F.count_distinct("file_ref").alias("n")).filter("n > 20").select("hash")
    return duplicates.totals(duplicates.report(duplicates.hash_allowed(duplicates.base(index, ALLOW), often)))


def flt9_capped_report(spark: SparkSession, root: str) -> DataFrame:
    """The first same-name pairs, as many as a report shows."""
    return duplicates.capped(duplicates.same_name_pairs(_files(spark, root)), "same_name", [F.col("file_ref_a"), F.col("file_ref_b")])


# ---- inventory


def _once(spark: SparkSession, root: str) -> DataFrame:
    """Links once each; repeated rows differ in nothing, so any of them stands for all."""
    return inventory.distinct_links(table(spark, root, "links"))


def agg1_tally_pages(spark: SparkSession, root: str) -> DataFrame:
    return inventory.tally(_once(spark, root).filter("source_kind = 'page'"), ["job_id", "site"])


def agg2_tally_documents(spark: SparkSession, root: str) -> DataFrame:
    return inventory.tally(_once(spark, root).filter("source_kind = 'document'").withColumn("site", F.lower("site")), ["site"])


def agg3_totals(spark: SparkSession, root: str) -> DataFrame:
    return inventory.totals(_once(spark, root), F.col("malformed_reason").isNotNull())


def agg4_visible_totals(spark: SparkSession, root: str) -> DataFrame:
    return inventory.totals(acl.flagged(_once(spark, root), "site", _visible(spark, root)).filter("is_visible"), F.col("malformed_reason").isNotNull())


def flt1_inventory_filter(spark: SparkSession, root: str) -> DataFrame:
    return inventory.filtered(table(spark, root, "links"), site="/sites/tool-crib", cls="relative", text="calendar").select(*KEY, "url")


def flt2_options(spark: SparkSession, root: str) -> DataFrame:
    return inventory.options(table(spark, root, "links"))


def flt6_errors(spark: SparkSession, root: str) -> DataFrame:
    jobs = table(spark, root, "jobs").select(F.explode("recent_errors").alias("error"), "job_id")
    sites = jobs.select(F.regexp_extract("error", "(/[a-z]+/.+)$", 1).alias("site"), "error")
    pages = table(spark, root, "links").filter("malformed_reason is not null").select("site", F.col("source_url").alias("page_url"), F.col("malformed_reason").alias("error"))
    return inventory.errors_listed(sites, pages)


def dst2_canonical_report(spark: SparkSession, root: str) -> DataFrame:
    return inventory.canonical_report(table(spark, root, "links"))


def srt7_canonical_sorted(spark: SparkSession, root: str) -> DataFrame:
    return inventory.canonical_report(table(spark, root, "links")).orderBy("source", "current", "source_url")


def jn13_siblings(spark: SparkSession, root: str) -> DataFrame:
    return inventory.siblings(_once(spark, root))


def jn12_unified(spark: SparkSession, root: str) -> DataFrame:
    jobs = table(spark, root, "jobs").dropDuplicates(["job_id"])
    links = _once(spark, root).join(jobs.select("job_id", "kind", "started_at", "finished_at"), "job_id").withColumn("site", F.lower("site"))
    columns = ["site", "source_kind", "source_url", "started_at", "finished_at"]
    out = inventory.unified(links.filter("kind = 'pages'").select(*columns), links.filter("kind = 'documents'").select(*columns), ["site"])
    return _us(out, "started_at", "finished_at")


def _rollup(spark: SparkSession, root: str) -> DataFrame:
    return inventory.rollup(table(spark, root, "files"), F.coalesce("file_type", F.lit("other")) != "other")


def agg7_preview_rollup(spark: SparkSession, root: str) -> DataFrame:
    return _rollup(spark, root)


def srt5_sites_by_files(spark: SparkSession, root: str) -> DataFrame:
    return _rollup(spark, root).filter("level = 'site'").select("site", "files", "bytes").orderBy(F.col("files").desc(), "site")


def agg8_selected_sum(spark: SparkSession, root: str) -> DataFrame:
    return inventory.selected_sum(_rollup(spark, root), ["/sites/tool-crib", "/SITES/Paint-Line"])


def flt8_top_extensions(spark: SparkSession, root: str) -> DataFrame:
    return inventory.top_extensions(_rollup(spark, root), 3)


def flt7_promoted_sites(spark: SparkSession, root: str) -> DataFrame:
    kept, sites = inventory.promoted(table(spark, root, "files"), ["/sites/Tool-Crib", "/sites/paint-line", "/sites/nowhere"])
    return kept.select(F.lower("site").alias("site")).join(sites, "site").groupBy("site").agg(F.count("*").alias("files"))


# ---- visibility


def acl1_readable_sites(spark: SparkSession, root: str) -> DataFrame:
    sites = table(spark, root, "links").select(F.col("site").alias("site_path")).distinct()
    return acl.readable_sites(sites, _visible(spark, root))


def acl5_trimmed_results(spark: SparkSession, root: str) -> DataFrame:
    """Rows kept and rows of dropped sites per job, by sites in exact spelling."""
    links = table(spark, root, "links").filter("site is not null")
    kept, dropped = acl.trimmed(links, "site", _visible(spark, root))
    gone = links.join(dropped, "site", "left_semi")
    return kept.groupBy("job_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("kept")).unionByName(gone.groupBy("job_id").agg(F.count("*").alias("n")).withColumn("part", F.lit("dropped")))


def acl6_write_gate(spark: SparkSession, root: str) -> DataFrame:
    plan = replace.substring_plan(table(spark, root, "links"), "Shared%20Documents", "Published")
    kept, dropped = acl.trimmed(plan, "site", _visible(spark, root))
    return kept.select("site").distinct().withColumn("part", F.lit("writable")).unionByName(dropped.withColumn("part", F.lit("dropped")))


# ---- exports


def snk4_duplicates_csv(spark: SparkSession, root: str) -> DataFrame:
    rows = duplicates.exact_members(_files(spark, root)).withColumn("address", F.concat(F.lit("intranet.example"), "file_ref"))
    exact = store.csv_lines(rows.withColumn("signal", F.lit("exact")), ["signal", "current_hash", "group_size", "file_name", "address", "size"])
    pairs = duplicates.same_name_pairs(_files(spark, root)).withColumn("signal", F.lit("samename"))
    return exact.unionByName(store.csv_lines(pairs, ["signal", "file_name_a", "file_ref_a", "file_ref_b", "same_size"]))


def snk5_backlinks_csv(spark: SparkSession, root: str) -> DataFrame:
    return store.csv_lines(_flat(spark, root), ["canonical_key", "source_kind", "source_site", "source_site_url", "source_title", "source_url"])


def snk5_library_csv(spark: SparkSession, root: str) -> DataFrame:
    """Files of one library with their backlinks; files without any are left out."""
    files = table(spark, root, "files").filter("library = 'Policies'").select("file_ref")
    found = backlinks.lookup(files, _flat(spark, root)).filter("source_url is not null")
    return store.csv_lines(found, ["file_ref", "source_kind", "source_site", "source_url"])


def snk6_inventory_csv(spark: SparkSession, root: str) -> DataFrame:
    rows = inventory.filtered(table(spark, root, "links"), cls="sharing-link")
    return store.csv_lines(rows, ["site", "source_title", "source_url", "link_class", "source", "text", "url", "normalized_key", "suggestion"])


def snk7_canonical_csv(spark: SparkSession, root: str) -> DataFrame:
    return store.csv_lines(inventory.canonical_report(table(spark, root, "links")), ["source", "site", "source_kind", "text", "current", "suggested", "link_class"])


QUERIES = {f.__name__: f for f in (
    dst1_source_targets, st7_one_shot_index, srt3_flat_by_key, jn1_lookup, jn2_lookup_batch, acl2_backlink_gate, st1_slices, agg16_targets_of_source, st2_merged_slices, st6_inflated, st8_latest_jobs,
    st8_rebuilt_index, agg9_page_scanned_sites, agg14_rebuild_stats, agg15_freshest, jn3_orphans, jn3_orphans_of_scanned_sites, agg10_orphan_totals, agg5_exact_groups, agg5_exact_members, srt1_exact_by_size, jn4_exact_of_files,
    jn5_stale, jn6_same_name, jn7_near, srt2_near_by_distance, jn8_diverged, jn16_signals, acl4_signal_gate, acl3_visible_report, agg6_report_totals, flt5_allowlisted_totals, flt9_capped_report,
    agg1_tally_pages, agg2_tally_documents, agg3_totals, agg4_visible_totals, flt1_inventory_filter, flt2_options, flt6_errors, dst2_canonical_report, srt7_canonical_sorted, jn13_siblings, jn12_unified,
    agg7_preview_rollup, srt5_sites_by_files, agg8_selected_sum, flt8_top_extensions, flt7_promoted_sites, acl1_readable_sites, acl5_trimmed_results, acl6_write_gate,
    snk4_duplicates_csv, snk5_backlinks_csv, snk5_library_csv, snk6_inventory_csv, snk7_canonical_csv,
)}

# ---- SQL


def label_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '/(sites|teams)/[^/]+', 'i') THEN regexp_extract({c}, '/(?:sites|teams)/([^/]+)', 1, 'i') WHEN replace(coalesce({c}, ''), '/', '') = '' THEN 'root' ELSE list_filter(string_split({c}, '/'), lambda s: s <> '')[-1] END"


def abs_sql(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' OR regexp_matches({c}, '^https?://', 'i') THEN coalesce({c}, '') WHEN {c}[1] = '/' THEN 'https://intranet.example' || {c} ELSE 'https://intranet.example/' || {c} END"


def path_only_sql(c: str) -> str:
    return f"CASE WHEN starts_with({c}, 'intranet.example/') THEN {c}[17:] ELSE coalesce({c}, '') END"


_FLAT = f"""scanned AS (SELECT l.*, j.started_at AS scanned_at FROM links l LEFT JOIN (SELECT DISTINCT job_id, started_at FROM jobs) j USING (job_id)),
flat AS (SELECT DISTINCT {path_only_sql('canonical_key')} AS canonical_key, source_kind, {label_sql('site')} AS source_site, lower(coalesce(site, '')) AS source_site_path, {abs_sql('site')} AS source_site_url,
  coalesce(source_title, CASE WHEN source_kind = 'document' THEN '(unnamed file)' ELSE '(untitled page)' END) AS source_title, {abs_sql('source_url')} AS source_url, scanned_at AS source_updated_at FROM scanned WHERE {path_only_sql('canonical_key')} <> '')"""
_FLAT_US = "canonical_key, source_kind, source_site, source_site_path, source_site_url, source_title, source_url, epoch_us(source_updated_at) AS source_updated_at"
_SINGLE = "single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key, source_kind, source_url ORDER BY source_updated_at NULLS FIRST, source_title, source_site, source_site_path, source_site_url) AS rn FROM flat) WHERE rn = 1)"
_FILE_KEYS = f"refs AS (SELECT DISTINCT file_ref, {abs_sql('file_ref')} AS u FROM files), {norm_sql('fk', 'refs', 'u', 'nkey')}, keyed AS (SELECT file_ref, nullif({path_only_sql('nkey')}, '') AS canonical_key FROM fk)"
_MEMBERS_SLICE = """src AS (SELECT source_site_path AS site_path, source_kind AS kind, source_url AS url, min(source_title) AS title, list_sort(list(DISTINCT canonical_key)) AS links_to FROM flat WHERE source_site_path <> '' GROUP BY 1, 2, 3),
meta AS (SELECT lower(site) AS site_path, source_kind AS kind, min(site) AS raw FROM links WHERE site <> '' GROUP BY 1, 2)"""
_ASSET_KEYS = f"au AS (SELECT *, {abs_sql('url')} AS u FROM assets), {norm_sql('ak', 'au', 'u', 'nkey')}, asset_keys AS (SELECT site_path, url, name, size, modified, {path_only_sql('nkey')} AS canonical_key FROM ak)"
_ORPHANS = "orphaned AS (SELECT site_path, url, name, regexp_extract(coalesce(url, ''), '/SiteAssets/SitePages/([^/]+)', 1, 'i') AS page_folder, size, modified, canonical_key FROM asset_keys WHERE canonical_key <> '' AND canonical_key NOT IN (SELECT canonical_key FROM flat))"
_BASE = """cleaned AS (SELECT file_ref, lower(current_hash) AS current_hash, coalesce(nullif(algo, ''), 'full-sha256') AS algo, nullif(file_name, '') AS file_name, size, nullif(site_path, '') AS site_path, nullif(library, '') AS library,
  current_hash_observed_at, nullif(text_hash, '') AS text_hash, CASE WHEN text_hash <> '' THEN simhash64 END AS simhash64, previous, last_confirmed_at FROM hash_index WHERE file_ref <> '' AND current_hash <> ''),
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_ref ORDER BY last_confirmed_at DESC NULLS LAST, coalesce(len(previous), 0) DESC, current_hash_observed_at DESC NULLS LAST, current_hash DESC, algo DESC,
  file_name DESC NULLS LAST, size DESC NULLS LAST, site_path DESC NULLS LAST, library DESC NULLS LAST, text_hash DESC NULLS LAST, simhash64 DESC NULLS LAST) AS rn FROM cleaned) WHERE rn = 1)"""
_HISTORY = """hist AS (SELECT file_ref, pos, lower(p.hash) AS hash, coalesce(nullif(p.algo, ''), 'full-sha256') AS algo, p.observed_at AS observed_at, nullif(p.text_hash, '') AS text_hash
  FROM (SELECT file_ref, unnest(previous) AS p, generate_subscripts(previous, 1) - 1 AS pos FROM base) WHERE p.hash <> '')"""
_SEES = "visible AS (SELECT DISTINCT lower(site_path) AS s FROM visible_sites WHERE site_path <> '')"


def _signals(base: str, hist: str = "hist", seen: bool = False, names: str = "true") -> str:
    """CTEs exact, stale, same_name, near and diverged over a base."""
    mine = f"(SELECT * FROM {base} WHERE lower(site_path) IN (SELECT s FROM visible))" if seen else base
    both = lambda a, b: f" AND lower({a}) IN (SELECT s FROM visible) AND lower({b}) IN (SELECT s FROM visible)" if seen else ""
    differ = "NOT (a.algo = b.algo AND a.current_hash = b.current_hash)"
    return f"""exact AS (SELECT algo, current_hash, count(*) AS group_size, min(file_ref) AS first_ref, CAST(sum(size) AS BIGINT) AS total_size FROM {mine} GROUP BY 1, 2 HAVING count(*) >= 2),
firsts AS (SELECT DISTINCT ON (file_ref, algo, hash) file_ref, algo, hash, observed_at AS diverged_at FROM {hist} ORDER BY file_ref, algo, hash, pos),
stale AS (SELECT a.file_ref AS stale_ref, a.site_path AS stale_site, a.current_hash AS stale_hash, b.file_ref AS authoritative_ref, b.site_path AS authoritative_site, b.current_hash AS authoritative_hash, f.diverged_at
  FROM {base} a JOIN firsts f ON f.algo = a.algo AND f.hash = a.current_hash AND f.file_ref <> a.file_ref JOIN {base} b ON b.file_ref = f.file_ref WHERE {differ}{both('a.site_path', 'b.site_path')}),
same_name AS (SELECT a.file_ref AS file_ref_a, b.file_ref AS file_ref_b, a.site_path AS site_path_a, b.site_path AS site_path_b, a.file_name AS file_name_a, b.file_name AS file_name_b, a.size IS NOT DISTINCT FROM b.size AS same_size
  FROM {base} a JOIN {base} b ON lower(a.file_name) = lower(b.file_name) AND a.file_ref < b.file_ref WHERE {differ} AND {names.replace('file_name', 'a.file_name')} AND {names.replace('file_name', 'b.file_name')}{both('a.site_path', 'b.site_path')}),
near AS (SELECT a.file_ref AS file_ref_a, b.file_ref AS file_ref_b, a.site_path AS site_path_a, b.site_path AS site_path_b, bit_count(xor(a.simhash64, b.simhash64)) AS distance FROM {base} a JOIN {base} b ON a.file_ref < b.file_ref AND bit_count(xor(a.simhash64, b.simhash64)) <= 3 WHERE {differ}{both('a.site_path', 'b.site_path')}),
texts AS (SELECT file_ref, text_hash, min(observed_at) AS at FROM {hist} WHERE text_hash IS NOT NULL GROUP BY 1, 2),
ancestors AS (SELECT a.file_ref AS file_ref_a, b.file_ref AS file_ref_b, a.text_hash, CASE WHEN a.at IS NULL THEN b.at WHEN b.at IS NULL THEN a.at ELSE least(a.at, b.at) END AS at FROM texts a JOIN texts b ON a.text_hash = b.text_hash AND a.file_ref < b.file_ref),
first_ancestor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_ref_a, file_ref_b ORDER BY at NULLS FIRST, text_hash) AS rn FROM ancestors) WHERE rn = 1),
diverged AS (SELECT p.file_ref_a, p.file_ref_b, a.site_path AS site_path_a, b.site_path AS site_path_b, p.text_hash AS ancestor_text_hash, p.at AS ancestor_observed_at FROM first_ancestor p JOIN {base} a ON a.file_ref = p.file_ref_a JOIN {base} b ON b.file_ref = p.file_ref_b
  WHERE {differ} AND NOT EXISTS (SELECT 1 FROM {hist} h WHERE h.file_ref = b.file_ref AND h.algo = a.algo AND h.hash = a.current_hash) AND NOT EXISTS (SELECT 1 FROM {hist} h WHERE h.file_ref = a.file_ref AND h.algo = b.algo AND h.hash = b.current_hash){both('a.site_path', 'b.site_path')})"""


_TOTALS = """SELECT 'exact' AS signal, count(*) AS total FROM exact UNION ALL SELECT 'stale', count(DISTINCT stale_ref) FROM stale UNION ALL SELECT 'same_name', count(*) FROM same_name
UNION ALL SELECT 'near', count(*) FROM near UNION ALL SELECT 'diverged', count(*) FROM diverged"""
_DUP = f"{_BASE}, {_HISTORY}, {_signals('base')}"
_TARGETED = f"""{_DUP}, targets AS (SELECT DISTINCT file_ref FROM hash_index WHERE library = 'Policies'),
signals AS (SELECT a.file_ref AS target_ref, 'exact' AS signal, b.file_ref, b.site_path, CAST(NULL AS BOOLEAN) AS same_size, CAST(NULL AS TIMESTAMP) AS diverged_at FROM base a JOIN base b ON a.algo = b.algo AND a.current_hash = b.current_hash AND a.file_ref <> b.file_ref WHERE a.file_ref IN (FROM targets)
  UNION ALL SELECT stale_ref, 'stale', authoritative_ref, authoritative_site, NULL, diverged_at FROM stale WHERE stale_ref IN (FROM targets)
  UNION ALL SELECT file_ref_a, 'same_name', file_ref_b, site_path_b, same_size, NULL FROM same_name WHERE file_ref_a IN (FROM targets)
  UNION ALL SELECT file_ref_b, 'same_name', file_ref_a, site_path_a, same_size, NULL FROM same_name WHERE file_ref_b IN (FROM targets))"""
_ONCE = "once AS (SELECT DISTINCT * FROM links)"
_TALLY = "SELECT {by}, CASE WHEN grouping(link_class) = 0 THEN 'class' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension, CASE WHEN grouping(link_class) = 0 THEN link_class WHEN grouping(source) = 0 THEN source END AS value, count(*) AS n FROM {src} GROUP BY GROUPING SETS (({by}, link_class), ({by}, source), ({by}))"
_FACTS = "SELECT count(DISTINCT lower(site)) AS sites, count(DISTINCT (source_kind, source_url)) FILTER (source_kind IS NOT NULL AND source_url IS NOT NULL) AS sources, count(*) AS links, count(*) FILTER (malformed_reason IS NOT NULL) AS errors FROM once"
_REPORT = """picked AS (SELECT *, row_number() OVER (PARTITION BY source_url, url ORDER BY job_id, source_id, link_idx, coalesce(nullif(source_title, ''), source_url) NULLS FIRST, site NULLS FIRST, source_kind NULLS FIRST, coalesce(text, ''), suggestion, link_class) AS rn
  FROM links WHERE link_class IN ('sharing-link', 'office-online', 'spo-internal', 'malformed-spo-link') AND suggestion <> ''),
report AS (SELECT coalesce(nullif(source_title, ''), source_url) AS source, source_url, site, source_kind, coalesce(text, '') AS text, url AS current, suggestion AS suggested, link_class FROM picked WHERE rn = 1)"""
_ROLL = """rolled AS (SELECT CASE grouping(site, library, bucket, ext) WHEN 7 THEN 'site' WHEN 3 THEN 'library' WHEN 4 THEN 'site-extension' WHEN 12 THEN 'extension' ELSE 'all' END AS level, site, library, bucket, ext AS extension, count(*) AS files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes
  FROM (SELECT lower(site) AS site, library, CASE WHEN coalesce(file_type, 'other') <> 'other' THEN 'included' ELSE 'excluded' END AS bucket, lower(extension) AS ext, length FROM files) GROUP BY GROUPING SETS ((site), (site, library), (site, bucket, ext), (bucket, ext), ()))"""


def csv_sql(*columns: str) -> str:
    one = lambda c: f"""CASE WHEN regexp_matches(coalesce(CAST({c} AS VARCHAR), ''), '[",\\r\\n]') THEN '"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '"', '""') || '"' ELSE coalesce(CAST({c} AS VARCHAR), '') END"""
    return " || ',' || ".join(one(c) for c in columns) + " AS line"


SQL = {
    "dst1_source_targets": f"WITH {_FLAT} SELECT DISTINCT canonical_key, source_kind, source_url FROM flat",
    "st7_one_shot_index": f"WITH {_FLAT} SELECT {_FLAT_US} FROM flat",
    "srt3_flat_by_key": f"WITH {_FLAT} SELECT {_FLAT_US} FROM flat",
    "jn1_lookup": f"WITH {_FLAT}, {_SINGLE}, {_FILE_KEYS} SELECT k.file_ref, s.* EXCLUDE (rn) REPLACE (epoch_us(source_updated_at) AS source_updated_at) FROM (SELECT * FROM keyed WHERE file_ref = '{HOT}') k JOIN single s USING (canonical_key)",
    "jn2_lookup_batch": f"WITH {_FLAT}, {_SINGLE}, {_FILE_KEYS} SELECT file_ref, count(source_url) AS n_backlinks, min(source_url) AS first_source FROM keyed LEFT JOIN single USING (canonical_key) GROUP BY 1",
    "acl2_backlink_gate": f"WITH {_FLAT}, {_SINGLE}, {_FILE_KEYS}, {_SEES} SELECT file_ref, count(*) FILTER (source_site_path IN (SELECT s FROM visible)) AS visible_count, count(*) FILTER (source_site_path NOT IN (SELECT s FROM visible)) AS hidden_count FROM keyed JOIN single USING (canonical_key) GROUP BY 1",
    "st1_slices": f"WITH {_FLAT}, {_MEMBERS_SLICE} SELECT site_path, kind, {label_sql('raw')} AS label, {abs_sql('raw')} AS url, coalesce(n_sources, 0) AS n_sources, coalesce(n_targets, 0) AS n_targets FROM meta LEFT JOIN (SELECT site_path, kind, count(*) AS n_sources, CAST(sum(len(links_to)) AS BIGINT) AS n_targets FROM src GROUP BY 1, 2) USING (site_path, kind)",
    "agg16_targets_of_source": f"WITH {_FLAT}, {_MEMBERS_SLICE} SELECT site_path, kind, url, title, array_to_string(links_to, '|') AS links_to FROM src",
    "st2_merged_slices": f"""WITH {_FLAT},
old AS (SELECT source_site_path AS site_path, source_kind AS kind, source_url AS url, count(DISTINCT canonical_key) AS n_targets FROM flat WHERE source_updated_at < '2025-01-01' AND source_site_path <> '' GROUP BY 1, 2, 3),
new AS (SELECT source_site_path AS site_path, source_kind AS kind, source_url AS url, count(DISTINCT canonical_key) AS n_targets FROM flat WHERE source_updated_at >= '2025-01-01' AND source_kind = 'page' AND source_site_path <> '' GROUP BY 1, 2, 3),
sc AS (SELECT DISTINCT lower(site) AS site_path FROM scanned WHERE scanned_at >= '2025-01-01' AND source_kind = 'page' AND site <> '')
SELECT * FROM old WHERE NOT (kind = 'page' AND site_path IN (SELECT site_path FROM sc)) UNION ALL SELECT * FROM new""",
    "st6_inflated": f"WITH {_FLAT}, {_MEMBERS_SLICE} SELECT unnest(links_to) AS canonical_key, kind AS source_kind, {label_sql('raw')} AS source_site, site_path AS source_site_path, {abs_sql('raw')} AS source_site_url, title AS source_title, url AS source_url FROM src JOIN meta USING (site_path, kind)",
    "st8_latest_jobs": "SELECT kind, job_id FROM (SELECT kind, job_id, row_number() OVER (PARTITION BY kind ORDER BY started_at DESC, job_id) AS rn FROM jobs WHERE kind IN ('pages', 'documents') AND status = 'completed' AND results_available) WHERE rn = 1",
    "st8_rebuilt_index": f"WITH latest AS (SELECT job_id FROM (SELECT job_id, row_number() OVER (PARTITION BY kind ORDER BY started_at DESC, job_id) AS rn FROM jobs WHERE kind IN ('pages', 'documents') AND status = 'completed' AND results_available) WHERE rn = 1), {_FLAT.replace('USING (job_id)),', 'USING (job_id) WHERE job_id IN (SELECT job_id FROM latest)),', 1)} SELECT {_FLAT_US} FROM flat",
    "agg9_page_scanned_sites": f"WITH {_FLAT} SELECT source_site_path, min(source_site_url) AS site_url FROM flat WHERE source_kind = 'page' GROUP BY 1",
    "agg14_rebuild_stats": f"WITH {_FLAT}, {_MEMBERS_SLICE} SELECT count(DISTINCT site_path) AS sites, count(DISTINCT site_path) FILTER (kind = 'page') AS sites_with_pages, count(DISTINCT site_path) FILTER (kind = 'document') AS sites_with_documents FROM meta",
    "agg15_freshest": "SELECT epoch_us(max(j.started_at)) AS freshest FROM links JOIN jobs j USING (job_id)",
    "jn3_orphans": f"WITH {_FLAT}, {_ASSET_KEYS}, {_ORPHANS} SELECT * REPLACE (epoch_us(modified) AS modified) FROM orphaned",
    "jn3_orphans_of_scanned_sites": f"WITH {_FLAT}, {_ASSET_KEYS}, {_ORPHANS} SELECT url, canonical_key FROM orphaned WHERE lower(regexp_extract(url, '^(/(?:sites|teams)/[^/]+)/', 1, 'i')) IN (SELECT source_site_path FROM flat WHERE source_kind = 'page')",
    "agg10_orphan_totals": f"WITH {_FLAT}, {_ASSET_KEYS}, {_ORPHANS} SELECT (SELECT count(DISTINCT lower(regexp_extract(coalesce(url, ''), '^(/(?:sites|teams)/[^/]+)/', 1, 'i'))) FROM assets) AS sites, (SELECT count(*) FROM assets) AS files, (SELECT count(*) FROM orphaned) AS orphans",
    "agg5_exact_groups": f"WITH {_DUP} SELECT * FROM exact",
    "srt1_exact_by_size": f"WITH {_DUP} SELECT * FROM exact",
    "agg5_exact_members": f"WITH {_DUP} SELECT b.algo, b.current_hash, e.group_size, file_ref, file_name, site_path, library, size, epoch_us(current_hash_observed_at) AS current_hash_observed_at FROM base b JOIN exact e USING (algo, current_hash)",
    "jn4_exact_of_files": f"WITH {_DUP} SELECT a.file_ref AS target_ref, b.file_ref, b.file_name, b.site_path, b.library, b.size, b.current_hash, epoch_us(b.current_hash_observed_at) AS current_hash_observed_at FROM base a JOIN base b USING (algo, current_hash) WHERE a.file_ref <> b.file_ref AND a.file_ref IN (SELECT file_ref FROM hash_index WHERE library = 'Policies')",
    "jn5_stale": f"WITH {_DUP} SELECT * REPLACE (epoch_us(diverged_at) AS diverged_at) FROM stale",
    "jn6_same_name": f"WITH {_DUP} SELECT * FROM same_name",
    "jn7_near": f"WITH {_DUP} SELECT * FROM near",
    "srt2_near_by_distance": f"WITH {_DUP} SELECT * FROM near",
    "jn8_diverged": f"WITH {_DUP} SELECT * REPLACE (epoch_us(ancestor_observed_at) AS ancestor_observed_at) FROM diverged",
    "jn16_signals": f"WITH {_TARGETED} SELECT target_ref, signal, file_ref, same_size, epoch_us(diverged_at) AS diverged_at FROM signals",
    "acl4_signal_gate": f"WITH {_TARGETED}, {_SEES} SELECT target_ref, signal, count(*) FILTER (coalesce(lower(site_path) IN (SELECT s FROM visible), false)) AS visible_count, count(*) FILTER (NOT coalesce(lower(site_path) IN (SELECT s FROM visible), false)) AS hidden_count FROM signals GROUP BY 1, 2",
    "acl3_visible_report": f"WITH {_BASE}, {_HISTORY}, {_SEES}, {_signals('base', seen=True)} {_TOTALS}",
    "agg6_report_totals": f"WITH {_DUP} {_TOTALS}",
    "flt5_allowlisted_totals": f"""WITH {_BASE}, often AS (SELECT lower(current_hash) AS hash FROM hash_index GROUP BY 1 HAVING count(DISTINCT file_ref) > 20),
allowed AS (SELECT * FROM base WHERE NOT regexp_matches(file_ref, '(?i)^/sites/tool-crib/.*$') AND current_hash NOT IN (SELECT hash FROM often)), {_HISTORY.replace('FROM base', 'FROM allowed')}, {_signals('allowed', names="NOT regexp_matches(file_name, '(?i)^[^/]*[.]pdf$')")} {_TOTALS}""",
    "flt9_capped_report": f"WITH {_DUP} SELECT * FROM same_name ORDER BY file_ref_a, file_ref_b LIMIT 500",
    "agg1_tally_pages": f"WITH {_ONCE} " + _TALLY.format(by="job_id, site", src="(SELECT * FROM once WHERE source_kind = 'page')"),
    "agg2_tally_documents": f"WITH {_ONCE} " + _TALLY.format(by="site", src="(SELECT * REPLACE (lower(site) AS site) FROM once WHERE source_kind = 'document')"),
    "agg3_totals": f"WITH {_ONCE} {_FACTS}",
    "agg4_visible_totals": f"WITH {_ONCE}, {_SEES} {_FACTS} WHERE lower(site) IN (SELECT s FROM visible)",
    "flt1_inventory_filter": "SELECT job_id, source_id, link_idx, url FROM links WHERE site = '/sites/tool-crib' AND link_class = 'relative' AND contains(lower(coalesce(source_title, '') || chr(10) || coalesce(url, '') || chr(10) || coalesce(text, '')), 'calendar')",
    "flt2_options": "SELECT DISTINCT 'source' AS field, source AS value FROM links WHERE source <> '' UNION ALL SELECT DISTINCT 'site', site FROM links WHERE site <> ''",
    "flt6_errors": "SELECT 'site' AS scope, regexp_extract(error, '(/[a-z]+/.+)$', 1) AS site, '' AS subject, error FROM (SELECT unnest(recent_errors) AS error FROM jobs) WHERE error <> '' UNION ALL SELECT 'page', site, source_url, malformed_reason FROM links WHERE malformed_reason <> ''",
    "dst2_canonical_report": f"WITH {_REPORT} SELECT * FROM report",
    "srt7_canonical_sorted": f"WITH {_REPORT} SELECT * FROM report",
    "jn13_siblings": f"WITH {_ONCE}, per AS (SELECT canonical_key, source_kind, count(*) AS n FROM once WHERE canonical_key <> '' GROUP BY 1, 2) SELECT job_id, source_id, link_idx, o.canonical_key, o.source_kind, p.n - 1 AS same_kind, CAST((SELECT sum(n) FROM per q WHERE q.canonical_key = o.canonical_key) AS BIGINT) - p.n AS other_kind FROM once o JOIN per p ON p.canonical_key = o.canonical_key AND p.source_kind = o.source_kind",
    "jn12_unified": f"WITH {_ONCE} SELECT lower(o.site) AS site, count(*) AS links, count(DISTINCT (source_kind, source_url)) FILTER (source_kind IS NOT NULL AND source_url IS NOT NULL) AS sources, epoch_us(min(j.started_at)) AS started_at, epoch_us(max(j.finished_at)) AS finished_at FROM once o JOIN (SELECT DISTINCT job_id, kind, started_at, finished_at FROM jobs) j USING (job_id) WHERE kind IN ('pages', 'documents') GROUP BY 1",
    "agg7_preview_rollup": f"WITH {_ROLL} SELECT * FROM rolled",
    "srt5_sites_by_files": f"WITH {_ROLL} SELECT site, files, bytes FROM rolled WHERE level = 'site'",
    "agg8_selected_sum": "SELECT count(*) AS files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM files WHERE lower(site) IN ('/sites/tool-crib', '/sites/paint-line')",
    "flt8_top_extensions": f"WITH {_ROLL}, placed AS (SELECT bucket, extension, files, bytes, row_number() OVER (PARTITION BY bucket ORDER BY files DESC, extension NULLS FIRST) AS place FROM rolled WHERE level = 'extension') SELECT * FROM placed WHERE place <= 3",
    "flt7_promoted_sites": "SELECT lower(site) AS site, count(*) AS files FROM files WHERE lower(site) IN ('/sites/tool-crib', '/sites/paint-line', '/sites/nowhere') GROUP BY 1",
    "acl1_readable_sites": f"WITH {_SEES} SELECT DISTINCT site AS site_path FROM links WHERE lower(site) IN (SELECT s FROM visible)",
    "acl5_trimmed_results": "SELECT job_id, count(*) AS n, CASE WHEN site IN (SELECT site_path FROM visible_sites WHERE site_path IS NOT NULL) THEN 'kept' ELSE 'dropped' END AS part FROM links WHERE site IS NOT NULL GROUP BY 1, 3",
    "acl6_write_gate": "SELECT DISTINCT site, CASE WHEN site IN (SELECT site_path FROM visible_sites WHERE site_path IS NOT NULL) THEN 'writable' ELSE 'dropped' END AS part FROM links WHERE source_kind = 'page' AND contains(url, 'Shared%20Documents') AND site IS NOT NULL",
    "snk4_duplicates_csv": f"WITH {_DUP}, rows AS (SELECT b.*, e.group_size, 'intranet.example' || file_ref AS address FROM base b JOIN exact e USING (algo, current_hash)) SELECT {csv_sql(chr(39) + 'exact' + chr(39), 'current_hash', 'group_size', 'file_name', 'address', 'size')} FROM rows UNION ALL SELECT {csv_sql(chr(39) + 'samename' + chr(39), 'file_name_a', 'file_ref_a', 'file_ref_b', 'CASE WHEN same_size THEN ' + chr(39) + 'yes' + chr(39) + ' ELSE ' + chr(39) + 'no' + chr(39) + ' END')} FROM same_name",
    "snk5_backlinks_csv": f"WITH {_FLAT} SELECT {csv_sql('canonical_key', 'source_kind', 'source_site', 'source_site_url', 'source_title', 'source_url')} FROM flat",
    "snk5_library_csv": f"WITH {_FLAT}, {_SINGLE}, {_FILE_KEYS} SELECT {csv_sql('file_ref', 'source_kind', 'source_site', 'source_url')} FROM keyed JOIN single USING (canonical_key) WHERE file_ref IN (SELECT file_ref FROM files WHERE library = 'Policies')",
    "snk6_inventory_csv": f"SELECT {csv_sql('site', 'source_title', 'source_url', 'link_class', 'source', 'text', 'url', 'normalized_key', 'suggestion')} FROM links WHERE link_class = 'sharing-link'",
    "snk7_canonical_csv": f"WITH {_REPORT} SELECT {csv_sql('source', 'site', 'source_kind', 'text', 'current', 'suggested', 'link_class')} FROM report",
}
