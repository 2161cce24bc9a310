"""Queries of the general data-pipeline problems (p1, p2, p6) over the engine's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.keys import blank_to_null, canonical_form, clean_hash, effective_algo, micros
from linkloom.operators import history, references, skew
from linkloom.sources.tables import table

#: The text of a content: all sources know it, so a new content seen without text has none.
TEXT = {"hash": ["text_hash", "simhash64"]}
HISTORY_ATTRIBUTES = ["hash", "algo", "text_hash", "simhash64", "file_name", "size", "etag", "site_path", "library"]
#: Text of a GUID folder, with or without braces.
GUID = r"^\{?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\}?$"


def sightings(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """Events of the files: previous and current contents of hash_index, then observations.

    origin 0 is the index, 1 an observation; place is the position in previous (the current one follows) or the ordinal.
    Columns that a source does not know are null, and so is simhash64 without text. Sightings need file_ref, hash and observed_at.
    """
    index, seen = table(spark, root, "hash_index"), table(spark, root, "observations")

    def pick(df: DataFrame, known: dict[str, object], at: object, origin: int, place: object) -> DataFrame:
        chosen = [(known[c] if c in known else F.lit(None).cast("string")).cast("string").alias(c) for c in columns]
        return df.select("file_ref", at.alias("at"), F.lit(origin).alias("origin"), place.cast("long").alias("place"), *chosen, clean_hash(known["hash"]).alias("_hash"))

    simhash = lambda prefix: F.when(blank_to_null(f"{prefix}text_hash").isNotNull(), F.col(f"{prefix}simhash64"))
    of = lambda prefix: {"text_hash": F.col(f"{prefix}text_hash"), "simhash64": simhash(prefix), "hash": clean_hash(f"{prefix}hash"), "algo": effective_algo(f"{prefix}algo")}
    old = index.select("file_ref", F.posexplode("previous").alias("pos", "p"))
    previous = pick(old, of("p."), F.col("p.observed_at"), 0, F.col("pos"))
    own = {c: F.col(c) for c in ("text_hash", "file_name", "size", "etag", "site_path", "library")} | {"simhash64": simhash(""), "hash": clean_hash("current_hash"), "algo": effective_algo("algo")}
    current = pick(index, own, F.col("current_hash_observed_at"), 0, F.greatest(F.coalesce(F.size("previous"), F.lit(0)), F.lit(0)))
    rest = {c: F.col(c) for c in ("file_name", "size", "etag", "site_path", "library")}
    observed = pick(seen, of("") | rest, F.col("observed_at"), 1, F.col("ordinal"))
    every = previous.unionByName(current).unionByName(observed)
    return every.filter("file_ref is not null and file_ref != '' and _hash is not null and at is not null").drop("_hash")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The log of the attribute ``hash``: each first sighting of an unbroken run, once."""
    log = history.attribute_log(sightings(spark, root, ["hash"]), "file_ref", ["at", "origin", "place"], ["hash"])
    return log.select("file_ref", F.col("value").alias("hash"), micros("valid_from").alias("valid_from_us")).distinct()


def p1_attribute_log(spark: SparkSession, root: str) -> DataFrame:
    """Every version of every attribute of every file with its own interval."""
    log = history.attribute_log(sightings(spark, root, HISTORY_ATTRIBUTES), "file_ref", ["at", "origin", "place"], HISTORY_ATTRIBUTES, parts=TEXT)
    return log.filter("value is not null").select("file_ref", "attribute", "value", micros("valid_from").alias("valid_from_us"), micros("valid_to").alias("valid_to_us"))


def p1_history(spark: SparkSession, root: str) -> DataFrame:
    """The whole state of every file between neighbouring changes of any attribute."""
    log = history.attribute_log(sightings(spark, root, HISTORY_ATTRIBUTES), "file_ref", ["at", "origin", "place"], HISTORY_ATTRIBUTES, parts=TEXT)
    combined = history.combine(log, "file_ref", HISTORY_ATTRIBUTES)
    return combined.select("file_ref", *HISTORY_ATTRIBUTES, micros("valid_from").alias("valid_from_us"), micros("valid_to").alias("valid_to_us"))


def _month(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM")


def orphan_references(spark: SparkSession, root: str) -> DataFrame:
    """Orphans of all three relations (link-target, page-folder, orphan-file) in one pass of the operator."""
    links, files, pages, assets = (table(spark, root, t) for t in ("links", "files", "raw_pages", "assets"))
    jobs = table(spark, root, "jobs").select("job_id", _month("started_at").alias("period")).dropDuplicates(["job_id"])

    raw = links.filter(blank_to_null("canonical_key").isNotNull()).groupBy("canonical_key", "job_id").agg(F.count("*").alias("n_refs"))
    keyed = raw.withColumn("key", canonical_form("canonical_key"))
    targets = keyed.filter(F.col("key").startswith("/")).join(jobs, "job_id", "left")
    targets = targets.groupBy("key", "period").agg(F.sum("n_refs").alias("n_refs")).select(F.lit("link-target").alias("relation"), "key", F.col("key").alias("ref_key"), "period", "n_refs")

    url = assets.select(canonical_form("url").alias("ref_key"), _month("modified").alias("period")).filter("ref_key is not null and ref_key != ''")
    url = url.groupBy("ref_key", "period").agg(F.count("*").alias("n_refs"))
    orphan_file = url.select(F.lit("orphan-file").alias("relation"), F.col("ref_key").alias("key"), "ref_key", "period", "n_refs")
    below = r"^(/[^/]+/[^/]+)/siteassets/sitepages/([^/]+)/."
    folder = F.regexp_extract("ref_key", below, 2)
    in_folder = url.withColumn("_folder", folder).filter((F.col("_folder") != "") & ~F.col("_folder").rlike(GUID))
    page_folder = in_folder.select(F.lit("page-folder").alias("relation"), F.concat_ws("/", F.regexp_extract("ref_key", below, 1), "_folder").alias("key"), "ref_key", "period", "n_refs")

    leaf = F.regexp_replace(canonical_form("leaf"), r"\.aspx$", "")
    site = F.concat(F.lit("/"), F.regexp_replace(canonical_form("site"), "^/+", ""))
    parents = [
        *(df.select(F.lit("link-target").alias("relation"), canonical_form(c).alias("key")) for df, c in ((files, "file_ref"), (pages, "page_url"), (assets, "url"))),
        pages.select(F.lit("page-folder").alias("relation"), F.concat(site, F.lit("/"), leaf).alias("key")),
        links.filter(blank_to_null("canonical_key").isNotNull()).select("canonical_key").distinct().select(F.lit("orphan-file").alias("relation"), canonical_form("canonical_key").alias("key")),
    ]
    known = parents[0]
    for p in parents[1:]:
        known = known.unionByName(p)
    return references.find_orphans(targets.unionByName(page_folder).unionByName(orphan_file), known)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Each orphan (kind, ref_key, period) once; the operator's input is distinct already."""
    return orphan_references(spark, root).select(F.col("relation").alias("kind"), "ref_key", "period")


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphan keys and references per kind and month."""
    return references.report(orphan_references(spark, root))


def key_counts(spark: SparkSession, root: str) -> DataFrame:
    """The result per canonical key: links, distinct sources, visible sources and hidden count."""
    links = table(spark, root, "links").filter(blank_to_null("canonical_key").isNotNull())
    seen = table(spark, root, "visible_sites").select(F.lower("site_path").alias("_site")).filter("_site is not null").distinct().withColumn("_visible", F.lit(True))
    grouped = links.groupBy("canonical_key", "source_kind", "source_url", F.lower("site").alias("_site")).agg(F.count("*").alias("_n"))
    rows = grouped.withColumn("canonical_key", canonical_form("canonical_key")).join(seen, "_site", "left")
    return skew.salted_counts(rows, "canonical_key", ["source_kind", "source_url"], "_visible", weight="_n")


def p6_key_counts(spark: SparkSession, root: str) -> DataFrame:
    return key_counts(spark, root)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Keys with at least 1 % of the rows that have a key."""
    keyed = table(spark, root, "links").filter(blank_to_null("canonical_key").isNotNull()).count()
    return key_counts(spark, root).filter(F.col("n_links") * 100 >= F.lit(keyed)).select("canonical_key")


QUERIES = {f.__name__: f for f in (p1_found, p1_attribute_log, p1_history, p2_found, p2_report, p6_found, p6_key_counts)}

#: DuckDB: the canonical form of an expression.
_CANON = r"regexp_replace(translate(url_decode(regexp_replace({0}, '^(?:https?:)?(?://)?intranet\.example(?::[0-9]+)?(/|$)', '\1', 'i')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/+$', '')"


def canon_sql(expression: str) -> str:
    return _CANON.format(expression)


_SIGHTINGS = """
sightings AS (
  SELECT file_ref, lower(p.hash) AS hash, p.observed_at AS seen_at, 0 AS origin, pos AS place
  FROM (SELECT file_ref, unnest(previous) AS p, generate_subscripts(previous, 1) - 1 AS pos FROM hash_index)
  UNION ALL SELECT file_ref, lower(current_hash), current_hash_observed_at, 0, coalesce(len(previous), 0) FROM hash_index
  UNION ALL SELECT file_ref, lower(hash), observed_at, 1, ordinal FROM observations),
usable AS (SELECT * FROM sightings WHERE file_ref <> '' AND hash <> '' AND seen_at IS NOT NULL)
"""
_PARENTS = f"""
parents AS (
  SELECT {canon_sql('file_ref')} AS k FROM files UNION SELECT {canon_sql('page_url')} FROM raw_pages UNION SELECT {canon_sql('url')} FROM assets),
leaves AS (SELECT DISTINCT '/' || ltrim({canon_sql('site')}, '/') || '/' || regexp_replace({canon_sql('leaf')}, '\\.aspx$', '') AS k FROM raw_pages),
linked AS (SELECT DISTINCT {canon_sql('canonical_key')} AS k FROM links WHERE canonical_key <> ''),
targets AS (
  SELECT {canon_sql('canonical_key')} AS ref_key, strftime(j.started_at, '%Y-%m') AS period, count(*) AS n_refs
  FROM links l LEFT JOIN (SELECT DISTINCT job_id, started_at FROM jobs) j USING (job_id) WHERE canonical_key <> '' GROUP BY 1, 2),
urls AS (SELECT {canon_sql('url')} AS ref_key, strftime(modified, '%Y-%m') AS period, count(*) AS n_refs FROM assets WHERE url <> '' GROUP BY 1, 2),
folders AS (
  SELECT *, regexp_extract(ref_key, '^(/[^/]+/[^/]+)/siteassets/sitepages/([^/]+)/.', 1) AS site,
    regexp_extract(ref_key, '^(/[^/]+/[^/]+)/siteassets/sitepages/([^/]+)/.', 2) AS folder FROM urls),
orphans AS (
  SELECT 'link-target' AS kind, ref_key, period, n_refs FROM targets WHERE starts_with(ref_key, '/') AND ref_key NOT IN (SELECT k FROM parents)
  UNION ALL SELECT 'page-folder', ref_key, period, n_refs FROM folders
    WHERE folder <> '' AND NOT regexp_matches(folder, '{GUID}') AND site || '/' || folder NOT IN (SELECT k FROM leaves)
  UNION ALL SELECT 'orphan-file', ref_key, period, n_refs FROM urls WHERE ref_key NOT IN (SELECT k FROM linked))
"""
_KEYED = f"""
keyed AS (SELECT {canon_sql('canonical_key')} AS canonical_key, source_kind, source_url, lower(site) IN (SELECT lower(site_path) FROM visible_sites WHERE site_path IS NOT NULL) AS visible
  FROM links WHERE canonical_key <> ''),
sources AS (SELECT canonical_key, source_kind, source_url, count(*) AS n, bool_or(coalesce(visible, false)) AS visible FROM keyed GROUP BY ALL),
counts AS (SELECT canonical_key, CAST(sum(n) AS BIGINT) AS n_links, count(*) AS n_sources, count(*) FILTER (visible) AS visible_sources, count(*) FILTER (NOT visible) AS hidden_count
  FROM (SELECT canonical_key, source_kind, source_url, sum(n) AS n, bool_or(visible) AS visible FROM sources GROUP BY 1, 2, 3) WHERE canonical_key <> '' GROUP BY 1)
"""
SQL = {
    "p1_found": f"""WITH {_SIGHTINGS}
SELECT DISTINCT file_ref, hash, epoch_us(seen_at) AS valid_from_us FROM (
  SELECT *, lag(hash) OVER (PARTITION BY file_ref ORDER BY seen_at, origin, place, hash) AS before FROM usable)
WHERE before IS DISTINCT FROM hash""",
    "p2_found": f"WITH {_PARENTS} SELECT DISTINCT kind, ref_key, period FROM orphans",
    "p2_report": f"WITH {_PARENTS} SELECT kind, period, count(*) AS n_keys, CAST(sum(n_refs) AS BIGINT) AS n_refs FROM orphans GROUP BY 1, 2",
    "p6_found": f"WITH {_KEYED} SELECT canonical_key FROM counts WHERE n_links * 100 >= (SELECT count(*) FROM keyed)",
    "p6_key_counts": f"WITH {_KEYED} SELECT * FROM counts",
}
