"""Queries of the training-data problems (p3, p4, p5, p7, p8, p9) over the engine's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.keys import blank_to_null, clean_hash, effective_algo
from linkloom.llm import components, leaks, packing, pivots, prefixes, quality, truth, versions
from linkloom.session import fresh_path, materialize
from linkloom.sources.tables import table

# ---- p3

GROUP = ["algo", "hash"]


def _records(spark: SparkSession, root: str) -> DataFrame:
    index = table(spark, root, "hash_index")
    previous = F.coalesce(F.size("previous"), F.lit(0))
    previous = F.greatest(previous, F.lit(0))
    site = F.coalesce(blank_to_null("site_path"), F.regexp_extract("file_ref", r"^(/[^/]+/[^/]+)", 1))
    return index.select(
        effective_algo("algo").alias("algo"),
        clean_hash("current_hash").alias("hash"),
        "file_ref",
        "last_confirmed_at",
        previous.alias("n_previous"),
        F.lower(site).alias("source"),
        *(blank_to_null(F.col(c).cast("string")).alias(c) for c in ("file_name", "size", "text_hash", "simhash64", "library", "site_path", "etag")),
        F.transform("previous", lambda p: F.lower(p["hash"])).alias("previous_hashes"),
        blank_to_null("last_confirmed_by").alias("last_confirmed_by"),
        "current_hash_observed_at",
    ).withColumn("simhash64", F.when(F.col("text_hash").isNotNull(), F.col("simhash64")))


def _newest_first() -> list[Column]:
    return [F.coalesce(-F.unix_micros(F.col("last_confirmed_at").cast("timestamp")), F.lit((1 << 63) - 1)), -F.col("n_previous")]


def _survivors(spark: SparkSession, root: str) -> truth.Survivors:
    return truth.survivors(
        _records(spark, root), GROUP, "file_ref", _newest_first(), "source",
        single=["file_name", "size", "text_hash", "simhash64", "library"], multi=["site_path", "etag", "previous_hashes"],
        carry=["last_confirmed_at", "last_confirmed_by"], earliest=["current_hash_observed_at"],
    )


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The representative of each group of equal contents, the one of p3_survivors; no source quality has a say in it, so none is fitted."""
    records = truth.named(_records(spark, root), GROUP, "file_ref")
    return truth.groups(records, GROUP, "file_ref", _newest_first()).select(*GROUP, "file_ref")


def p3_survivors(spark: SparkSession, root: str) -> DataFrame:
    """The representatives with the best value of every field of hash_index.

    site_path and etag are arrays of the retained values; previous are all distinct entries of the group whose hash is
    retained, oldest first; confirmation is that of the representative, and so is current_hash_observed_at where it has one.
    """
    keys = GROUP
    chosen = materialize(_survivors(spark, root).representatives, "survivors")
    index = table(spark, root, "hash_index").filter(blank_to_null("file_ref").isNotNull())
    each = index.select(effective_algo("algo").alias("algo"), clean_hash("current_hash").alias("hash"), F.explode("previous").alias("p"))
    entry = F.struct(
        F.col("p.observed_at").alias("observed_at"),
        clean_hash("p.hash").alias("hash"),
        effective_algo("p.algo").alias("algo"),
        blank_to_null("p.observed_by").alias("observed_by"),
        blank_to_null("p.text_hash").alias("text_hash"),
        versions.text_simhash("p.text_hash", "p.simhash64").alias("simhash64"),
    )
    retained = chosen.select(*keys, F.explode("previous_hashes").alias("_p"))
    entries = each.select(*keys, clean_hash("p.hash").alias("_p"), entry.alias("e")).distinct().join(retained, [*keys, "_p"], "left_semi")
    previous = entries.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("previous"))
    none = F.array().cast(previous.schema["previous"].dataType)
    return chosen.join(previous, keys, "left").withColumn("previous", F.coalesce("previous", none))


def p3_values(spark: SparkSession, root: str) -> DataFrame:
    """Every claimed value of every group and field with its probability, and whether it is retained."""
    return _survivors(spark, root).values


def p3_sources(spark: SparkSession, root: str) -> DataFrame:
    """Sensitivity and specificity of each source for each field."""
    return _survivors(spark, root).sources


# ---- p4


def _arrivals(spark: SparkSession, root: str) -> DataFrame:
    seen = table(spark, root, "observations").filter(blank_to_null("file_ref").isNotNull())
    rows = seen.select("file_ref", versions.content("algo", "hash").alias("content"), versions.text_simhash("text_hash", "simhash64").alias("simhash"), "ordinal", "job_id")
    return rows.filter("content is not null and ordinal is not null")


def _history(spark: SparkSession, root: str) -> pivots.History:
    """A new history that holds the index."""
    index = versions.index_versions(table(spark, root, "hash_index"))
    history = pivots.History(spark, fresh_path(spark, "history"))
    history.append("index", pivots.before_all(index))
    return history


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows that bring content, or nearly the content, another file already has: all arrivals as one batch on the written index."""
    history = _history(spark, root)
    history.append("arrivals", _arrivals(spark, root))
    return history.classify("arrivals")


def p4_batches(spark: SparkSession, root: str) -> DataFrame:
    """The same job by job, each batch appended to the written history and compared with it.

    A batch is what arrives from the first row of a job to the first row of the next one; late rows of a job are in the
    batch with which they arrive.
    """
    history = _history(spark, root)
    arrivals = materialize(_arrivals(spark, root), "arrivals")
    starts = sorted(r[0] for r in arrivals.groupBy("job_id").agg(F.min("ordinal")).select("min(ordinal)").collect())
    out = None
    for k, low in enumerate(starts):
        batch = arrivals.filter(F.col("ordinal") >= low)
        if k + 1 < len(starts):
            batch = batch.filter(F.col("ordinal") < starts[k + 1])
        history.append(f"b{k:06d}", batch)
        found = materialize(history.classify(f"b{k:06d}", pivots.SENT_QUERIES), "found")
        out = found if out is None else out.unionByName(found)
    return history.classify("index") if out is None else out


# ---- p5


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of files with near versions of different content."""
    return prefixes.near_files(versions.index_versions(table(spark, root, "hash_index")))


def p5_classes(spark: SparkSession, root: str) -> DataFrame:
    """(file_ref, class_id, n_links): the files that belong together by p5_found."""
    pairs = materialize(p5_found(spark, root), "pairs")
    links = pairs.select(F.col("file_ref_a").alias("node")).unionByName(pairs.select(F.col("file_ref_b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    return components.components(pairs, "file_ref_a", "file_ref_b").join(links, "node").select(F.col("node").alias("file_ref"), "class_id", "n_links")


# ---- p7


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """Every document with the container of 2,048 tokens and the place of each of its parts."""
    return packing.containers(table(spark, root, "documents"))


# ---- p8


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Every document with the evaluation items of which it holds 13 consecutive words."""
    return leaks.find(table(spark, root, "eval_items"), table(spark, root, "documents"))


# ---- p9


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """The documents in a tail of their language's statistics that are for the most part not prose, with their shape."""
    measured = materialize(quality.measured(table(spark, root, "documents")), "measured")
    return quality.flagged(measured).filter("shape != 'prose'").select("doc_id", "shape")


def p9_flags(spark: SparkSession, root: str) -> DataFrame:
    """Every document in a tail of its language, with the statistics that lie there."""
    measured = materialize(quality.measured(table(spark, root, "documents")), "measured")
    return quality.flagged(measured).select("doc_id", "lang", "shape", "tails")


def p9_statistics(spark: SparkSession, root: str) -> DataFrame:
    """The statistics, the share of each shape and the shape of every document."""
    return quality.measured(table(spark, root, "documents"))


def p9_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every statistic of every document with its percentile and robust z-score in the document's language."""
    return quality.scored(materialize(quality.measured(table(spark, root, "documents")).select("doc_id", "lang", *quality.STATISTICS), "measured"))


QUERIES = {f.__name__: f for f in (p3_found, p3_survivors, p3_values, p3_sources, p4_found, p4_batches, p5_found, p5_classes, p7_containers, p8_found, p9_found, p9_flags, p9_statistics, p9_scores)}

_VERSIONS = """
versions AS (
  SELECT file_ref, coalesce(nullif(algo, ''), 'full-sha256') || ':' || lower(current_hash) AS content, CASE WHEN text_hash <> '' THEN simhash64 END AS simhash
  FROM hash_index WHERE file_ref <> '' AND current_hash <> ''
  UNION SELECT file_ref, coalesce(nullif(p.algo, ''), 'full-sha256') || ':' || lower(p.hash), CASE WHEN p.text_hash <> '' THEN p.simhash64 END
  FROM (SELECT file_ref, unnest(previous) AS p FROM hash_index) WHERE file_ref <> '' AND p.hash <> '')
"""
_ARRIVALS = """
arrivals AS (
  SELECT ordinal, file_ref, coalesce(nullif(algo, ''), 'full-sha256') || ':' || lower(hash) AS content, CASE WHEN text_hash <> '' THEN simhash64 END AS simhash
  FROM observations WHERE file_ref <> '' AND hash <> '' AND ordinal IS NOT NULL),
known AS (SELECT file_ref, content, simhash, -1 AS o FROM versions UNION SELECT file_ref, content, simhash, ordinal FROM arrivals),
first_of AS (SELECT file_ref, content, min(o) AS o FROM known GROUP BY 1, 2),
looked AS (SELECT f.o, f.file_ref, f.content, a.simhash FROM first_of f JOIN (SELECT DISTINCT * FROM arrivals) a ON a.ordinal = f.o AND a.file_ref = f.file_ref AND a.content = f.content),
labelled AS (SELECT l.*, EXISTS (SELECT 1 FROM known k WHERE k.content = l.content AND k.file_ref <> l.file_ref AND k.o < l.o) AS same FROM looked l),
prints AS (SELECT simhash, file_ref, min(o) AS o FROM known WHERE simhash IS NOT NULL GROUP BY 1, 2)
"""
SQL = {
    "p3_found": """WITH r AS (
  SELECT coalesce(nullif(algo, ''), 'full-sha256') AS algo, lower(current_hash) AS hash, file_ref,
    row_number() OVER (PARTITION BY coalesce(nullif(algo, ''), 'full-sha256'), lower(current_hash)
      ORDER BY last_confirmed_at DESC NULLS LAST, coalesce(len(previous), 0) DESC, file_ref) AS place
  FROM hash_index WHERE file_ref <> '' AND current_hash <> ''),
g AS (SELECT algo, hash FROM r GROUP BY 1, 2 HAVING count(DISTINCT file_ref) >= 2)
SELECT algo, hash, file_ref FROM r JOIN g USING (algo, hash) WHERE place = 1""",
    "p4_found": f"""WITH {_VERSIONS}, {_ARRIVALS}
SELECT o AS ordinal, 'same' AS relation FROM labelled WHERE same
UNION ALL SELECT DISTINCT q.o, 'near' FROM labelled q JOIN prints h ON h.file_ref <> q.file_ref AND h.o < q.o AND bit_count(xor(q.simhash, h.simhash)) <= 3
WHERE NOT q.same AND q.simhash IS NOT NULL""",
    "p5_found": f"""WITH {_VERSIONS}, t AS (SELECT DISTINCT * FROM versions WHERE simhash IS NOT NULL)
SELECT DISTINCT least(a.file_ref, b.file_ref) AS file_ref_a, greatest(a.file_ref, b.file_ref) AS file_ref_b
FROM t a JOIN t b ON a.content < b.content AND a.file_ref <> b.file_ref AND bit_count(xor(a.simhash, b.simhash)) <= 3""",
}
SQL["p4_batches"] = SQL["p4_found"]
