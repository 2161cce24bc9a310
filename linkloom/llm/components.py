"""Connected components by alternating large-star and small-star rounds.

Edges stay edges from round to round; nothing is collected but one count and one hash sum a round. Each round is
written to the shared folder, which cuts the lineage. Hot nodes: a star round needs the smallest neighbour of a node
only, a minimum that is aggregated before the shuffle and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import materialize


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
    low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    root = low.groupBy("u").agg(F.min("v").alias("m"))
    small = low.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return small.unionByName(root.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(node, class_id): class_id is the smallest node of the component; nodes without pairs do not occur."""
    edges = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        edges = materialize(_round(edges), "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1_000_003)).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    root = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class_id")).unionByName(root.withColumn("class_id", F.col("node")))
