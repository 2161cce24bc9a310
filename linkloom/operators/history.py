"""History of changing entity attributes: per-attribute change logs and their combination.

Sightings of entities are events. ``attribute_log`` turns them into one change log per attribute, each
with its own intervals. ``combine`` splits the intervals of all attributes at the union of their boundary
instants and coalesces neighbouring segments of equal state.

Skew: no window spans a whole entity. Rows are windowed by (entity, attribute, chunk of time); what crosses
a chunk's edge is one summary row per chunk, so an entity holding a third of all sightings is
spread over as many tasks as it has chunks. Only chunk summaries meet in one window per entity, and their
number is bounded by the time span.

Defined cases: rows without entity or instant are no sightings; a null or blank value is no sighting of
that attribute (the last known value stays valid), unless the attribute is of another one (``parts``) and a new run of that
one starts without it, which ends its version; equal rows and repeated deliveries join the run they
repeat; states of one instant follow each other by ``order``, giving versions of no length, which the log keeps
and ``combine`` leaves out; an empty input gives an empty result; columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.keys import blank_to_null

DAY_S = 86_400
#: Stands for a value that has ended while runs are found.
ENDED = "\0"


def _chunk(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def unbroken_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk_s: int = DAY_S) -> DataFrame:
    """The first row of each unbroken run of one ``value`` within ``keys``, in the order of ``order``.

    The first of ``order`` is the instant. Adds ``next_at``: the instant of the next run, null for the last.
    Keys, instant and value must not be null.
    """
    keys, at = list(keys), order[0]
    chunked = df.withColumn("_chunk", _chunk(at, chunk_s))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    kept = (
        chunked.withColumn("_before", F.lag(value).over(inside))
        .withColumn("_head", F.row_number().over(inside) == 1)
        .filter(F.col("_head") | ~F.col(value).eqNullSafe(F.col("_before")))
        .withColumn("_next", F.lead(at).over(inside))
        .drop("_before")
    )
    head, position = F.col("_head"), F.struct(*order)
    summary = kept.groupBy(*keys, "_chunk").agg(
        F.max(F.when(head, F.col(value))).alias("_first"),
        F.max(F.when(head, F.col(at))).alias("_first_at"),
        F.min(F.when(~head, F.col(at))).alias("_second_at"),
        F.max_by(value, position).alias("_last"),
    )
    chunks = W.partitionBy(*keys).orderBy("_chunk")
    back = W.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(W.unboundedPreceding, -1)
    edges = (
        summary.withColumn("_carry", F.lag("_last").over(chunks))
        .withColumn("_change", F.when(F.col("_first").eqNullSafe(F.col("_carry")), F.col("_second_at")).otherwise(F.col("_first_at")))
        .withColumn("_after", F.last("_change", ignorenulls=True).over(back))
        .select(*keys, "_chunk", "_carry", "_after")
    )
    return (
        kept.join(edges, [*keys, "_chunk"])
        .filter(~head | ~F.col(value).eqNullSafe(F.col("_carry")))
        .withColumn("next_at", F.coalesce("_next", "_after"))
        .drop("_chunk", "_head", "_next", "_carry", "_after")
    )


def carry_forward(df: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], chunk_s: int = DAY_S) -> DataFrame:
    """Fills nulls of ``columns`` with the last known value before them; one row per keys and instant."""
    keys, columns = list(keys), list(columns)
    chunked = df.withColumn("_chunk", _chunk(at, chunk_s))
    inside = W.partitionBy(*keys, "_chunk").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = chunked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    ends = filled.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*columns), F.col(at)).alias("_end"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", *(F.last(F.col("_end")[c], ignorenulls=True).over(before).alias(f"_c_{c}") for c in columns))
    joined = filled.join(carried, [*keys, "_chunk"])
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in columns}).drop("_chunk", *(f"_c_{c}" for c in columns))


def attribute_log(events: DataFrame, entity: str, order: Sequence[str], attributes: Sequence[str], chunk_s: int = DAY_S, parts: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(entity, attribute, value, valid_from, valid_to, order...): one row per version of each attribute.

    ``parts`` names the attributes that belong to a value of another one, which must be known in every event: a
    run of the other that starts without them has none until they are seen. That is a row with a null value.

    ``order`` starts with the instant; what follows breaks ties, the value itself last. valid_to is null
    while the version is valid. Values are strings.
    """
    at, *ties = order
    tie_names = [f"_t{i}" for i in range(len(ties))]
    base = events.filter(F.col(entity).isNotNull() & (F.col(entity) != "") & F.col(at).isNotNull())
    named = [F.struct(F.lit(a).alias("attribute"), blank_to_null(F.col(a).cast("string")).alias("value")) for a in attributes]
    long = base.select(
        F.col(entity).alias("_entity"), F.col(at).alias("_at"), *(F.col(t).alias(n) for t, n in zip(ties, tie_names)), F.explode(F.array(*named)).alias("_a")
    ).select("_entity", "_at", *tie_names, F.col("_a.attribute").alias("_attribute"), F.col("_a.value").alias("_value"))
    long = long.filter(F.col("_value").isNotNull())
    for whole, of in (parts or {}).items():
        void = [(blank_to_null(F.col(a).cast("string")).isNull()).alias(f"_void{i}") for i, a in enumerate(of)]
        rows = base.select(F.col(entity).alias("_entity"), F.col(at).alias("_at"), *(F.col(t).alias(n) for t, n in zip(ties, tie_names)), blank_to_null(F.col(whole).cast("string")).alias("_whole"), *void)
        starts = unbroken_runs(rows.filter("_whole is not null"), ["_entity"], ["_at", *tie_names, "_whole", *(f"_void{i}" for i in range(len(of)))], "_whole", chunk_s)
        ended = F.array_compact(F.array(*(F.when(F.col(f"_void{i}"), F.lit(a)) for i, a in enumerate(of))))
        long = long.unionByName(starts.select("_entity", "_at", *tie_names, F.explode(ended).alias("_attribute"), F.lit(ENDED).alias("_value")))
    runs = unbroken_runs(long, ["_entity", "_attribute"], ["_at", *tie_names, "_value"], "_value", chunk_s)
    return runs.select(
        F.col("_entity").alias(entity),
        F.col("_attribute").alias("attribute"),
        F.nullif("_value", F.lit(ENDED)).alias("value"),
        F.col("_at").alias("valid_from"),
        F.col("next_at").alias("valid_to"),
        *(F.col(n) for n in tie_names),
    )


def combine(log: DataFrame, entity: str, attributes: Sequence[str], chunk_s: int = DAY_S) -> DataFrame:
    """(entity, attributes..., valid_from, valid_to): the whole state between neighbouring boundaries.

    Boundaries are the union of all attributes' instants; the state of an instant is the last of it; equal
    neighbours are one segment.
    """
    ties = [c for c in log.columns if c.startswith("_t")]
    position = F.struct(*ties, "value") if ties else F.col("value")
    split = log.groupBy(entity, "valid_from").agg(
        *(F.max_by(F.coalesce("value", F.lit(ENDED)), F.when(F.col("attribute") == a, position)).alias(f"_v{i}") for i, a in enumerate(attributes))
    )
    names = [f"_v{i}" for i in range(len(attributes))]
    full = carry_forward(split, [entity], "valid_from", names, chunk_s)
    full = full.withColumn("_state", F.struct(*(F.nullif(n, F.lit(ENDED)).alias(n) for n in names)))
    runs = unbroken_runs(full, [entity], ["valid_from"], "_state", chunk_s)
    return runs.select(entity, *(F.col(f"_state.{n}").alias(a) for n, a in zip(names, attributes)), "valid_from", F.col("next_at").alias("valid_to"))
