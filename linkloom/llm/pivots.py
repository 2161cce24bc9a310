"""New batches against all history: a written pivot-distance table over 64-bit fingerprints.

Every row of history stores its Hamming distances to fixed pivots. A distance restricted to a block of bits is itself a metric and
never more than the whole, so the triangle inequality prunes twice:

* Near fingerprints differ in at most RADIUS bits, hence at most RADIUS blocks; on the blocks left the two are
  equal and so is their distance to every pivot. Rows meet only under the distances of BLOCKS - RADIUS blocks to KEY_PIVOTS pivots, which
  are so many that they leave few other values of the blocks.
* On whole distances |d(q, p) - d(h, p)| <= d(q, h) <= RADIUS. Distances to the first pivot are cut into
  ranges, by which the table is partitioned, and a query visits the ranges its interval touches; the other PIVOTS prune before the true
  distance is taken.

The history is kept in a folder, by batch: ``contents`` (who held what when), ``holders`` (each fingerprint of the batch with the two
earliest files that hold it, which is enough to say whether another file held it before a given moment) and the ``table``, which has each
of these fingerprints under its keys, partitioned by range and bucket of the key. A batch is appended under its id and counts from when its commit
mark is there; appending it again replaces or skips it, so a retry adds nothing. ``classify`` reads the buckets and ranges that the batch
touches and no others. What counts as known before a row is decided by the ordinals, so a batch may be appended before it is
classified and late rows may come in any batch.

Packed block distances are many, so no join key grows hot: rows of a batch with the same fingerprint are one row of the table. Files and contents are
compared by hashes of 64 and 128 bits, which keeps what is moved small.

Defined cases: rows without file or content take no part; rows without text have no fingerprint and can be ``same``,
not ``near``; repeated rows (one ordinal) are one row; a file's own earlier versions are never its duplicates;
an empty history makes everything new; an empty batch gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import materialize

RADIUS = 3
BLOCKS = 5
KEY_PIVOTS = 12
PIVOTS = 6
RANGE = 8
#: Rows of history for each bucket of a written table, and rows up to which a batch may be sent to all tasks.
BUCKET_ROWS = 4_000_000
SENT_QUERIES = 20_000
CONTENTS = "f bigint, c1 bigint, c2 bigint, simhash bigint, o bigint, batch string, _cb int"
HOLDERS = "simhash bigint, o1 bigint, f1 bigint, o2 bigint, batch string"
TABLE = "simhash bigint, _key bigint, batch string, _range int, _kb int"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed pivots from a rule: the splitmix64 sequence of seed 0."""
    out, state, full = [], 0, (1 << 64) - 1
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & full
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        out.append(_signed(z ^ (z >> 31)))
    return out


def masks(blocks: int = BLOCKS) -> list[int]:
    """Disjoint masks that cover the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [_signed(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_distances(x: Column, blocks: int = BLOCKS) -> Column:
    """Per block the distances to the key pivots, four bits each in one word."""
    packed = []
    for m in masks(blocks):
        word = F.lit(0).cast("long")
        for p in pivots(KEY_PIVOTS):
            word = F.shiftleft(word, 4).bitwiseOR(F.bit_count(x.bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(m))).cast("long"))
        packed.append(word)
    return F.array(*packed)


def whole_distance(x: Column, i: int) -> Column:
    """The whole distance to pivot i."""
    return distance(x, F.lit(pivots(PIVOTS)[i]))


def block_keys(blocks: int = BLOCKS, radius: int = RADIUS) -> Column:
    """One key for each choice of blocks that may be the equal ones: (choice, their packed distances)."""
    keys = []
    for choice, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        keys.append(F.xxhash64(F.lit(choice), *(F.col("_b")[b] for b in chosen)))
    return F.array(*keys)


def table_rows(history: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(simhash, _range, _key): fingerprints under each of their keys and the range of their distance to the first pivot."""
    if blocks <= radius or -(-64 // blocks) > 15:
        raise ValueError("more blocks than the radius are needed, of at most 15 bits")
    rows = history.select("simhash", block_distances(F.col("simhash"), blocks).alias("_b"))
    return rows.select("simhash", F.floor(whole_distance(F.col("simhash"), 0) / RANGE).cast("int").alias("_range"), F.explode(block_keys(blocks, radius)).alias("_key"))


def query_rows(batch: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(o, f, simhash, _key, _range): batch rows under each key and each range that their distance interval touches."""
    rows = batch.select("o", "f", "simhash", block_distances(F.col("simhash"), blocks).alias("_b"))
    low, high = (F.floor((whole_distance(F.col("simhash"), 0) + F.lit(d)) / RANGE).cast("int") for d in (-radius, radius))
    keyed = rows.select("o", "f", "simhash", F.explode(block_keys(blocks, radius)).alias("_key"))
    return keyed.withColumn("_range", F.explode(F.sequence(low, high)))


def first_two_holders(seen: DataFrame) -> DataFrame:
    """(simhash, o1, f1, o2): when and by which file a fingerprint was first held, and when first by another file."""
    per_file = seen.groupBy("simhash", "f").agg(F.min("o").alias("o"))
    rank = F.row_number().over(W.partitionBy("simhash").orderBy("o", "f"))
    two = per_file.withColumn("_r", rank).filter("_r <= 2")
    return two.groupBy("simhash").agg(F.max(F.when(F.col("_r") == 1, F.col("o"))).alias("o1"), F.max(F.when(F.col("_r") == 1, F.col("f"))).alias("f1"), F.max(F.when(F.col("_r") == 2, F.col("o"))).alias("o2"))


def candidates(queries: DataFrame, rows: DataFrame, radius: int = RADIUS, send: bool = False) -> DataFrame:
    """(o, f, h): queries and the fingerprints of the table truly within radius.

    ``send`` sends the queries to all tasks, so that the table is not moved.
    """
    q, h = (F.broadcast(queries) if send else queries).alias("q"), rows.alias("h")
    x, y = F.col("q.simhash"), F.col("h.simhash")
    on = (F.col("q._key") == F.col("h._key")) & (F.col("q._range") == F.col("h._range"))
    for i in range(1, PIVOTS):
        on = on & (F.abs(whole_distance(x, i) - whole_distance(y, i)) <= radius)
    return h.join(q, on & (distance(x, y) <= radius)).select("q.o", "q.f", y.alias("h")).distinct()


def hashed(rows: DataFrame) -> DataFrame:
    """(f, c1, c2, simhash, o): file_ref, content and ordinal of rows as they are kept."""
    return rows.select(F.xxhash64("file_ref").alias("f"), F.xxhash64("content").alias("c1"), F.xxhash64(F.lit(1), "content").alias("c2"), "simhash", F.col("ordinal").alias("o"))


class History:
    """The written history of one folder. ``buckets``: parts of each table by hash of the key, fixed for the folder; about one for BUCKET_ROWS rows."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """The ids of the batches that count."""
        marks = self._at(f"{self.path}/commits")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(marks)) if self._fs.exists(marks) else []

    def _write(self, df: DataFrame, kind: str, batch: str, by: list[str]) -> None:
        # With one bucket the rows are written where they are; with more, each bucket is one task's.
        placed = df.repartition(*by) if by and self.buckets > 1 else df
        writer = placed.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{kind}/batch={batch}")

    def append(self, batch: str, rows: DataFrame) -> None:
        """Adds file_ref, content, simhash, ordinal (-1: before all) as one batch, unless it is there already."""
        if batch in self.committed():
            return
        self._write(hashed(rows).withColumn("_cb", F.pmod("c1", F.lit(self.buckets)).cast("int")), "contents", batch, ["_cb"])
        own = self._read("contents", CONTENTS, [batch])
        self._write(first_two_holders(own.filter("simhash is not null").select("simhash", "f", "o")), "holders", batch, [])
        prints = self._read("holders", HOLDERS, [batch]).select("simhash")
        self._write(table_rows(prints).withColumn("_kb", F.pmod("_key", F.lit(self.buckets)).cast("int")), "table", batch, ["_range", "_kb"])
        self._fs.create(self._at(f"{self.path}/commits/{batch}"), True).close()

    def _read(self, kind: str, schema: str, of: list[str] | None = None) -> DataFrame:
        names = self.committed() if of is None else of
        places = [f"{self.path}/{kind}/batch={b}" for b in names]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*places)

    def _touched(self, df: DataFrame, column: str) -> list[int]:
        """The distinct buckets or ranges, of which there are few whatever the rows."""
        return sorted(r[0] for r in df.select(column).distinct().collect())

    def contents_for(self, batch: str) -> DataFrame:
        """Contents of all batches in the buckets that a batch touches."""
        every = self._read("contents", CONTENTS)
        return every.filter(F.col("_cb").isin(self._touched(self._read("contents", CONTENTS, [batch]), "_cb"))) if self.buckets > 1 else every

    def table_for(self, queries: DataFrame) -> DataFrame:
        """The table of all batches in the ranges and buckets that queries touch."""
        rows = self._read("table", TABLE).filter(F.col("_range").isin(self._touched(queries, "_range")))
        return rows.filter(F.col("_kb").isin(self._touched(queries.select(F.pmod("_key", F.lit(self.buckets)).cast("int").alias("_kb")), "_kb"))) if self.buckets > 1 else rows

    def classify(self, batch: str, send_up_to: int = 0) -> DataFrame:
        """(ordinal, relation): the looked-at rows of an appended batch that bring content another file already has.

        Up to ``send_up_to`` rows are sent to all tasks, so that of a small batch on a long history only the batch is moved.
        """
        per_file = self.contents_for(batch).groupBy("f", "c1", "c2").agg(F.min(F.struct("o", "simhash", "batch")).alias("a")).select("f", "c1", "c2", "a.*")
        per_file = per_file.withColumn("_mine", (F.col("o") >= 0) & (F.col("batch") == batch)).drop("batch")
        first = per_file.groupBy("c1", "c2").agg(F.min(F.struct("o", "f", "simhash", "_mine")).alias("a")).select("a.*").filter("_mine")
        first = materialize(first.select("o", "f", "simhash"), "first")
        same = per_file.filter("_mine").select("o").join(first.select("o"), "o", "left_anti")
        asked = first.filter("simhash is not null")
        queries = query_rows(asked)
        found = candidates(queries, self.table_for(queries), send=bool(send_up_to) and asked.count() <= send_up_to)
        held = self._read("holders", HOLDERS)
        other = F.when(F.col("f") != F.col("f1"), F.col("o1")).otherwise(F.col("o2"))
        near = found.join(held, found["h"] == held["simhash"]).filter(other < F.col("o")).select("o").distinct()
        of = lambda df, relation: df.select(F.col("o").alias("ordinal"), F.lit(relation).alias("relation"))
        return of(same, "same").unionByName(of(near, "near"))


def before_all(index: DataFrame) -> DataFrame:
    """The accepted versions as rows of a batch, before every ordinal."""
    return index.select("file_ref", "content", "simhash", F.lit(-1).cast("long").alias("ordinal"))
