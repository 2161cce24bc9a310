"""p4: the written history, its batches, retries and pruning."""

import random

from pyspark.sql import functions as F

from linkloom.llm import pivots

ROW = "file_ref string, content string, simhash bigint, ordinal bigint"


def _rows(r, n, start=0):
    base = [r.getrandbits(63) for _ in range(12)]
    out = []
    for o in range(start, start + n):
        x = r.choice(base)
        for _ in range(r.randrange(5)):
            x ^= 1 << r.randrange(63)
        out.append((f"/f{r.randrange(25)}", f"c{x}", x if r.random() < 0.9 else None, o))
    return out


def brute(rows):
    """(ordinal, relation) of all rows in order, by comparing each with all before it."""
    out, seen = set(), []
    for f, c, x, o in rows:
        if o >= 0 and not any(g == f and d == c for g, d, _ in seen):
            if any(d == c for _, d, _ in seen):
                out.add((o, "same"))
            elif x is not None and any(g != f and y is not None and (x ^ y).bit_count() <= 3 for g, _, y in seen):
                out.add((o, "near"))
        seen.append((f, c, x))
    return out


def test_batches_equal_brute_force(spark, tmp_path):
    r = random.Random(7)
    index, rows = [(*x[:3], -1) for x in _rows(r, 40)], _rows(r, 200)
    want = brute(index + rows)
    assert {k for _, k in want} == {"same", "near"}
    for buckets, cuts in ((1, [0, 200]), (4, [0, 1, 60, 61, 150, 200])):
        h = pivots.History(spark, f"{tmp_path}/h{buckets}", buckets)
        h.append("index", spark.createDataFrame(index, ROW))
        got = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            batch = spark.createDataFrame(rows[a:b], ROW)
            h.append(f"b{k}", batch)
            h.append(f"b{k}", batch)  # a retry adds nothing
            got += [tuple(x) for x in h.classify(f"b{k}").collect()]
        assert sorted(got) == sorted(want)
        assert len(h.committed()) == len(cuts)


def test_uncommitted_batch_does_not_count(spark, tmp_path):
    h = pivots.History(spark, f"{tmp_path}/h")
    h.append("index", spark.createDataFrame([("/a", "c1", 5, -1)], ROW))
    broken = pivots.hashed(spark.createDataFrame([("/z", "c2", 7, 0)], ROW))
    broken.withColumn("_cb", F.lit(0)).write.partitionBy("_cb").parquet(f"{tmp_path}/h/contents/batch=broken")
    h.append("b", spark.createDataFrame([("/b", "c2", 255 << 40, 1), ("/b", "c1", 5, 2)], ROW))
    assert [tuple(x) for x in h.classify("b").collect()] == [(2, "same")]


def test_empty(spark, tmp_path):
    h = pivots.History(spark, f"{tmp_path}/h")
    h.append("index", spark.createDataFrame([], ROW))
    h.append("b", spark.createDataFrame([], ROW))
    assert h.classify("b").count() == 0


def test_a_batch_reads_only_what_it_touches(spark, tmp_path):
    """Files read for one row stay as many while history and buckets grow tenfold."""
    read = []
    for n, buckets in ((300, 8), (3000, 80)):
        r = random.Random(n)
        rows = [(f"/f{i}", f"c{i}", r.getrandbits(63), -1) for i in range(n)]
        h = pivots.History(spark, f"{tmp_path}/h{n}", buckets)
        h.append("index", spark.createDataFrame(rows, ROW))
        h.append("b", spark.createDataFrame([("/x", "c7", rows[3][2] ^ 1, 1)], ROW))
        queries = pivots.query_rows(h._read("contents", pivots.CONTENTS, ["b"]))
        read.append((h.contents_for("b").count(), h.table_for(queries).count()))
    assert read[1][0] <= 3 * read[0][0] and read[1][1] <= 3 * read[0][1]
