"""p9: shapes of texts, statistics, and percentiles from sketches against sorting."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from linkloom.llm import quality

SENTENCE = "The office asked whether the form could be sorted before the end of the week."
TEXTS = {
    "prose": [SENTENCE * 3, f"# Title\n- one\n- two\n{SENTENCE}\n{SENTENCE}", SENTENCE.lower().replace(" ", "&nbsp;"), f"<p>{SENTENCE}</p><p>{SENTENCE}</p>", "Die Ordner sind noch da, und wir haben\nsie nach der Prüfung nicht mehr\ngezählt."],
    "list": ["- form\n- old page\n- links", f"{SENTENCE}\n" + "\n".join(f"{i}. report draft number" for i in range(20)), "<ul><li>red paint</li><li>blue paint</li></ul>", "Roster: plan\nFiles: broken\nPage: old form"],
    "table": ["a\tb\tc\n1\t2\t3\n4\t5\t6\n7\t8\t9", "| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |", "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", "a;b;c\n1;2;x\n3;4;y\n5;6;z"],
    "junk": [None, "", " \n", "?", "-----\n=====\n*****", '{"id":1,"zone":[],"x":null}', "files " * 60, "{83b2466c-ce7c-6253-e041-64c0b8cca3ec}\n{7b1d55fb-3d74-2d05-e406-7b4af8ee74f4}", "hrtzplk drwzpq ejtdshk wkdhllgk zpqrstk lghkdp"],
}


@pytest.mark.parametrize("shape", TEXTS)
def test_shapes(shape):
    assert [quality.measure(t)[3] for t in TEXTS[shape]] == [shape] * len(TEXTS[shape])


def test_statistics():
    lang, values, _, _ = quality.measure("The cat is old.\nred paint", "EN-gb")
    assert lang == "en" and values == pytest.approx([6, 19 / 6, 1 / 20, 0.5, 2 / 6])
    assert quality.measure("Die Ordner sind da", "und")[0] == "de" and quality.measure("", None)[0] == "und"


def test_p9_found_and_scores(spark, tmp_path):
    rows = [(i, t, s) for i, (s, t) in enumerate((s, t) for s, ts in TEXTS.items() for t in ts)]
    spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    q = __spark_entry__.queries()
    out = q["p9_found"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "shape"]
    assert sorted(tuple(r) for r in out.collect()) == [(i, s) for i, _, s in rows if s != "prose"]
    assert q["p9_scores"](spark, str(tmp_path)).count() == len(rows) * len(quality.STATISTICS)


def test_scores_equal_sorting(spark):
    r = random.Random(3)
    docs = [(i, r.choice(["en", "de"]), *(0.0 if r.random() < 0.2 else round(r.lognormvariate(0, 2), 3) for _ in quality.STATISTICS)) for i in range(300)]
    got = quality.scored(spark.createDataFrame(docs, ["doc_id", "lang", *quality.STATISTICS])).collect()
    for k, s in enumerate(quality.STATISTICS):
        for lang in ("en", "de"):
            values = {d[0]: d[2 + k] for d in docs if d[1] == lang}
            mid = sorted(values.values())[(len(values) + 1) // 2 - 1]
            mad = median(abs(v - mid) for v in values.values())
            for row in (x for x in got if x["statistic"] == s and x["lang"] == lang):
                v = values[row["doc_id"]]
                share = lambda f: sum(f(x) for x in values.values()) / len(values)
                assert share(lambda x: x < v * 0.98) - 1e-9 <= row["percentile"] <= share(lambda x: x <= v * 1.02) + 1e-9
                assert row["robust_z"] == pytest.approx(0.6745 * (v - mid) / mad, rel=0.05, abs=0.05)


def test_sketches_merge(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") * F.col("id") / 7).alias("value"), (F.col("id") % 3).alias("part"))
    parts = [quality.sketch(df.filter(F.col("part") == i), ["k"]) for i in range(3)]
    merged = quality.merge(quality.merge(parts[2], parts[0], ["k"]), parts[1], ["k"])
    whole = quality.sketch(df, ["k"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    assert quality.quantile(merged, ["k"], 0.9, "q").first()["q"] == pytest.approx(899 * 899 / 7, rel=0.011)


def test_found_comes_from_the_tails_and_loses_nothing(spark):
    """Flagging by sketches keeps every text that is not prose, whatever their part in a language."""
    r = random.Random(5)
    for part in (0.05, 0.3, 0.48, 0.7):
        rows = []
        for i in range(400):
            prose = r.random() >= part
            share = r.choice([1.0, 1.0, r.uniform(0.5, 1)]) if prose else r.choice([0.0, 0.0, r.uniform(0, 0.499)])
            rows.append((i, r.choice(["en", "de"]), *(r.random() for _ in quality.STATISTICS), share, "prose" if prose else "list"))
        df = spark.createDataFrame(rows, ["doc_id", "lang", *quality.STATISTICS, "share_prose", "shape"])
        got = {x["doc_id"] for x in quality.flagged(df).collect()}
        assert {x[0] for x in rows if x[-1] != "prose"} <= got
        assert part > 0.3 or len(got) < len(rows)
    assert quality.flagged(df.limit(0)).count() == 0
