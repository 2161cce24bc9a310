"""Queries without SQL against row-by-row Python: p3_values, p3_sources, p5_classes."""

import math
import random
from collections import defaultdict

import pytest

import __spark_entry__
from linkloom.llm import truth
from tests.test_history import INDEX


def dense_em(claims, tolerance):
    """claims: (group, value, source), each once; every source of a group denies what it does not assert."""
    values, sources = defaultdict(set), defaultdict(set)
    for g, v, s in claims:
        values[g].add(v)
        sources[g].add(s)
    made = set(claims)
    values = {g: v for g, v in values.items() if sum(c[0] == g for c in claims) < len(v) * len(sources[g])}
    quality, moved = {s: truth.START for g, _, s in claims if g in values}, 1.0
    while moved > tolerance:
        p, old = {}, dict(quality)
        for g in values:
            for v in values[g]:
                odds = math.log(truth.PRIOR / (1 - truth.PRIOR))
                for s in sources[g]:
                    a, b = quality[s]
                    odds += math.log(a) - math.log(1 - b) if (g, v, s) in made else math.log(1 - a) - math.log(b)
                p[g, v] = 1 / (1 + math.exp(-odds))
        for s in quality:
            cells = [(p[g, v], (g, v, s) in made) for g in values if s in sources[g] for v in values[g]]
            hits, true = sum(x for x, m in cells if m), sum(x for x, _ in cells)
            wrong, false = sum(1 - x for x, m in cells if m), sum(1 - x for x, _ in cells)
            (a, b), (c, d) = truth.SENSITIVITY_PRIOR, truth.FALSE_POSITIVE_PRIOR
            quality[s] = ((hits + a) / (true + a + b), 1 - (wrong + c) / (false + c + d))
        moved = max(abs(x - y) for s in quality for x, y in zip(quality[s], old[s]))
    return p, quality


def test_p3_values_and_sources(spark):
    r = random.Random(2)
    made = sorted({(f"g{r.randrange(6)}", f"v{r.randrange(3)}", f"s{r.randrange(5)}") for _ in range(60)})
    df = spark.createDataFrame([(g, "f", "", v, s) for g, v, s in made], "g string, field string, scope string, value string, source string")
    values, sources = truth.infer(df, ["g"], 0.01)
    p, quality = dense_em(made, 0.01)
    got = {(x["g"], x["value"]): x["probability"] for x in values.collect()}
    assert set(got) == {(g, v) for g, v, _ in made} and {k: got[k] for k in p} == pytest.approx(p)
    got = {x["source"]: (x["sensitivity"], x["specificity"]) for x in sources.collect()}
    assert set(got) == set(quality) and all(got[s] == pytest.approx(quality[s]) for s in got)
    with pytest.raises(RuntimeError):
        truth.infer(df, ["g"], 0.0, 2)


def test_p3_planted_truth(spark):
    """Values and qualities come back from claims made at random with known qualities."""
    r = random.Random(4)
    skill = {f"s{i}": (0.95, 0.97) if i < 8 else (0.55, 0.7) for i in range(12)}
    rows, true = [], set()
    for g in range(150):
        mine = r.sample(sorted(skill), 8)
        for v in range(4):
            is_true = v < 2
            if is_true:
                true.add((f"g{g}", f"v{v}"))
            for s in mine:
                sens, spec = skill[s]
                if r.random() < (sens if is_true else 1 - spec):
                    rows.append((f"g{g}", "tags", "", f"v{v}", s))
    df = spark.createDataFrame(rows, "g string, field string, scope string, value string, source string")
    values, sources = truth.infer(df, ["g"])
    kept = {(x["g"], x["value"]) for x in values.filter("probability >= 0.5").collect()}
    assert len(kept & true) >= 0.97 * len(true) and len(kept & true) >= 0.97 * len(kept)
    # False values that no source asserts are not seen, so specificity comes out too low, most for poor sources.
    for x in sources.collect():
        sens, spec = skill[x["source"]]
        assert abs(x["sensitivity"] - sens) < 0.1 and spec - 0.2 < x["specificity"] < spec + 0.05


def test_p3_copies_do_not_deny_each_other(spark):
    """Every copy's own value of a multi-valued field is retained; a single-valued field keeps one."""
    rows = [(f"k{g}", f"/s{i}/f{g}", f"/s{i}", f"/s{i}", "red" if i else "blue") for g in range(10) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, m string, source string, place string, colour string")
    from pyspark.sql import functions as F

    out = truth.survivors(df, ["k"], "m", [F.lit(0)], "source", ["colour"], ["place"])
    got = out.representatives.collect()
    assert len(got) == 10 and all(x["n_place"] == 4 and x["colour"] == "red" and x["m"].startswith("/s0") for x in got)
    # Many sources that nobody denies keep all they assert, however many they are.
    rows = [(f"k{i // 2}", f"/s{i % 7}/f{i}", f"/s{i % 7}", None, None) for i in range(3000)]
    out = truth.survivors(spark.createDataFrame(rows, df.schema), ["k"], "m", [F.lit(0)], "source", ["colour"], ["place"])
    assert out.representatives.count() == 1500
    assert truth.survivors(df.limit(0), ["k"], "m", [F.lit(0)], "source", ["colour"], ["place"]).representatives.count() == 0


def test_p5_classes(spark, tmp_path):
    prints = {"/a": 0, "/b": 1, "/c": 3 + 4 + 8, "/d": 1 << 40, "/e": (1 << 40) + 7, "/f": -1, "/g": 255 << 20}
    row = lambda f, x: (f, f"h{f}", None, f, 1, None, None, None, None, None, None, "t", x, None)
    spark.createDataFrame([row(f, x) for f, x in prints.items()], INDEX).write.parquet(f"{tmp_path}/hash_index.parquet")
    near = [(a, b) for a in prints for b in prints if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 3]
    classes = {}
    for f in sorted(prints):
        reach, todo = {f}, [f]
        while todo:
            x = todo.pop()
            new = {b if a == x else a for a, b in near if x in (a, b)} - reach
            reach |= new
            todo += new
        if len(reach) > 1:
            classes[f] = (min(reach), sum(f in p for p in near))
    got = {x["file_ref"]: (x["class_id"], x["n_links"]) for x in __spark_entry__.queries()["p5_classes"](spark, str(tmp_path)).collect()}
    assert got == classes and len(got) == 5


def test_a_broken_module_fails(monkeypatch):
    """An import that fails must not drop queries."""
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "linkloom.llm.pivots", None)
    monkeypatch.delitem(sys.modules, "linkloom.llm.queries")
    monkeypatch.delattr("linkloom.llm.queries", raising=False)
    monkeypatch.delattr("linkloom.llm.pivots", raising=False)
    with pytest.raises(ImportError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
