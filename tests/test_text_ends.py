"""p1_attribute_log and p1_history: the text of a content ends with it."""

import random

import pytest

import __spark_entry__
from tests.test_history import ATTRIBUTES, INDEX, SEEN, micros, sightings, tables


def brute(events):
    """(log, history) where text_hash and simhash64 are forgotten when another hash is seen."""
    state, log, by_instant = {}, {a: [] for a in ATTRIBUTES}, {}
    for at, _, _, values in events:
        if values["hash"] != state.get("hash"):
            state = {a: v for a, v in state.items() if a not in ("text_hash", "simhash64")}
        seen = {a: str(v) for a, v in values.items() if v not in (None, "")}
        if not values["text_hash"]:
            seen.pop("simhash64", None)
        state = state | seen
        for a in ATTRIBUTES:
            if (log[a][-1][0] if log[a] else None) != state.get(a):
                log[a].append((state.get(a), at))
        by_instant[at] = tuple(state.get(a) for a in ATTRIBUTES)
    ends = lambda x: [(v, at, x[i + 1][1] if i + 1 < len(x) else None) for i, (v, at) in enumerate(x)]
    runs = []
    for at in sorted(by_instant):
        if not runs or runs[-1][0] != by_instant[at]:
            runs.append((by_instant[at], at))
    return [(a, *x) for a in ATTRIBUTES for x in ends(log[a]) if x[0] is not None], [(*v, s, e) for v, s, e in ends(runs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_text_ends_with_its_content(spark, tmp_path, seed):
    r = random.Random(seed)
    index, seen = tables(spark, f"{tmp_path}/whole", seed)
    no_text = lambda row, k: row[:k] + (r.choice([None, ""]),) + row[k + 1 :] if r.random() < 0.4 else row
    index = [no_text(x, 11)[:13] + ([no_text(p, 4) for p in x[13]] if x[13] else None,) for x in index]
    seen = [no_text(x, 6) for x in seen]
    spark.createDataFrame(index, INDEX).write.parquet(f"{tmp_path}/hash_index.parquet")
    spark.createDataFrame(seen, SEEN).write.parquet(f"{tmp_path}/observations.parquet")
    want = {f: brute(ev) for f, ev in sightings(index, seen).items()}
    q, key = __spark_entry__.queries(), lambda x: tuple(map(str, x))
    for k, name in enumerate(("p1_attribute_log", "p1_history")):
        got = [tuple(x) for x in q[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=key) == sorted(((f, *x[:-2], micros(x[-2]), micros(x[-1])) for f, w in want.items() for x in w[k]), key=key)
