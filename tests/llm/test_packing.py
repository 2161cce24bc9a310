"""p7_containers: first fit against a plain search, and what holds of every packing."""

import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__
from linkloom.llm import packing


@pytest.mark.parametrize("seed", range(20))
def test_first_fit_equals_plain_search(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 100])
    sizes = sorted((r.randint(0, capacity) for _ in range(r.randrange(200))), reverse=seed % 2 == 0)
    free, held, want = [], [], []
    for s in sizes:
        c = next((i for i, x in enumerate(free) if x >= s), len(free))
        if c == len(free):
            free.append(capacity)
            held.append(0)
        want.append((c, held[c], capacity - free[c]))
        free[c] -= s
        held[c] += 1
    assert packing.first_fit(sizes, capacity) == want


def test_larger_than_a_container():
    with pytest.raises(ValueError):
        packing.Tournament(5).place(6)


def test_pack(spark):
    r = random.Random(1)
    sizes = {i: r.choice([0, 1, 64, 65, 128, 200, r.randrange(64)]) for i in range(1, 600)}
    rows = packing.pack(spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint"), 64, 4000).collect()
    total = Counter()
    by = defaultdict(list)
    for x in rows:
        total[x["doc_id"]] += x["n_tokens"]
        by[x["container"]].append((x["place"], x["start"], x["n_tokens"]))
    assert {k: total[k] for k in sizes} == sizes
    assert Counter(x["doc_id"] for x in rows) == {i: max(1, -(-n // 64)) for i, n in sizes.items()}
    for held in by.values():
        at = 0
        for k, (place, start, n) in enumerate(sorted(held)):
            assert (place, start) == (k, at)
            at += n
        assert at <= 64
    assert len(by) <= 1.05 * sum(sizes.values()) / 64 + 10
    assert len({c >> 32 for c in by}) > 1


def test_p7_containers(spark, tmp_path):
    texts = {1: "one two three", 2: "word " * 5000, 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = __spark_entry__.queries()["p7_containers"](spark, str(tmp_path)).collect()
    own = packing.encoding()
    got = Counter()
    for x in rows:
        got[x["doc_id"]] += x["n_tokens"]
    assert {k: got[k] for k in texts} == {k: len(own.encode_ordinary(t or "")) for k, t in texts.items()}
    assert sorted(Counter(x["doc_id"] for x in rows).items()) == [(1, 1), (2, -(-got[2] // 2048)), (3, 1), (4, 1)]
