"""p8_found against a walk over all word windows, and the word rules."""

import random

import pytest

import __spark_entry__
from linkloom.llm import leaks


def brute(items, w, least):
    windows = lambda x: {tuple(x[k : k + least]) for k in range(len(x) - least + 1)}
    return {i for i, x in items if windows(x) & windows(w)}


@pytest.mark.parametrize("seed", range(30))
def test_automaton_equals_all_windows(seed):
    r = random.Random(seed)
    least = r.choice([1, 2, 4, 13])
    letters = "abc"[: r.choice([1, 2, 3])]
    make = lambda n: [r.choice(letters) for _ in range(r.randrange(n))]
    items = [(i, make(40)) for i in range(8)] + [(8, ["a"] * 20)]
    automaton = leaks.Automaton(items, least)
    for _ in range(60):
        w = make(60)
        if r.random() < 0.5 and items[2][1]:
            w = make(9) + items[2][1][: r.randrange(1, 30)] + ["x"] + make(9)
        assert automaton.items_in(w) == brute(items, w, least)


def test_words():
    assert leaks.words("Ａ <b>b</b>ig  café, CAFÉ --- x​y­z ①") == ["a", "big", "café", "café", "xyz", "1"]
    assert leaks.words("one</p><p>two&nbsp;three&eacute; it´s STRASSE straße ﬁn") == ["one", "two", "threeé", "its", "strasse", "strasse", "fin"]
    assert leaks.words("1 < 2 and 3 > 2　x") == ["1", "2", "and", "3", "2", "x"]
    assert leaks.words(None) == leaks.words("") == leaks.words(" - \n") == []


def test_p8_found(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, "k", text), (2, "k", "w1 w2 w3")], "item_id bigint, item_kind string, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    w = text.split()
    docs = [(1, " ".join(w[5:18])), (2, " ".join(w[5:17])), (3, "x " + " ".join(x.upper() + "!" for x in w[20:36])), (4, None), (5, " ".join(w[:12] + ["y"] + w[12:24]))]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()["p8_found"](spark, str(tmp_path))
    assert out.columns == ["item_id", "doc_id"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1), (1, 3)]
