"""p1_attribute_log and p1_history against row-by-row Python."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

import __spark_entry__

INDEX = """file_ref string, current_hash string, algo string, file_name string, size bigint, etag string, site_path string, library string,
last_confirmed_at timestamp_ntz, last_confirmed_by string, current_hash_observed_at timestamp_ntz, text_hash string, simhash64 bigint,
previous array<struct<hash:string,algo:string,observed_at:timestamp_ntz,observed_by:string,text_hash:string,simhash64:bigint>>"""
SEEN = """file_ref string, file_name string, size bigint, etag string, hash string, algo string, text_hash string, simhash64 bigint,
site_path string, library string, job_id string, observed_at timestamp_ntz, ordinal bigint"""
START = datetime(2025, 1, 1)
ATTRIBUTES = ["hash", "algo", "text_hash", "simhash64", "file_name", "size", "etag", "site_path", "library"]


def tables(spark, root, seed=5, files=9, n=160):
    """Small random hash_index and observations; every sighting has text."""
    r = random.Random(seed)
    at = lambda: START + timedelta(hours=r.randrange(24 * 40))
    pick = lambda *x: r.choice(x)
    text = lambda h: (f"t{h}", int(h, 16) % 1000)
    index, seen = [], []
    for f in range(files):
        old = [(h, pick("full-sha256", None), at(), "job", *text(h)) for h in (pick("aa", "bb", "cc") for _ in range(r.randrange(4)))]
        h = pick("aa", "bb", "cc")
        index.append((f"/f{f}", h.upper(), pick("x", ""), f"n{f}", r.randrange(3), pick("e", None), pick("/s1", None), "lib", pick(at(), None), "job", pick(at(), None), *text(h), old or None))
    for o in range(n):
        h = pick("aa", "bb", "cc")
        seen.append((f"/f{r.randrange(files + 2)}", pick("n1", "n2", None), r.randrange(3), pick("e", "g", ""), h, pick("x", None), *text(h), pick("/s1", "/s2", None), "lib", "j", at(), o))
    spark.createDataFrame(index, INDEX).write.parquet(f"{root}/hash_index.parquet")
    spark.createDataFrame(seen, SEEN).write.parquet(f"{root}/observations.parquet")
    return index, seen


def sightings(index, seen):
    """{file_ref: [(at, origin, place, {attribute: value})]} in order."""
    out = defaultdict(list)
    algo = lambda a: a or "full-sha256"
    for f, h, a, name, size, etag, site, lib, _, _, when, th, sh, old in index:
        for k, p in enumerate(old or []):
            out[f].append((p[2], 0, k, {"hash": p[0].lower(), "algo": algo(p[1]), "text_hash": p[4], "simhash64": p[5]}))
        if when:
            values = (h.lower(), algo(a), th, sh, name, size, etag, site, lib)
            out[f].append((when, 0, len(old or []), dict(zip(ATTRIBUTES, values))))
    for f, name, size, etag, h, a, th, sh, site, lib, _, when, o in seen:
        out[f].append((when, 1, o, dict(zip(ATTRIBUTES, (h.lower(), algo(a), th, sh, name, size, etag, site, lib)))))
    return {f: sorted(x, key=lambda e: e[:3]) for f, x in out.items()}


def micros(t):
    return None if t is None else (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def brute_log(events):
    out = []
    for a in ATTRIBUTES:
        runs = []
        for at, _, _, values in events:
            v = values.get(a)
            if v not in (None, "") and (not runs or runs[-1][0] != str(v)):
                runs.append((str(v), at))
        out += [(a, v, at, runs[i + 1][1] if i + 1 < len(runs) else None) for i, (v, at) in enumerate(runs)]
    return out


def brute_history(events):
    state, by_instant = {}, {}
    for at, _, _, values in events:
        state = state | {a: str(v) for a, v in values.items() if v not in (None, "")}
        by_instant[at] = tuple(state.get(a) for a in ATTRIBUTES)
    runs = []
    for at in sorted(by_instant):
        if not runs or runs[-1][0] != by_instant[at]:
            runs.append((by_instant[at], at))
    return [(*s, at, runs[i + 1][1] if i + 1 < len(runs) else None) for i, (s, at) in enumerate(runs)]


@pytest.mark.parametrize("seed", [5, 6])
def test_p1(spark, tmp_path, seed):
    events = sightings(*tables(spark, tmp_path, seed))
    q = __spark_entry__.queries()
    key = lambda x: tuple(map(str, x))
    got = [tuple(x) for x in q["p1_attribute_log"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(((f, a, v, micros(s), micros(e)) for f, ev in events.items() for a, v, s, e in brute_log(ev)), key=key)
    got = [tuple(x) for x in q["p1_history"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(((f, *x[:-2], micros(x[-2]), micros(x[-1])) for f, ev in events.items() for x in brute_history(ev)), key=key)
