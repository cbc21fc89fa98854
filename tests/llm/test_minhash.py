import random
import re

import pytest
from pyspark.sql import functions as F

from cuesift.llm import minhash, queries
from tests.llm.data import SF, awkward_docs, needs_tables, no_docs


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if len(w) >= 5 else {tuple(w)}


def slow(docs, percent):
    """docs: list of (id, text) with distinct ids."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    u, v = find(a), find(b)
                    root[max(u, v)] = min(u, v)
    return {d: (len(sets[d]), find(d)) for d in ids}


def families(seed, n=6, size=25):
    """Groups of edited copies, with similarities around the thresholds, and texts on their own."""
    rng = random.Random(seed)
    texts = []
    for f in range(n):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]


@pytest.mark.parametrize("seed,percent,block", [(0, 85, 256), (1, 80, 256), (2, 85, 4), (3, 80, 3), (4, 90, 7)])
def test_against_brute_force(spark, seed, percent, block):
    docs = list(enumerate(families(seed)))
    random.Random(seed).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, percent=percent, block_docs=block).collect()}
    want = slow(docs, percent)
    assert got == want
    assert 20 < len({c for _, c in want.values()}) < len(docs)


@pytest.mark.parametrize("broadcast", [minhash.BROADCAST_IDS, 0])
def test_awkward_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", broadcast)
    docs = awkward_docs(spark)
    rows = docs.collect()
    out = minhash.near_duplicates(docs, percent=80).collect()
    assert len(out) == len(rows)
    want = slow({r[0]: r[1] for r in rows if r[0] is not None}.items(), 80)
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == (want[r["doc_id"]] if r["doc_id"] is not None else (0, None))
        assert r["kept"] == (r["component_id"] == r["doc_id"])
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {None} | {d for d, (_, c) in want.items() if c == d}
    assert minhash.near_duplicates(no_docs(spark)).count() == 0 and minhash.drop_near_duplicates(no_docs(spark)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, text), (2, "something else"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 26, 1, True), (2, 1, 2, True), (2, 26, 1, False), (3, 0, 3, True)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        root[max(u, v)] = min(u, v)
    got = dict(map(tuple, minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


@needs_tables
def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") < 20_000).collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_minhash(spark, SF).collect()}
    want = slow(docs, 85)
    assert {d: got[d] for d in want} == want
