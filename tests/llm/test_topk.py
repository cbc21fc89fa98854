import math
import random

import numpy as np
import pytest

from cuesift.llm import queries, topk

ROW = "vec_id long, embedding array<float>, score long, Vec_ID string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], ROW).repartition(3)


def slow(rows, asked, k):
    """rows: (id, vector) in any order; asked: the same."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for q, v in {q: v for q, v in sorted((a for a in asked if a[0] is not None and fine(a[1])), key=lambda a: (a[0], a[1]), reverse=True)}.items():
        scores = sorted((-sum(a * b for a, b in zip(whole(v), whole(w))), i) for i, w in rows if i is not None and i != q and fine(w) and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, asked, k=10, **options):
    return sorted(tuple(r) for r in topk.search(topk.build_index(frame(spark, rows)), frame(spark, asked), k, **options).collect())


@pytest.mark.parametrize("seed,dims,block", [(0, 8, 1024), (1, 3, 4), (2, 64, 7)])
def test_against_brute_force(spark, seed, dims, block):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(dims)]) for i in range(300)]
    asked = rows[::10]
    assert found(spark, rows, asked, block=block) == slow(rows, asked, 10)


def test_awkward_vectors(spark):
    rng = random.Random(3)
    vec = lambda n=4: [rng.uniform(-1, 1) for _ in range(n)]
    rows = [(i, vec()) for i in range(30)] + [(30, None), (31, [1.0, None, 0.0, 0.0]), (32, [float("nan")] * 4), (33, [float("inf"), 0.0, 0.0, 0.0]), (34, vec(3)), (35, vec(3)), (36, []), (37, []), (None, vec()), (38, [1e30, -1e30, 0.0, 1.0]), (39, [900.0, -70000.0, 3.0, 0.0])]
    rows += [(5, rows[5][1]), (6, rows[6][1]), (7, vec())]
    asked = [r for r in rows if r[0] is None or r[0] % 3 == 0 or r[0] in (34, 36, 37)]
    asked = [r for r in asked if r[0] != 38]
    got, want = found(spark, rows, asked), slow(rows, asked, 10)
    clip = lambda rs: [(*r[:3], min(max(r[3], -(1 << 63)), (1 << 63) - 1)) for r in rs]
    assert got == clip(want)


def test_ties_few_rows_and_none(spark):
    rows = [(i, [0.5, 0.5]) for i in range(25)]
    assert found(spark, rows, rows[:2]) == slow(rows, rows[:2], 10)
    assert found(spark, rows[:4], rows[:4]) == slow(rows[:4], rows[:4], 10)
    assert found(spark, rows, []) == [] and found(spark, [], rows) == []
    assert "op10_topk" in queries.ORACLES


def test_bounds_save_reading(spark):
    """Of 4,000 rows for 20 queries few exact vectors are read; one that is out of the ordinary makes cells wide, not results wrong."""
    rng = np.random.default_rng(0)
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((4000, 32)) / 8).astype(np.float32).astype(float).tolist())]
    rows[17] = (17, [100.0] * 32)
    asked = rows[::200]
    reads = spark.sparkContext.accumulator(0)
    assert found(spark, rows, asked, block=3, reads=reads) == slow(rows, asked, 10)
    assert 200 <= reads.value < 0.1 * len(rows) * len(asked) / 10


def test_very_long_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(20_000)]) for i in range(12)]
    assert found(spark, rows, rows[:3], 4) == slow(rows, rows[:3], 4)
