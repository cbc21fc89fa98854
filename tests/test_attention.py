import numpy as np
import pytest

from cuesift.functions import tensor
from cuesift.plans import queries

DIMS = 64


def slow(rows):
    """rows: list of (id, label, vector); ids in several rows share one softmax."""
    out = {}
    for i in {r[0] for r in rows}:
        pairs = [(np.dot(v, w) / 8, w) for j, label, v in rows if j == i and label is not None for _, other, w in rows if other == label]
        if pairs:
            s = np.array([p[0] for p in pairs])
            weights = np.exp(s - s.max())
            out[i] = weights @ np.array([p[1] for p in pairs]) / weights.sum()
    return out


@pytest.mark.parametrize("queries_at_once, keys_at_once", [(2048, 1024), (16, 7)])
def test_all_rows_of_a_label_attend(spark, tmp_path, monkeypatch, queries_at_once, keys_at_once):
    """More than a hundred rows, ids from 100 on, a label of one row, no label, and a repeated row."""
    monkeypatch.setattr(tensor, "QUERY_BLOCK", queries_at_once)
    monkeypatch.setattr(tensor, "KEY_BLOCK", keys_at_once)
    rng = np.random.default_rng(0)
    rows = [(i, None if i == 7 else 9 if i == 8 else int(i % 3), (rng.standard_normal(DIMS) * (30 if i % 11 == 0 else 1)).astype(np.float32).astype(float).tolist()) for i in [*range(9), *range(99, 240)]]
    rows += [rows[3], (rows[4][0], 2, rows[5][2])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["y"] for r in queries.QUERIES["self_attention"](spark, str(tmp_path)).collect()}
    want = slow(rows)
    assert got.keys() == want.keys() and max(got) > 100 and 7 not in got
    for i, y in want.items():
        assert np.allclose(got[i], y, atol=2e-6), i
