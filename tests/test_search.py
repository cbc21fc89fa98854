import math
import random

import pytest
from pyspark.sql import functions as F

from cuesift.operators.batching import length_batches
from cuesift.operators.search import presented, search, video_link
from cuesift.operators.windowing import sliding_chunks, walked
from cuesift.functions.captions import Word, chunk_words

INDEX = "chunk_idx long, vod_id string, text string, start double, embedding array<float>"
ROWS = [(0.9, "a", 0.0), (0.8, "a", 30.0), (0.7, "a", 61.0), (0.6, "b", 5.0), (0.2, "b", 200.0), (0.1, "c", 0.0)]


def index_of(spark, rows):
    return spark.createDataFrame([(i, v, f"t{i}", t, [float(s), 0.0]) for i, (s, v, t) in enumerate(rows)], INDEX)


def walked(rows, k, min_p, gap):
    """The definition, over (score, vod, start) in corpus order."""
    out = []
    for i in sorted(range(len(rows)), key=lambda i: -rows[i][0]):
        s, v, t = rows[i]
        if any(rows[j][1] == v and abs(rows[j][2] - t) < gap for j in out):
            continue
        out.append(i)
        if s < min_p or len(out) == k:
            break
    return out


@pytest.mark.parametrize("k,min_p,want", [(256, 0.35, [0.9, 0.7, 0.6, 0.2]), (2, 0.35, [0.9, 0.7]), (0, 0.35, [0.9, 0.7, 0.6, 0.2]), (256, 0.0, [0.9, 0.7, 0.6, 0.2, 0.1]), (256, 2.0, [0.9])])
def test_golden(spark, k, min_p, want):
    found = search(index_of(spark, ROWS), [1.0, 0.0], k, min_p).orderBy("rank").collect()
    assert [round(r["score"], 5) for r in found] == want and [r["rank"] for r in found] == list(range(len(want)))


@pytest.mark.parametrize("seed", range(4))
def test_like_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(-4, 8) / 8, rng.choice("abc"), rng.randrange(20) * 15.0) for _ in range(60)]
    for k, min_p in ((0, 0.25), (5, 0.5), (100, -1.0)):
        found = search(index_of(spark, rows), [1.0, 0.0], k, min_p).orderBy("rank").collect()
        assert [r["chunk_idx"] for r in found] == walked(rows, k, min_p, 60.0)


def test_edges(spark):
    assert search(index_of(spark, []), [1.0, 0.0]).count() == 0
    at_gap = index_of(spark, [(0.9, "a", 0.0), (0.9, "a", 60.0), (0.9, "a", 59.0)])
    assert [r["chunk_idx"] for r in search(at_gap, [1.0, 0.0]).orderBy("rank").collect()] == [0, 1]
    with pytest.raises(Exception, match="not a number"):
        search(index_of(spark, [(float("nan"), "a", 0.0)]), [1.0, 0.0]).collect()
    with pytest.raises(Exception, match="components"):
        search(index_of(spark, ROWS), [1.0]).collect()
    shown = presented(search(index_of(spark, ROWS), [1.0, 0.0], 1), index_of(spark, ROWS)).first()
    assert tuple(shown) == (0, "0.900", "https://youtube.com/watch?v=a&t=0", "t0")
    links = spark.createDataFrame([("v", -2.5), ("v", 7.9), ("v", 1e12), ("v", float("nan"))], "v string, s double")
    assert [r[0].split("t=")[-1] for r in links.select(video_link(links.v, links.s)).collect()] == ["0", "7", "4294967295", "0"]


@pytest.mark.parametrize("seed,disorder", [(0, False), (1, False), (2, True)])
def test_windows(spark, seed, disorder):
    rng = random.Random(seed)
    videos = {v: sorted(rng.choice([0.1, 0.3, 1.1]) * rng.randrange(40) for _ in range(30)) for v in "abcd"}
    if disorder:
        rng.shuffle(videos["b"])
    words = [(v, i, f"w{i}", t) for v, ts in videos.items() for i, t in enumerate(ts)]
    got = sliding_chunks(spark.createDataFrame(words, "vod_id string, seq int, text string, t double"), 1.1, 0.3)
    want = [(v, c.text, c.start, c.end) for v, ts in videos.items() for c in chunk_words([Word(f"w{i}", t) for i, t in enumerate(ts)], v, 1.1, 0.3)]
    assert sorted((r["vod_id"], r["text"], r["start"], r["end"]) for r in got.collect()) == sorted(want)


def test_windows_are_not_listed(spark):
    """No table of all windows, which the driver would have to hold for a broadcast; a key of a million empty windows is no more work than another."""
    words = [("a", 0, "x", 0.1), ("a", 1, "y", 3e5), (None, 0, "z", 1.0), ("b", 0, "z", 1.0), ("c", 0, "u", 1.0), ("c", 1, "v", float("nan"))]
    got = sliding_chunks(spark.createDataFrame(words, "vod_id string, seq int, text string, t double"), 1.1, 0.3)
    assert "Join" not in got._jdf.queryExecution().toString()
    want = [(v, c.text, c.start, c.end) for v in "abc" for c in chunk_words([Word(w[2], w[3]) for w in words if w[0] == v], v, 1.1, 0.3)]
    assert sorted((r["vod_id"], r["text"], r["start"], r["end"]) for r in got.collect()) == sorted(want) and len(want) == 5
    many = sliding_chunks(spark.createDataFrame(words[:1] + words[3:4], "vod_id string, seq int, text string, t double"), 30.0, 0.3)
    assert many.count() == 2


@pytest.mark.parametrize("stride", [0.3, 1.5, 10800.0, 1 / 3])
def test_walked(spark, stride):
    """Begins worked out by leaps are those of adding again and again, over ties, powers of two and zero."""
    rng, rows = random.Random(1), []
    for first in (0.0, -5000 * stride, 1.7e9, stride * 2.0**30, -stride * 2.0**40, 2.0**33 - 9 * stride, 2.0**52 + 1, 2.0**52 + 2, 2.0**53 - 2000):
        k, at = rng.choice([0, 1, 7, 3000, 50000]), first
        for _ in range(k):
            at += stride
        if at + stride != at:
            rows.append((first, k, at))
    df = spark.createDataFrame(rows, "first double, k long, at double")
    by_count, by_time = walked(F.col("first"), stride, F.col("k"), F.lit(float("inf"))), walked(F.col("first"), stride, F.lit(1 << 62), F.col("at"))
    assert all(tuple(r["x"]) == tuple(r["y"]) == (r["k"], r["at"]) for r in df.select("k", "at", by_count.alias("x"), by_time.alias("y")).collect())


def test_length_batches(spark):
    rows = [(i, (i * 7) % 5) for i in range(23)]
    got = {r["i"]: r["batch"] for r in length_batches(spark.createDataFrame(rows, "i int, n int"), "n", "i", 4).collect()}
    order = sorted(range(23), key=lambda i: (rows[i][1], i))
    assert got == {i: place // 4 for place, i in enumerate(order)}
    assert math.ceil(23 / 4) == len(set(got.values()))
