import zlib

from pyspark.sql import functions as F

from cuesift.llm import queries, sharding
from tests.llm.data import SF, awkward_docs, needs_tables, no_docs


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < shards and r["grown_shard"] in (r["shard"], shards)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    out = sharding.shard_records(docs, 4, bucket_bytes=2000)
    assert "shard_in" in out.columns and "Text" in out.columns
    rows = out.collect()
    check(rows, 4)
    ids = lambda rs: sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rs)
    assert ids(rows) == ids(docs.collect())
    key = lambda r: (str(r[0]), str(r[1]), r["shard"], r["slot"])
    for parts in (1, 3, 7):
        again = sharding.shard_records(docs.repartition(parts), 4, bucket_bytes=2000).collect()
        assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sharding.shard_records(no_docs(spark), 4).count() == 0


def test_key_law_and_balance(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    rows = sharding.shard_records(df, 16, bucket_bytes=1000).collect()
    check(rows, 16)
    assert all(r["m"] == {"k": r["doc_id"]} for r in rows)
    counts = [sum(r["shard"] == s for r in rows) for s in range(16)]
    assert max(counts) < 1.3 * 250 and min(counts) > 0.7 * 250
    some = {r["doc_id"]: r["shard"] for r in sharding.shard_records(df.filter("doc_id % 3 = 0"), 16).collect()}
    assert all(some[r["doc_id"]] == r["shard"] for r in rows if r["doc_id"] in some)
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_records(df, 17).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in rows)
    moved = sum(r["grown_shard"] == 16 for r in rows)
    assert 0.6 * 4000 / 17 < moved < 1.4 * 4000 / 17
    order = [r["doc_id"] for r in sorted((r for r in rows if r["shard"] == 0), key=lambda r: r["slot"])]
    assert order != sorted(order)


@needs_tables
def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_sharding(spark, SF).collect()
    check(rows, 16)
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"]) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode()), "key") for d, t in texts.items()}


def test_files(spark, tmp_path):
    docs = awkward_docs(spark)
    sharding.write_shards(docs.toDF(*[c if c != "Text" else "other" for c in docs.columns]), str(tmp_path / "out"), shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == awkward_docs(spark).count()
