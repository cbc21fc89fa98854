"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters whole records over memory-sized buckets by seeded hashes; pass two shuffles each
bucket with the engine's own Fisher-Yates (``shuffle``) and numbers it. A bucket belongs to one
shard, so the shards are the concatenations of their buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import numbered, unclashed

BUCKET_BYTES = 4 << 20
#: Bytes that a task shuffles, bucket after bucket: two buckets up to so many tasks, then more, but not beyond a bound.
MANY_TASKS, TASK_BYTES = 4096, 128 << 20


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard with the highest seeded hash of (key, shard): one more shard takes rows only into itself.

    Costs one hash a shard; a null key is a key like any other.
    """
    votes = [F.struct(F.xxhash64(F.lit(seed), F.coalesce(key, F.lit("null")), F.lit(s)).alias("vote"), F.lit(s).alias("shard")) for s in range(shards)]
    return F.array_max(F.array(*votes))["shard"]


def shard_records(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records of df with shard, slot (gapless from 0 in each shard, in shuffled order) and grown_shard.

    The law is ``key``: the key and the number of shards decide the shard; grown_shard is that with
    one more shard. Buckets are drawn from key and text, so one hot key doesn't make a hot bucket
    unless its records are equal byte by byte; such copies are told apart by all other columns that can be hashed. The bucket counts follow from each shard's bytes, so a
    bucket is about bucket_bytes whatever the input's size (plus its longest record).

    Null keys form one key, null texts count as empty, repeated rows each get a slot, an empty
    table gives an empty one. Input columns named shard, slot or grown_shard come out as <name>_in.
    Map columns pass through. A very long text is one
    record, and a bucket is longer by it.
    """
    rows, own = numbered(df)
    kinds = [f.dataType for f in df.schema.fields]
    rows = rows.select(*[F.map_entries(c).alias(c) if isinstance(k, T.MapType) else F.col(c) for c, k in zip(rows.columns, kinds)])
    k, body = F.col(f"in_{own.index(key)}").cast("string"), F.coalesce(F.col(f"in_{own.index(text)}"), F.lit(""))
    placed = rows.withColumn("shard", shard_of(k, shards, seed))
    weight = {r["shard"]: r["bytes"] for r in placed.groupBy("shard").agg(F.sum(F.octet_length(body) + 1).alias("bytes")).collect()}  # one row a shard
    many = F.array(*[F.lit(max(1, -(-weight.get(s, 0) // bucket_bytes))).cast("long") for s in range(shards)])
    others = [F.col(c) for c, t in zip(rows.columns, kinds) if not isinstance(t, T.VariantType)]
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), k, body, *others), F.element_at(many, F.col("shard") + 1)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A number of tasks that follows from the data, sorted buckets in each and sorted records in these give every
    # bucket the same part of its task's random stream, in a repeated task as in another run.
    total = sum(weight.values())
    tasks = max(1, -(-total // min(max(total // MANY_TASKS, 2 * bucket_bytes), TASK_BYTES)))
    buckets = placed.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("records"))
    shuffled = buckets.sortWithinPartitions("shard", "bucket").select("shard", "bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    out = shuffled.join(offsets, ["shard", "bucket"]).select("shard", "base", F.posexplode("records").alias("at", "record"))
    back = [F.map_from_entries(f"record.in_{i}").alias(f"in_{i}") if isinstance(t, T.MapType) else F.col(f"record.in_{i}") for i, t in enumerate(kinds)]
    out = out.select(*back, "shard", (F.col("base") + F.col("at")).alias("slot"))
    added = ["shard", "slot", "grown_shard"]
    return out.withColumn("grown_shard", shard_of(F.col(f"in_{own.index(key)}").cast("string"), shards + 1, seed)).toDF(*unclashed(own, added), *added)


def write_shards(df: DataFrame, path: str, **options: object) -> None:
    """Writes the records as one folder of Parquet files a shard, in slot order within each file."""
    shard_records(df, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
