"""Vector indexes: a bucketed Parquet layout, and the two-file layout (vectors.f32 and meta.json) for exchange."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..files import open_output, read_bytes, size_of
from ..shared import written

BUCKETS, TASK_BYTES = 64, 128 << 20
META = "model string, dim int, buckets int, schema string"


def _bucket(buckets: int) -> object:
    return F.pmod(F.xxhash64("vod_id"), F.lit(buckets)).cast("int")


def write_index(df: DataFrame, path: str, model: str, dim: int, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """df (chunk_idx, vod_id, text, start, end, embedding) by buckets of videos, with the model's name and dimension beside it.

    Appending checks both. A video's rows are in one bucket folder. df is written once to the shared
    folder and its rows counted; these give the number of tasks, each of about TASK_BYTES, so a hot
    video or bucket is spread over as many files as it needs.
    """
    spark = df.sparkSession
    if mode == "append":
        known = index_meta(spark, path)
        if (known["model"], known["dim"]) != (model, dim):
            raise ValueError(f"the index holds {known['model']} vectors of {known['dim']}, not {model} of {dim}")
        buckets = known["buckets"]
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector isn't of {dim} components")).cast("array<float>"))
    rows = df.withColumn("embedding", checked).withColumn("bucket", _bucket(buckets))
    rows = written(rows, "index-rows")  # embedding isn't repeated for the count
    sizes = rows.groupBy("bucket").agg(F.sum(F.lit(4 * dim + 64) + F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).collect()  # one row a bucket
    parts = {r["bucket"]: max(1, -(-r["bytes"] // TASK_BYTES)) for r in sizes}
    salts = F.array(*[F.lit(parts.get(b, 1)).cast("long") for b in range(buckets)])
    rows.repartition(max(1, sum(parts.values())), "bucket", F.pmod(F.xxhash64("chunk_idx"), F.element_at(salts, F.col("bucket") + 1))).write.mode(mode).partitionBy("bucket").parquet(f"{path}/rows")
    if mode != "append":
        spark.createDataFrame([(model, dim, buckets, rows.schema.json())], META).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def index_meta(spark: SparkSession, path: str) -> dict:
    return spark.read.schema(META).json(f"{path}/about").first().asDict()


def read_index(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The index's rows; another model than the one that built it is an error."""
    known = index_meta(spark, path)
    if model is not None and known["model"] != model:
        raise ValueError(f"the index was built with {known['model']}, not {model}")
    return _rows(spark, path, known).drop("bucket")


def _rows(spark: SparkSession, path: str, known: dict) -> DataFrame:
    """The rows with their bucket, by the stored schema: an index may hold none yet."""
    return spark.read.schema(StructType.fromJson(json.loads(known["schema"]))).parquet(f"{path}/rows")


def of_videos(index: DataFrame | SparkSession, path: str, vod_ids: list[str]) -> DataFrame:
    """The rows of some videos: only their buckets are read."""
    spark = index if isinstance(index, SparkSession) else index.sparkSession
    known = index_meta(spark, path)
    buckets = known["buckets"]
    asked = spark.createDataFrame([(v,) for v in vod_ids], "vod_id string").select(_bucket(buckets)).distinct().collect()
    return _rows(spark, path, known).filter(F.col("bucket").isin([r[0] for r in asked]) & F.col("vod_id").isin(vod_ids)).drop("bucket")


def missing_videos(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """The chunks whose video the index doesn't hold yet."""
    return chunks.join(index.select("vod_id").distinct(), "vod_id", "left_anti")


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks and vectors joined on chunk_idx; one without the other is an error."""
    both = chunks.join(vectors, "chunk_idx", "full")
    whole = F.col("embedding").isNotNull() & F.col("vod_id").isNotNull()
    return both.withColumn("embedding", F.when(whole, F.col("embedding")).otherwise(F.raise_error(F.lit("chunks and vectors don't match")).cast("array<float>")))


def export_files(df: DataFrame, path: str) -> None:
    """vectors.f32 (dimension, then all components, little-endian) and meta.json, in the order of chunk_idx.

    The layout is two single files, so the rows pass the driver in order, partition by partition and packed by the tasks.
    """
    rows = df.orderBy("chunk_idx") if "chunk_idx" in df.columns else df
    dim = next(iter(df.select(F.size("embedding")).head(1)), [0])[0]
    text = F.to_json(F.struct("vod_id", "text", "start", "end"), {"ignoreNullFields": "false"})

    def packed(batches: object) -> object:
        import pyarrow as pa

        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), "<f4")
            if len(flat) != batch.num_rows * dim:
                raise ValueError(f"not all vectors are of {dim} components")
            yield pa.record_batch([pa.array([",".join(batch.column(0).to_pylist())]), pa.array([flat.tobytes()], pa.binary())], names=["meta", "vectors"])

    with open_output(f"{path}/vectors.f32") as vectors, open_output(f"{path}/meta.json") as meta:
        vectors.write(struct.pack("<I", dim))
        meta.write(b"[")
        for i, r in enumerate(rows.select(text.alias("meta"), "embedding").mapInArrow(packed, "meta string, vectors binary").toLocalIterator()):
            vectors.write(bytes(r["vectors"]))
            meta.write(("," * (i > 0) + r["meta"]).encode())
        meta.write(b"]")


def import_files(spark: SparkSession, path: str, block: int = 1 << 16) -> DataFrame:
    """The two files as rows with chunk_idx. A last incomplete component is dropped, and so is what one file has more than the other.

    The tasks read their own ranges of the vector file; the metadata is one JSON text.
    """
    (dim,) = struct.unpack("<I", read_bytes(f"{path}/vectors.f32", 0, 4))
    whole = (size_of(f"{path}/vectors.f32") - 4) // 4
    count = whole // dim if dim else 0
    schema = "array<struct<vod_id: string, text: string, start: double, end: double>>"
    texts = spark.read.text(f"{path}/meta.json", wholetext=True).select(F.posexplode(F.from_json("value", schema)).alias("chunk_idx", "c")).select(F.col("chunk_idx").cast("long").alias("chunk_idx"), "c.*")

    def read(batches: object) -> object:
        import pyarrow as pa

        for batch in batches:
            for first in batch.column("id").to_pylist():
                n = min(block, count - first)
                flat = np.frombuffer(read_bytes(f"{path}/vectors.f32", 4 + 4 * first * dim, 4 + 4 * (first + n) * dim), "<f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(flat))
                yield pa.record_batch([pa.array(np.arange(first, first + n)), lists], names=["chunk_idx", "embedding"])

    vectors = spark.range(0, count, block).mapInArrow(read, "chunk_idx long, embedding array<float>")
    return texts.join(vectors, "chunk_idx")
