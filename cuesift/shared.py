"""Scratch tables in the folder that all executors share, and ranks over a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="cuesift-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/cuesift/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again with its own schema."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables; frames that still read them can't be used after it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cuesift/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def globally_ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with its 0-based place in a total order, without moving all rows to one task.

    Rows are range-partitioned, numbered within each range, and written; the ranges' sizes (one row a
    range) give the offsets.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return kept.join(offsets, "_range").withColumn(name, F.col("_base") + F.col("_at")).drop("_range", "_at", "_base")
