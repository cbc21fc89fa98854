"""Which caption files of each channel were parsed already: one JSON document in a file."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<channel_id: string, parsed_files: array<string>>"
SCHEMA = f"entries array<{ENTRY}>"


def manifest_of(paths: DataFrame) -> DataFrame:
    """One row with the entries of files at <channel>/raw/<name>, in order of channel and name. paths: column path."""
    parts = F.split("path", "/")
    named = paths.select(F.element_at(parts, -3).alias("channel_id"), F.element_at(parts, -1).alias("name"))
    entries = named.groupBy("channel_id").agg(F.sort_array(F.collect_set("name")).alias("parsed_files"))
    return entries.agg(F.coalesce(F.sort_array(F.collect_list(F.struct("channel_id", "parsed_files"))), F.array().cast(f"array<{ENTRY}>")).alias("entries"))


def write_manifest(paths: DataFrame, file: str) -> None:
    """The manifest as {"entries": [...]}; replaced in one step."""
    text = manifest_of(paths).select(F.to_json(F.struct("entries"))).first()[0]
    with open(f"{file}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{file}.new", file)


def read_manifest(spark: SparkSession, file: str) -> DataFrame:
    """channel_id, parsed_file."""
    whole = spark.read.schema(SCHEMA).json(file, multiLine=True)
    return whole.select(F.inline("entries")).select("channel_id", F.explode("parsed_files").alias("parsed_file"))
