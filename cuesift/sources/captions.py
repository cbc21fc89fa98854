"""Caption files as words or chunks. Files are found by the driver and parsed whole by the tasks.

Spark's own file sources pass over names that begin with '_' or '.', which video ids may, and mend
invalid UTF-8, which here is an error; so files are opened in the tasks.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession

from ..files import entries, folders, read_bytes
from ..functions.captions import file_chunks, parse_captions

CHUNKS = "chunk_idx long, vod_id string, text string, start double, end double"
WORDS = "path string, vod_id string, seq int, text string, t double"
#: chunk_idx is the file's number times this, plus the chunk's place in the file.
PER_FILE = 1 << 24


def find_files(base: str) -> list[str]:
    """All entries of <base>/<channel>/raw, whatever their names, sorted. A base or raw folder that is missing is an error."""
    return sorted(path for channel in folders(base) for path in entries(f"{channel}/raw"))


def read_file(path: str) -> str:
    return read_bytes(path).decode("utf-8")


def _over_files(spark: SparkSession, paths: list[str], first: int, rows: Callable[[int, str], list[tuple]], schema: str, done: Accumulator | None = None, per_task: int = 64) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    tasks = max(1, min(len(paths), max(spark.sparkContext.defaultParallelism, -(-len(paths) // per_task))))
    files = spark.createDataFrame([(first + i, p) for i, p in enumerate(paths)], "no long, path string").repartitionByRange(tasks, "no")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        fields = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in schema.split(", ")])
        for batch in batches:
            for no, path in zip(*[c.to_pylist() for c in batch.columns]):
                if out := rows(no, path):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
                if done is not None:
                    done.add(1)

    return files.mapInArrow(read, schema).select(*names)


def read_words(spark: SparkSession, base: str) -> DataFrame:
    """Every timed word of every file below base."""

    def rows(no: int, path: str) -> list[tuple]:
        vod = os.path.basename(path).split(".", 1)[0]
        return [(path, vod, i, w.text, w.t) for i, w in enumerate(parse_captions(read_file(path)))]

    return _over_files(spark, find_files(base), 0, rows, WORDS)


def chunks_of(spark: SparkSession, paths: list[str], first: int = 0, done: Accumulator | None = None) -> DataFrame:
    """Cleaned 30-second chunks of these files; an unreadable one fails its task and so the job. done counts files."""

    def rows(no: int, path: str) -> list[tuple]:
        return [(no * PER_FILE + i, *c_values) for i, c in enumerate(file_chunks(os.path.basename(path), read_file(path))) for c_values in [(c.vod_id, c.text, c.start, c.end)]]

    return _over_files(spark, paths, first, rows, CHUNKS, done)


def read_chunks(spark: SparkSession, base: str, done: Accumulator | None = None) -> DataFrame:
    return chunks_of(spark, find_files(base), done=done)
