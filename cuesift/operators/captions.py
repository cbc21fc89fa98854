"""Captions that lie in a table, one file a row, as words or chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.captions import STRIDE, WINDOW, chunk_words, clean_chunk, parse_captions


def _expanded(df: DataFrame, key: str, source: str, rows: Callable[[str], list[tuple]], fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                if out := rows(text.as_py() or ""):
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), fields.values())]
                    yield pa.record_batch([pa.concat_arrays([keys.slice(i, 1)] * len(out)), *columns], names=["key", *fields])

    return df.select(key, source).mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def caption_words(df: DataFrame, key: str, source: str) -> DataFrame:
    """key, seq, text, t of every word; a null source is an empty file."""

    def rows(text: str) -> list[tuple]:
        return [(i, w.text, w.t) for i, w in enumerate(parse_captions(text))]

    return _expanded(df, key, source, rows, {"seq": pa.int32(), "text": pa.string(), "t": pa.float64()}, "seq int, text string, t double")


def caption_chunks(df: DataFrame, key: str, source: str, window: float = WINDOW, stride: float = STRIDE) -> DataFrame:
    """key, k, text, start, end of every cleaned chunk."""

    def rows(text: str) -> list[tuple]:
        return [(k, clean_chunk(c.text), c.start, c.end) for k, c in enumerate(chunk_words(parse_captions(text), "", window, stride))]

    fields = {"k": pa.int32(), "text": pa.string(), "start": pa.float64(), "end": pa.float64()}
    return _expanded(df, key, source, rows, fields, "k int, text string, start double, end double")
