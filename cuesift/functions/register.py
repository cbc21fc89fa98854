"""The Python functions under names for SQL, and captions as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from .captions import parse_captions
from .text import collapse_text, decode_word, fix_query, timecode
from .wordpiece import WordPiece


class CaptionWords:
    """caption_words(source): seq, text, t of each word in the text of one caption file."""

    def eval(self, source: str) -> Iterator[tuple]:
        for i, w in enumerate(parse_captions(source or "")):
            yield i, w.text, w.t


def _over(f: object, kind: pa.DataType) -> object:
    def run(column: pa.Array) -> pa.Array:
        return pa.array([f(x.as_py()) if x.is_valid else None for x in column], kind)

    return run


def register(spark: SparkSession, vocab: WordPiece | None = None) -> None:
    """collapse(text), decode_entities(text), fix_query(text), timecode(text), caption_words(text); with a vocabulary, wordpiece(text)."""
    strings = pa.string()
    named = {"collapse": (collapse_text, "string", strings), "decode_entities": (decode_word, "string", strings), "fix_query": (fix_query, "string", strings), "timecode": (timecode, "double", pa.float64())}
    if vocab is not None:
        held = spark.sparkContext.broadcast(vocab)
        named["wordpiece"] = (lambda text: held.value.encode(text), "array<int>", pa.list_(pa.int32()))
    for name, (f, ddl, kind) in named.items():
        spark.udf.register(name, arrow_udf(_over(f, kind), ddl))
    spark.udtf.register("caption_words", udtf(CaptionWords, returnType="seq int, text string, t double"))
