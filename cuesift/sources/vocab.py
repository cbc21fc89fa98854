"""WordPiece vocabularies, as an encoder or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import read_bytes
from ..functions.wordpiece import MAX_LEN, WordPiece


def vocab_lines(path: str) -> list[str]:
    lines = read_bytes(path).decode().split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def load_vocab(path: str, max_len: int = MAX_LEN) -> WordPiece:
    return WordPiece(vocab_lines(path), max_len)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """token, id: the token without white space behind it; of equal tokens the last line counts."""
    rows = spark.createDataFrame([(t.rstrip(), i) for i, t in enumerate(vocab_lines(path))], "token string, id int")
    return rows.groupBy("token").agg(F.max("id").alias("id"))
