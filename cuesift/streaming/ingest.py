"""Captions as a stream: new files are chunked, embedded and appended to the index, each video once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.encoder import Config
from ..functions.wordpiece import WordPiece
from ..operators.batching import embed
from ..sources.captions import chunks_of
from ..sources.index import missing_videos, read_index, write_index

#: A batch's chunks are numbered from this times its number on, so ids never meet.
FILES_A_BATCH = 1 << 20


def append_files(spark: SparkSession, paths: list[str], batch_id: int, index_path: str, vocab: WordPiece, weights_path: str, config: Config, model: str) -> None:
    """Adds the videos of these files that the index lacks; running a batch again adds nothing twice."""
    chunks = chunks_of(spark, sorted(paths), first=(batch_id + 1) * FILES_A_BATCH)
    fresh = missing_videos(chunks, read_index(spark, index_path, model))
    write_index(embed(fresh, vocab, weights_path, config), index_path, model, config.hidden, mode="append")


def ingest_stream(paths: DataFrame, index_path: str, checkpoint: str, vocab: WordPiece, weights_path: str, config: Config, model: str) -> StreamingQuery:
    """Starts the stream. paths is a streaming frame with a column ``path`` of caption files (a listing, say), as many a trigger as its source allows."""

    def one(batch: DataFrame, batch_id: int) -> None:
        names = [r["path"] for r in batch.select("path").distinct().orderBy("path").toLocalIterator()]
        if names:
            append_files(batch.sparkSession, names, batch_id, index_path, vocab, weights_path, config, model)

    return paths.filter(F.col("path").isNotNull()).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
