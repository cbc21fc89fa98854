"""Length-sorted batches and the embedding of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoder import Config, Encoder
from ..functions.wordpiece import WordPiece
from ..shared import globally_ranked

BATCH = 8192


def length_batches(df: DataFrame, length: str, idx: str, batch: int) -> DataFrame:
    """df with ``batch``: the place in the order of (length, idx), divided by the batch size."""
    ranked = globally_ranked(df, [F.asc(length), F.asc(idx)], "_place")
    return ranked.withColumn("batch", F.floor(F.col("_place") / batch).cast("long")).drop("_place")


_encoders: dict[tuple, Encoder] = {}


def embed(chunks: DataFrame, vocab: WordPiece, weights_path: str, config: Config, batch: int = BATCH, floats: int = 1 << 18, tasks: int | None = None, keep: list[str] | None = None, double: bool = False, done: Accumulator | None = None) -> DataFrame:
    """chunks (or their columns ``keep``) with ``embedding``. weights_path is a safetensors file that every worker can read.

    One pass through Python: each Arrow batch is encoded, taken in the order of token counts in
    groups of at most ``batch`` rows, fewer where the largest array (attention scores, or the inner layer) would
    pass so many ``floats``, and put back in its own order. Weights are loaded once a worker. Rows are
    neither sorted nor moved, as an embedding doesn't depend on its batch; give ``tasks`` to spread an
    input that comes in fewer parts than there are cores, which shuffles the texts. ``double`` computes in double precision; ``done`` counts
    rows as their tasks end.
    """
    spark: SparkSession = chunks.sparkSession
    names = chunks.columns if keep is None else keep
    kinds = dict(chunks.dtypes)
    rows = chunks.repartition(tasks) if tasks else chunks
    rows = rows.select(*[F.col(f"`{n}`") for n in names], F.coalesce("text", F.lit("")).alias("_text"))
    held = spark.sparkContext.broadcast(vocab)
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in names] + ["embedding array<" + ("double" if double else "float") + ">"])
    dtype = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.safetensors import SafeTensors

        at = (weights_path, config, double)
        if at not in _encoders:
            _encoders[at] = Encoder(SafeTensors(weights_path).all(), config, dtype)
        model, words = _encoders[at], held.value
        for part in batches:
            ids = [words.encode(t.as_py()) for t in part.column(len(names))]
            order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
            out, i = np.zeros((len(ids), config.hidden), dtype), 0
            while i < len(ids):
                j = i + 1
                while j < len(ids) and j - i < batch and (j + 1 - i) * len(ids[order[j]]) * max(config.heads * len(ids[order[j]]), config.intermediate) <= floats:
                    j += 1
                out[order[i:j]] = model.embed([ids[x] for x in order[i:j]])
                i = j
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, max(config.hidden, 1), dtype=np.int32)), pa.array(out.reshape(-1)))
            yield pa.record_batch([*part.columns[: len(names)], lists], names=[*names, "embedding"])
            if done is not None:
                done.add(len(ids))

    return rows.mapInArrow(run, schema)
