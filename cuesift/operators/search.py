"""Exact similarity search with suppression of neighbours in time.

Rows are scored by inner product, taken from the best down (ties: smaller chunk_idx), and left out if a
kept row of the same video lies less than ``gap`` seconds away. The result ends after k rows or after
the first row below ``min_p``, which is still part of it.

Suppression couples rows of one video only, and rows below min_p never matter to rows above. So
only rows above it are folded, per video; of the rest just the best one that no kept row
suppresses is looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tensor import dot_with
from ..shared import globally_ranked, written

GAP, TOP_K, MIN_P = 60.0, 256, 0.35
LINK = "https://youtube.com/watch?v="


def scored(index: DataFrame, query: list[float], digits: int | None = None) -> DataFrame:
    """chunk_idx, vod_id, start and score of every row; a score that isn't a number is an error."""
    score = dot_with(query, F.col("embedding"))
    score = F.round(score, digits) if digits is not None else score
    rows = index.select("chunk_idx", "vod_id", F.col("start").cast("double").alias("start"), score.alias("score"))
    return rows.withColumn("score", F.when(F.isnan("score"), F.raise_error(F.lit("a score is not a number")).cast("double")).otherwise(F.col("score")))


def suppressed(rows: DataFrame, gap: float = GAP) -> DataFrame:
    """The rows (vod_id, chunk_idx, start, score) that remain when each video is walked from its best row down."""
    item = F.struct((-F.col("score")).alias("low"), F.col("chunk_idx").alias("idx"), F.col("start").alias("at"))
    walked = rows.groupBy("vod_id").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    kind = dict(walked.dtypes)["xs"]
    keep = F.aggregate("xs", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["at"] - x["at"]) < gap), acc).otherwise(F.array_append(acc, x)))
    return walked.select("vod_id", F.inline(keep)).select(F.col("idx").alias("chunk_idx"), "vod_id", F.col("at").alias("start"), (-F.col("low")).alias("score"))


def search(index: DataFrame, query: list[float], k: int = TOP_K, min_p: float = MIN_P, gap: float = GAP, digits: int | None = None) -> DataFrame:
    """rank (from 0), chunk_idx, vod_id, start, score. k = 0 means no limit. An empty index gives no rows.

    Only ids, times and scores move; join the result back for texts. With a limit, each step down to
    it is a distributed top-k; without one the ranks come from a range-partitioned sort.
    """
    rows = scored(index, query, digits)
    above = suppressed(rows.filter(F.col("score") >= min_p), gap)
    order = [F.desc("score"), F.asc("chunk_idx")]
    if k:
        above = above.orderBy(*order).limit(k)
    above = written(above, "kept")  # at most k rows, or all that pass min_p
    best = above
    if not k or above.count() < k:
        near = above.select(F.col("vod_id").alias("kept_vod"), F.col("start").alias("kept_start"))
        clear = rows.filter(F.col("score") < min_p).join(near, (F.col("vod_id") == F.col("kept_vod")) & (F.abs(F.col("start") - F.col("kept_start")) < gap), "left_anti")
        best = above.unionByName(clear.orderBy(*order).limit(1))
    if k:
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select("rank", "chunk_idx", "vod_id", "start", "score")
    return globally_ranked(best, order).select(F.col("rank").cast("int").alias("rank"), "chunk_idx", "vod_id", "start", "score")


def video_link(vod_id: Column, start: Column) -> Column:
    """The address of a moment: whole seconds, never below 0 nor above 2^32 - 1."""
    seconds = F.when(F.isnan(start), F.lit(0)).otherwise(F.least(F.greatest(F.floor(start), F.lit(0)), F.lit(4294967295)))
    return F.concat(F.lit(LINK), vod_id, F.lit("&t="), seconds.cast("string"))


def presented(result: DataFrame, index: DataFrame) -> DataFrame:
    """rank, score to three digits, url and text of a result, whose rows are few beside the index."""
    texts = index.select("chunk_idx", "text")
    return result.join(texts, "chunk_idx").select("rank", F.format_string("%.3f", "score").alias("score"), video_link(F.col("vod_id"), F.col("start")).alias("url"), "text").orderBy("rank")
