"""Repeated words collapsed with window functions: the single-word, single-pass part of ``functions.text.collapse``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import merge_punct, norm_token, ws_tokens


def collapse_words(df: DataFrame, key: str, text: str, keep: int = 3) -> DataFrame:
    """key, collapsed: runs of more than keep equal words (by norm; words without one are exempt) cut to keep.

    All within each row by array functions: islands are found by comparing neighbours, so no row is
    exploded or moved.
    """
    keep = max(keep, 1)
    base = df.select(key, ws_tokens(F.col(text)).alias("t")).withColumn("n", F.transform("t", norm_token))
    # begins[i]: the place (from 0) where the island of word i begins; ends likewise from behind.
    begin = F.transform("n", lambda x, i: F.when((i > 0) & (x != "") & (F.get("n", i - 1) == x), F.lit(None).cast("int")).otherwise(i))
    base = base.withColumn("starts", F.filter(begin, lambda x: x.isNotNull()))
    size = F.transform("starts", lambda s, i: F.struct(s.alias("s"), (F.coalesce(F.get("starts", i + 1), F.size("t")) - s).alias("len")))
    part = lambda r: F.slice("t", r["s"] + 1, F.when(r["len"] > keep, F.lit(keep)).otherwise(r["len"]))
    joined = lambda r: F.when(r["len"] > keep, F.concat(F.slice(part(r), F.lit(1), F.lit(keep - 1)), F.array(merge_punct(F.element_at(part(r), -1), F.element_at("t", r["s"] + r["len"]))))).otherwise(part(r))
    return base.withColumn("r", size).select(key, F.array_join(F.flatten(F.transform("r", joined)), " ").alias("collapsed"))
