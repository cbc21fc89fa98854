"""Sliding windows anchored at each key's first row.

Window k begins where adding the stride k times to the first time leads, in floating point; a window
takes rows from its begin up to, but without, begin + size. Its start and end are the times of its
first and last rows; empty windows don't come out, the short ones at the end do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.captions import Word, chunk_words
from ..functions.tensor import bound
from ..shared import written

#: Up to so many windows a row, their begins are written out as columns.
UNROLLED = 32


def walked(first: Column, stride: float, most: Column, last: Column) -> Column:
    """Struct (k, at): the last of the begins ``first``, ``first + stride``, ... with k <= most and at <= last, and k = 0 at the least.

    It is what adding the stride again and again gives, without as many steps: between two powers of two all
    sums are rounded to the same grid, so from the third on each is as far from the one before (the second
    settles ties), and that many are taken at once. A round is three additions and such a leap, or one
    addition near an end; a power of two is passed in three rounds at most. Begins that don't move are an error.
    """
    far = lambda x: F.log2(F.greatest(F.abs(x), F.lit(stride)))
    end = F.least(last, first + most * F.lit(stride))
    powers = F.when((first < 0) & (end > 0), far(first) + far(end) - 2 * math.log2(stride)).otherwise(F.abs(far(end) - far(first)))
    rounds = F.greatest(F.lit(1.0), F.least(3 * powers + 12, 2 * (end - first) / stride + 4, F.lit(1e4))).cast("int")
    endless = F.raise_error(F.lit("windows would never end")).cast("double")

    def leap(k: Column, y: Column, z: Column, w: Column) -> Column:
        d = F.when(w > z, w - z).otherwise(endless)
        level = lambda x, size: (F.abs(x) >= size) & (F.abs(x) < 2 * size) & ((x > 0) == (w > 0))
        room = lambda size: F.when(level(w, size) & level(y, size) & level(z, size), F.when(w > 0, 2 * size - w).otherwise(-w - size)).otherwise(0.0)
        steps = lambda size: F.greatest(F.lit(0), F.least(most - k - 3, F.floor(F.least(room(size), last - w) / d) - 1))
        moved = lambda m: F.struct((k + 3 + m).alias("k"), (w + m * d).alias("at"), F.lit(False).alias("done"))
        return bound(bound(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(w)))), steps), moved)

    def step(acc: Column) -> Column:
        y, z, w = acc["at"] + stride, acc["at"] + stride + stride, acc["at"] + stride + stride + stride
        one = F.when((acc["k"] < most) & (y <= last), F.struct((acc["k"] + 1).alias("k"), y.alias("at"), F.lit(False).alias("done"))).otherwise(F.struct(acc["k"].alias("k"), acc["at"].alias("at"), F.lit(True).alias("done")))
        return F.when((acc["k"] + 3 <= most) & (w <= last), leap(acc["k"], y, z, w)).otherwise(one)

    begun = F.struct(F.lit(0).cast("long").alias("k"), first.alias("at"), F.lit(False).alias("done"))
    out = F.aggregate(F.sequence(F.lit(1), rounds), begun, lambda acc, _: F.when(acc["done"], acc).otherwise(step(acc)))
    return bound(out, lambda x: F.struct(x["k"].alias("k"), F.when(x["done"], x["at"]).otherwise(endless).alias("at")))


def sliding_chunks(words: DataFrame, size: float, stride: float, key: str = "vod_id") -> DataFrame:
    """key, k, text, start, end from words (key, seq, text, t).

    Keys whose times never go back take the native way: each row works out the windows it may lie in from
    its key's first time alone (``walked``), so windows without rows are never made and nothing is joined. The
    others, and those with a time that isn't a number, are walked in their own order. Rows without a key are left out. Null times are an
    error, as are an infinite last time and a stride that isn't positive.
    """
    if not stride > 0:
        raise ValueError("the stride must be positive")
    in_order = Window.partitionBy(key).orderBy("seq")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = words.select(key, "seq", "text", F.coalesce(F.col("t").cast("double"), F.raise_error(F.lit("a word without a time")).cast("double")).alias("t"))
    rows = rows.withColumn("back", F.isnan("t") | F.coalesce(F.col("t") < F.lag("t").over(in_order), F.lit(False)))
    ended = F.when(F.last("t").over(whole) == float("inf"), F.raise_error(F.lit("windows would never end")).cast("double"))
    rows = rows.withColumns({"t0": F.coalesce(ended, F.first("t").over(whole)), "unsorted": F.max("back").over(whole)}).drop("back")
    rows = written(rows, "words").filter(F.col(key).isNotNull())  # read twice below
    t, forever = F.col("t"), F.lit(1 << 62)
    low = walked(F.col("t0"), stride, forever, t - size - 2 * stride)  # before the first window that may hold the row
    native = rows.filter("not unsorted").select(key, "seq", "text", "t", low.alias("low"))
    after = F.sequence(F.lit(0).cast("long"), walked(F.col("low.at"), stride, forever, t)["k"])
    begins = F.transform(after, lambda i: walked(F.col("low.at"), stride, i, F.lit(float("inf")))["at"])
    if size / stride <= UNROLLED:  # so few that they are written out
        few = [F.col("low.at")]
        for _ in range(math.ceil(max(size / stride, 0)) + 4):
            few.append(few[-1] + stride)
        begins = F.when(few[-1] > t, F.array(*few)).otherwise(begins)
    spread = native.select(key, "seq", "text", "t", F.col("low.k").alias("k0"), F.posexplode(begins).alias("i", "ws"))
    inside = spread.filter((t >= F.col("ws")) & (t < F.col("ws") + size)).withColumn("k", (F.col("k0") + F.col("i")).cast("int"))
    grouped = inside.groupBy(key, "k").agg(F.sort_array(F.collect_list(F.struct("seq", "t", "text"))).alias("w"))
    sorted_way = grouped.select(key, "k", F.array_join("w.text", " ").alias("text"), F.element_at("w", 1)["t"].alias("start"), F.element_at("w", -1)["t"].alias("end"))

    kind = dict(words.dtypes)[key]

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        found = numbered_chunks([Word(*w) for w in zip(part["text"], part["t"])], size, stride)
        return pd.DataFrame([(part[key].iloc[0], k, c.text, c.start, c.end) for k, c in found], columns=[key, "k", "text", "start", "end"])

    other = rows.filter("unsorted").select(key, "seq", "text", "t").groupBy(key).applyInPandas(walk, f"{key} {kind}, k int, text string, start double, end double")
    return sorted_way.unionByName(other)


def numbered_chunks(words: list[Word], size: float, stride: float) -> Iterator[tuple[int, object]]:
    """The chunks of words in order, each with its place among them."""
    yield from enumerate(chunk_words(words, "", size, stride))
