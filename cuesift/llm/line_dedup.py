"""Line dedup across documents, with DataFrame functions only.

Lines are exploded, normalised and hashed once, distinct documents are counted per hash, lines over the
threshold go (one document keeps its own), and the rest is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tensor import bound
from .common import BLANKS, ascii_lower, numbered, unclashed, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Lists of dropped places go to the texts by broadcast up to so many texts and places (8 bytes and less each).
BROADCAST_TEXTS, BROADCAST_PLACES = 500_000, 4_000_000


def without(lines: Column, places: Column) -> Column:
    """The lines but those at some places (sorted, from 1): the runs between them, each copied once.

    Linear where the lines are bound within one expression; an array column would be decoded anew for each run.
    """
    cuts = F.concat(F.array(F.lit(0)), places, F.array(F.size(lines) + 1))
    run = lambda c: lambda k: F.slice(lines, F.get(c, k) + 1, F.get(c, k + 1) - F.get(c, k) - 1)
    return bound(cuts, lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 2), run(c))))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """df with text without its repeated lines, and n_lines, n_dropped.

    A line's key is the line without blanks at its ends, A-Z in lower case, held as 128 bits. Keys of at least min_chars
    code points that occur in at least min_docs documents stay only in the document with the largest
    id. Every line is hashed once, into a table of the shared folder, and distinct documents are counted there
    (combined before the shuffle, so a hot line is one row a task and document; its documents' rows in the join
    behind it are split as any skewed side of a join is). What comes back to the texts is the places of their dropped
    lines, by document id and hash of the text: no line's documents are ever gathered in one place, and
    texts stay where they are while the lists are few enough to broadcast.

    A null or empty text is one empty line and comes out as ''. Null ids count as one document below
    all others. Rows that repeat an id are one document: they count once and lose the same lines,
    whether their texts are equal or not. A very long text is one task's work at a time, in proportion to its
    length, however many of its lines go. An empty table gives an empty one. Input columns n_lines and
    n_dropped come out as <name>_in; every other column passes.
    """
    rows, own = numbered(df)
    id_, body = F.col(f"in_{own.index(key)}"), f"in_{own.index(text)}"
    whole = F.coalesce(F.col(body), F.lit(""))
    name, lines = F.xxhash64(whole), F.split(whole, "\n", -1)
    named = rows.select(id_.alias("id"), name.alias("name"), whole.alias("whole"))  # one hash a text, not one a line
    every = named.select("id", "name", F.posexplode(F.split("whole", "\n", -1)).alias("place", "line")).withColumn("k", F.trim("line", F.lit(BLANKS)))
    keyed = every.filter(F.length("k") >= min_chars).withColumn("k", ascii_lower(F.col("k")))
    held = written(keyed.select("id", "name", (F.col("place") + 1).alias("place"), F.xxhash64("k").alias("a"), F.xxhash64(F.lit(7), "k").alias("b")), "lines")
    counted = held.select("a", "b", "id").distinct().groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs)
    gone = held.join(counted, ["a", "b"]).filter(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id", "name").agg(F.sort_array(F.collect_set("place")).alias("places"))
    gone = written(gone, "places")
    texts, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    side = F.broadcast(gone) if texts <= BROADCAST_TEXTS and places <= BROADCAST_PLACES else gone
    met = rows.withColumn("name", name).join(side.toDF("gone_id", "gone_name", "places"), (F.col("name") == F.col("gone_name")) & id_.eqNullSafe(F.col("gone_id")), "left")
    kept = F.when(F.col("places").isNull(), whole).otherwise(bound(lines, lambda every: F.array_join(without(every, F.col("places")), "\n")))
    # An id, not known before it runs, keeps the text from being worked out again by a filter on it, or within a Python function.
    kept = F.coalesce(F.when(F.monotonically_increasing_id() >= 0, kept), F.lit(""))
    out = [kept.alias(c) if c == body else F.col(c) for c in rows.columns]
    dropped = F.when(F.col("places").isNull(), F.lit(0)).otherwise(F.size("places")).cast("long")
    added = ["n_lines", "n_dropped"]
    breaks = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))
    return met.select(*out, (breaks + 1).cast("long").alias("n_lines"), dropped.alias("n_dropped")).toDF(*unclashed(own, added), *added)
