"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest hashes of 5 words in each window of 10 words (6 of them), so
texts that share 10 words share a fingerprint. Documents' fingerprints are joined with the
benchmark's, and each hit is extended: the whole window is compared, and overlapping windows form
one span. Items of fewer words than a window are one window of their own length.

The benchmark is the stated query set: its index goes to the workers in blocks of bounded size. Up
to PASS_BLOCKS of them are scanned over the rows in place, so documents are neither shuffled nor
gathered. A larger benchmark takes several passes, each with as many blocks as that; their findings (only
of texts with hits) are kept in the shared folder and joined back by 128 bits of the text. Runs
of words are compared by 64-bit hashes of each word and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import numbered, pick, unclashed, written
from .words import ALNUM, column_bytes, gram_hashes, release, word_hashes

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text a block, and blocks that a worker holds at a time.
BLOCK_BYTES, PASS_BLOCKS = 16 << 20, 4
GRAM_FACTOR, WINDOW_FACTOR = 0x8F1BBCDC6ED9EBA1, 0xB5026F5AA96619E9
_LEAST = 1 << 13
RESULT = "struct<n_words: long, starts: array<int>, ends: array<int>, items: array<string>>"


class Index:
    """One block of the benchmark: per window length the sorted window hashes and the items of each; the fingerprints."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        words, at = word_hashes(*column_bytes(pa.array(texts, pa.large_string())), ALNUM)
        found: dict[int, tuple[list, list]] = {}
        marks = []
        for k, item in enumerate(ids):
            own = words[at[k] : at[k + 1]]
            if not len(own):
                continue
            n = min(window, len(own))
            hashes = gram_hashes(own, n, WINDOW_FACTOR)
            a, b = found.setdefault(n, ([], []))
            a.append(hashes)
            b.append(np.full(len(hashes), k))
            if n == window:
                marks.append(smallest(gram_hashes(own, gram, GRAM_FACTOR), window - gram + 1))
        self.ids = ids
        self.by_length = {}
        for n, (a, b) in found.items():
            pairs = np.unique(np.rec.fromarrays([np.concatenate(a), np.concatenate(b)], names="h,k"))
            hashes, begin = np.unique(pairs.h, return_index=True)
            self.by_length[n] = (hashes, np.append(begin, len(pairs)), np.ascontiguousarray(pairs.k))
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)

    def scan(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur in any item: their positions, their lengths, and their places in by_length."""
        ends = np.repeat(at[1:], np.diff(at))
        out = []
        for n, (hashes, _, _) in self.by_length.items():
            if len(words) < n:
                continue
            if n == self.window:
                low = smallest(gram_hashes(words, self.gram, GRAM_FACTOR), n - self.gram + 1)
                where = np.flatnonzero(member(low, self.marks))
            else:
                where = np.flatnonzero(member(gram_hashes(words, n, WINDOW_FACTOR), hashes))
            where = where[where + n <= ends[where]]
            if len(where):
                full = gram_hashes(words[where[:, None] + np.arange(n)].reshape(-1), n, WINDOW_FACTOR)[::n]
                place = np.searchsorted(hashes, full)
                same = (place < len(hashes)) & (hashes[np.minimum(place, len(hashes) - 1)] == full)
                out.append((where[same], np.full(int(same.sum()), n), place[same]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out))


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least hash of each run of width hashes."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, width):
        np.minimum(out, hashes[k : k + m], out=out)
    return out


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones; a bit table turns most away."""
    if not len(among):
        return np.zeros(len(values), bool)
    bits = max(_LEAST, 1 << int(16 * len(among) - 1).bit_length())
    table = np.zeros(bits, bool)
    mask = np.uint64(bits - 1)
    table[(among & mask).astype(np.int64)] = True
    out = table[(values & mask).astype(np.int64)]
    likely = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(among, values[likely]), len(among) - 1)
    out[likely] = among[place] == values[likely]
    return out


def find(texts: pa.Array, index: Index) -> list[dict]:
    """For each text its number of words, the merged hit spans and the items with occurring windows."""
    words, at = word_hashes(*column_bytes(texts), ALNUM)
    rows = [{"n_words": int(n), "starts": [], "ends": [], "items": []} for n in np.diff(at)]
    where, length, place = index.scan(words, at)
    if not len(where):
        return rows
    owner = np.searchsorted(at, where, "right") - 1
    order = np.lexsort((where, owner))
    where, length, place, owner = where[order], length[order], place[order], owner[order]
    cuts = np.append(np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner))
    for a, b in zip(cuts[:-1], cuts[1:]):
        d = owner[a]
        begin = where[a:b] - at[d]
        reach = np.maximum.accumulate(begin + length[a:b])
        new = np.r_[True, begin[1:] > reach[:-1]]
        last = np.append(np.flatnonzero(new)[1:], b - a) - 1
        items = set()
        for n in set(length[a:b].tolist()):
            _, begins, owners = index.by_length[n]
            for p in set(place[a:b][length[a:b] == n].tolist()):
                items.update(owners[begins[p] : begins[p + 1]].tolist())
        rows[d].update(starts=begin[new].tolist(), ends=reach[last].tolist(), items=sorted({index.ids[k] for k in items}))
    return rows


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[pa.Array]:
    """The column in pieces of about so many bytes; one text is never cut."""
    _, bounds = column_bytes(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield texts.slice(i, j - i)
        i = j


def _result_type() -> pa.DataType:
    return pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[tuple[list[str], list[str | None]]]:
    """The benchmark, fetched partition by partition, in blocks of at most so many bytes of text (or one item)."""
    ids, texts, held = [], [], 0
    for i, t in pick(benchmark, [item, text]).select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        size = len((t or "").encode()) + 64
        if ids and held + size > most:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append("null" if i is None else i)
        texts.append(t)
        held += size
    if ids:
        yield ids, texts


def scanner(indexes: list) -> object:
    """Several broadcast blocks as one column function of the text."""

    @arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for piece in slices(texts):
            per_block = [find(piece, b.value) for b in indexes]
            out += per_block[0] if len(per_block) == 1 else [merged(x) for x in zip(*per_block)]
        release()
        return pa.array(out, _result_type())

    return scan


def mark_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """df with n_words, hit_spans (word positions: start, end), item_ids (strings, sorted) and contaminated.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, without case of A-Z. A
    null or empty text has no words and is clean; so is any text where the benchmark is empty. An
    item without words is in no document; a null item id counts as 'null'; repeated items are one.
    Repeated rows are each marked. Input columns named like an added one come out as <name>_in.
    """
    context = df.sparkSession.sparkContext
    rows, own = numbered(df)
    body = F.coalesce(F.col(f"in_{own.index(text)}"), F.lit(""))
    held, later = [], []
    for ids, texts in blocks(benchmark, item, item_text, block_bytes):
        held.append(context.broadcast(Index(ids, texts)))
        if len(held) == pass_blocks:
            later.append(held)
            held = []
    passes = later + [held] * bool(held) or [[context.broadcast(Index([], []))]]
    marked = rows.withColumn("scan", scanner(passes[0])(body))
    if len(passes) > 1:
        name = lambda t: [F.xxhash64(t).alias("ta"), F.xxhash64(F.lit(1), t).alias("tb")]
        found = []
        for k, indexes in enumerate(passes[1:]):
            hits = rows.select(*name(body), scanner(indexes)(body).alias("scan")).filter(F.size("scan.starts") > 0).dropDuplicates(["ta", "tb"])
            found.append(written(hits, f"hits{k}"))
            for b in indexes:
                b.unpersist()
        more = found[0]
        for f in found[1:]:
            more = more.unionByName(f)
        more = more.groupBy("ta", "tb").agg(F.collect_list("scan").alias("more"))
        marked = marked.withColumns(dict(zip(("ta", "tb"), name(body)))).join(more, ["ta", "tb"], "left").withColumn("scan", _joined(F.col("scan"), F.coalesce("more", F.array().cast(f"array<{RESULT}>"))))
    added = ["n_words", "hit_spans", "item_ids", "contaminated"]
    spans = F.arrays_zip(F.col("scan.starts").alias("start"), F.col("scan.ends").alias("end"))
    return marked.select(*rows.columns, F.col("scan.n_words"), spans, F.col("scan.items"), F.size("scan.starts") > 0).toDF(*unclashed(own, added), *added)


def _joined(first: Column, more: Column) -> Column:
    """The findings of several passes over one text as one."""
    every = F.concat(F.array(first), more)
    spans = F.array_sort(F.flatten(F.transform(every, lambda s: F.arrays_zip(s["starts"].alias("s"), s["ends"].alias("e")))))
    pair = "array<struct<s: int, e: int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        wider = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"]), wider).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    whole = F.aggregate(spans, F.array().cast(pair), step)
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(every, lambda s: s["items"]))))
    return F.struct(first["n_words"].alias("n_words"), whole["s"].alias("starts"), whole["e"].alias("ends"), items.alias("items"))


def merged(found: tuple[dict, ...]) -> dict:
    """One text's findings from several blocks."""
    spans = sorted((s, e) for x in found for s, e in zip(x["starts"], x["ends"]))
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return {"n_words": found[0]["n_words"], "starts": [s for s, _ in out], "ends": [e for _, e in out], "items": sorted({i for x in found for i in x["items"]})}
