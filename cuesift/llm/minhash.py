"""Near-duplicates of documents by MinHash, with every link confirmed on full shingle sets.

1. Each text becomes its set of 5-word shingles, 160 universal-hash minima, and 32 band keys. Texts with
   the same set form a class, so copies go on as one representative.
2. Representatives that share a band key are candidates. Only (member, smallest member) leaves a
   bucket, so a bucket of m members gives m edges; their connected components are the clusters.
3. A cluster's texts meet in blocks of bounded size: signatures are compared, likely pairs are
   confirmed on their full sets, and pairs that are connected already are passed over. Clusters larger
   than a block are cut along their buckets' smallest members, each block getting that member too.
4. Where a bucket still spans several blocks and several components, those blocks' members
   of the bucket meet in pairs of blocks. So no pair that shares a bucket goes unexamined.
5. Components come from alternating large-star and small-star over the confirmed links.

Nothing of this is gathered on the driver but counts. Words and shingles are compared by 64-bit
hashes, classes by 128 bits. A pair at similarity 0.85 shares no band with a chance of 7e-9, one at 0.80
with 3e-6; the signature test turns away a true pair with a chance below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import pick, written
from .decontam import slices
from .words import NON_BLANK, column_bytes, gram_hashes, mix, release, word_hashes

SHINGLE, BANDS, ROWS = 5, 32, 5
#: A block holds about so many texts, and shingles, at most.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 4_000_000
#: So far below the threshold an estimated similarity may lie and still be looked at: over five standard errors.
MARGIN = 0.16
#: Up to so many ids (16 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 500_000
FACTOR, BAND_FACTOR = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
SKETCH = "struct<n: long, fa: long, fb: long, bands: array<long>>"
_U = np.uint64


def coefficients(count: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, count, dtype=_U) * _U(2) + _U(1), rng.integers(0, 1 << 63, count, dtype=_U) * _U(2)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; one shingle if it has fewer words than that, none without words."""
    for piece in slices(texts):
        words, at = word_hashes(*column_bytes(piece), NON_BLANK)
        grams = gram_hashes(words, SHINGLE, FACTOR)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= SHINGLE:
                yield np.unique(grams[a : b - SHINGLE + 1])
            elif b > a:
                yield gram_hashes(np.append(words[a:b], _U(b - a)), int(b - a) + 1, BAND_FACTOR)
            else:
                yield np.zeros(0, _U)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash a * x + b mod 2^64 over the set."""
    least = np.full(len(a), np.iinfo(_U).max, _U)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (a[:, None] * shingles[None, i : i + 1024] + b[:, None]).min(1), out=least)
    return least


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = signatures.shape
    grid = mix(signatures).reshape(n, k // rows, rows)
    keys = np.zeros((n, k // rows), _U)
    for r in range(rows):
        keys = mix(keys * _U(FACTOR) + grid[:, :, r])
    return mix(keys + np.arange(1, k // rows + 1, dtype=_U)[None, :] * _U(BAND_FACTOR))


def sketch(texts: pa.Array) -> pa.Array:
    """Set size, two order-free hashes of the set and the band keys (none for an empty set)."""
    a, b = coefficients()
    n, fa, fb, signatures = [], [], [], []
    for s in shingle_sets(texts):
        n.append(len(s))
        fa.append(int(mix(s ^ _U(FACTOR)).sum(dtype=_U)) - (1 << 63))
        fb.append(int(mix(s + _U(BAND_FACTOR)).sum(dtype=_U)) - (1 << 63))
        signatures.append(signature(s, a, b))
    keys = band_keys(np.array(signatures, _U).reshape(len(n), len(a))).view(np.int64)
    some = np.array(n, np.int64) > 0
    ends = np.r_[0, np.cumsum(some * keys.shape[1])].astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].reshape(-1)))
    del signatures, keys
    release()
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), bands], names=["n", "fa", "fb", "bands"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def links_among(ids: list, texts: list[str], sides: list[int], groups: list, percent: int) -> list[tuple]:
    """Confirmed links within one block, or between the two sides of a pair of blocks, that connect what wasn't connected."""
    a, b = coefficients()
    sets = list(shingle_sets(pa.array(texts, pa.large_string())))
    signs = np.array([signature(s, a, b) for s in sets], _U).reshape(len(ids), len(a))
    sizes, side = np.array([len(s) for s in sets]), np.array(sides)
    root: dict = {}

    def find(x: object) -> object:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    least, found = (percent / 100 - MARGIN) * len(a), []
    pairwise = len(set(sides)) > 1
    for i in range(len(ids)):
        if not sizes[i]:
            continue
        rest = slice(i + 1, None)
        near = ((signs[rest] == signs[i]).sum(1) >= least) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if pairwise:
            near &= side[rest] != side[i]
        for j in np.flatnonzero(near) + i + 1:
            u, v = find(groups[i]), find(groups[j])
            if u != v and linked(sets[i], sets[j], percent):
                root[max(u, v)] = min(u, v)
                found.append((ids[i], ids[j]))
    return found


def confirmed(units: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) in all units. units: unit, id, side, grp; docs: doc_id, text. A unit is one task's work at a time."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = units.select("id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        texts = docs.join(F.broadcast(wanted), docs["doc_id"] == wanted["id"]).select("id", "text")
    else:
        texts = docs.join(wanted, docs["doc_id"] == wanted["id"]).select("id", "text")
    rows = units.join(texts, "id").repartition("unit").sortWithinPartitions("unit", "id").select("unit", "id", "side", "grp", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, id_type = None, [], None

        def close() -> pa.RecordBatch | None:
            found = links_among(*map(list, zip(*held)), percent) if len(held) > 1 else []
            return pa.record_batch([pa.array([x for x, _ in found], id_type), pa.array([y for _, y in found], id_type)], names=["a", "b"]) if found else None

        for batch in batches:
            id_type = batch.schema.field("id").type
            for values in zip(*batch.columns):
                unit, doc, side, group, text = (v.as_py() for v in values)
                if unit != now:
                    if (out := close()) is not None:
                        yield out
                    now, held = unit, []
                held.append((doc, text, side, group))
        if held and (out := close()) is not None:
            yield out
        held.clear()
        release()

    return rows.mapInArrow(work, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """id, comp for every id in links (a, b): the smallest id it reaches, by alternating large-star and small-star.

    Each round is written to the shared folder. Stars are built by a combined minimum and a join, never
    by gathering neighbours.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(mark) == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(edges.select("b", "b").distinct())
        before = tuple(mark)
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).filter("a <> b").distinct()
        edges = written(small, "edges")


def parts(count: Column, shingles: Column, docs: int, most: int) -> Column:
    return F.greatest(F.ceil(count / docs), F.ceil(shingles / most), F.lit(1)).cast("long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id (the smallest id reachable), kept.

    Links join texts with 100 * intersection >= percent * union of their shingle sets. A null or
    empty text, or one without words, has no shingles and is its own component; so is a row with a
    null id (its component is null, and it is kept). A text of fewer than five words is one shingle. Rows
    that repeat an id and a text come out alike; where they repeat an id with other texts, each
    follows its own text. An empty table gives an empty one; other columns are left out.
    """
    docs = pick(df, [key, text]).toDF("doc_id", "text")
    sketches = written(docs.select("doc_id", arrow_udf(SKETCH)(sketch)(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*"), "sketches")
    classes = sketches.filter("n > 0 and doc_id is not null").groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    docs = docs.filter("doc_id is not null and text is not null")

    keys = classes.select("rep", "n", F.explode("bands").alias("band"))
    hubs = keys.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).filter("m > 1").drop("m")
    members = written(keys.join(hubs, "band"), "members")
    cluster = components(members.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    family = members.groupBy("rep").agg(F.min("hub").alias("fam"), F.first("n").alias("n")).join(cluster.withColumnRenamed("id", "rep"), "rep")
    per_cluster = family.groupBy("comp").agg(parts(F.count("*"), F.sum("n"), block_docs, block_shingles).alias("blocks"))
    per_family = family.groupBy("comp", "fam").agg(parts(F.count("*"), F.sum("n"), block_docs, block_shingles).alias("subs"))
    placed = family.join(per_cluster, "comp").join(per_family, ["comp", "fam"])
    block = F.when(F.col("blocks") == 1, F.xxhash64("comp")).when(F.col("subs") > 1, F.xxhash64("comp", "fam", F.pmod(F.xxhash64("rep"), "subs"))).otherwise(F.xxhash64("comp", F.pmod(F.xxhash64("fam"), "blocks")))
    placed = written(placed.select("rep", "fam", block.alias("block"), (F.col("blocks") > 1).alias("cut")), "blocks")
    first = placed.select(F.col("block").alias("unit"), F.inline(F.array(F.struct(F.col("rep").alias("id")), F.struct(F.col("fam").alias("id"))))).distinct()
    links = written(confirmed(first.select("unit", "id", F.lit(0).alias("side"), F.col("id").alias("grp")), docs, percent), "links")
    found = written(components(links), "found")

    if placed.filter("cut").limit(1).count():
        across = members.join(placed.filter("cut").select("rep", "block"), "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", "block", F.coalesce("comp", "rep").alias("comp"))
        across = written(across, "across")
        ends = across.groupBy("band", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        held = ends.groupBy("band").agg(F.count("*").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set(F.struct("block", "lo", "hi")).alias("bs")).filter("k > 1 and lo <> hi")
        pair = held.select("band", F.explode("bs").alias("x"), "bs").select("band", "x", F.explode("bs").alias("y")).filter("x.block < y.block and not (x.lo = y.lo and x.hi = y.hi and x.lo = x.hi)")
        sides = pair.select("band", F.xxhash64("x.block", "y.block").alias("unit"), F.inline(F.array(F.struct(F.col("x.block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y.block").alias("block"), F.lit(1).alias("side")))))
        second = across.join(sides, ["band", "block"]).select("unit", F.col("rep").alias("id"), "side", F.col("comp").alias("grp")).distinct()
        links = links.union(confirmed(second, docs, percent))
        found = written(components(links), "found")

    moved = classes.join(found, classes["rep"] == found["id"], "left").filter("copies > 1 or comp is not null").select("fa", "fb", F.coalesce("comp", "rep").alias("comp"))
    out = sketches.drop("bands").join(moved, ["fa", "fb"], "left")
    comp = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), comp.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """df without the documents that aren't their component's smallest id; columns and the rest stay as they are."""
    gone = written(near_duplicates(df, key, text, percent).filter("not kept").select(F.col("doc_id").alias("gone_id")), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    own = df.columns
    tidy = df.toDF(*[f"in_{i}" for i in range(len(own))])
    return tidy.join(side, F.col(f"in_{own.index(key)}") == F.col("gone_id"), "left_anti").toDF(*own)
