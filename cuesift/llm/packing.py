"""Packing along a space-filling curve.

A document's ids are hashed into a vector, its direction is projected to a few dimensions, and the
cell there gives a Hilbert key. Documents are range-sorted by (key, id), and each range is cut into
sequences of 1024 along the curve, so a sequence holds neighbouring documents. What is left at a
range's end is cut at powers of two, which need no padding; nothing depends on a global running
sum, and copies of one text, which share a key, are spread over ranges by their ids. The ranges' number and bounds follow
from the documents alone (their bytes, and a sample drawn by hashes of their keys), so the same documents give the same
pieces in every run, whatever parts they come in.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import pick, written
from .tokens import byte_bpe
from .words import release

LENGTH, EOD = 1024, 0
DIMS, BITS, BUCKETS = 4, 10, 4096
#: Bytes of packed ids a range: SMALL up to MANY ranges, then more up to RANGE_BYTES; the most ranges, and sampled keys for each.
SMALL, MANY, RANGE_BYTES, MOST_RANGES, KEYS = 4 << 20, 4096, 256 << 20, 50_000, 20
ENCODED = "struct<curve: long, ids: binary>"
PIECES = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def projection(dims: int = DIMS, buckets: int = BUCKETS, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (buckets, dims))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (n, dims), by transposing (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def cell(ids: np.ndarray, plane: np.ndarray, bits: int = BITS) -> list[int]:
    """The cell of a document's hashed, normalised and projected vector; an empty one lies in the middle."""
    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(len(plane) - 1).bit_length())
    vector = np.bincount(hashed.astype(np.int64), minlength=len(plane)).astype(float)
    norm = max(1.0, math.sqrt(float(vector @ vector)))
    return [min((1 << bits) - 1, int((1 << bits) * 0.5 * (1 + math.erf(a / norm / math.sqrt(2))))) for a in (vector @ plane).tolist()]


def encoder(path: str, eod: int) -> object:
    """A column function: text to its curve key and ids (with the end mark, packed as 16 or 32 bits)."""

    @arrow_udf(ENCODED)
    def encode(texts: pa.Array) -> pa.Array:
        t, plane, cells, packed = byte_bpe(path), projection(), [], []
        for x in texts:
            ids = np.frombuffer(t.encode(x.as_py()), np.uint32)
            cells.append(cell(ids, plane))
            ids = np.append(ids, np.uint32(eod))
            packed.append(b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes())
        keys = hilbert_keys(np.array(cells, np.int64).reshape(len(cells), plane.shape[1]))
        out = pa.StructArray.from_arrays([pa.array(keys), pa.array(packed, pa.binary())], names=["curve", "ids"])
        del packed
        release()
        return out

    return encode


class Packer:
    """Cuts a stream of documents into sequences; a sequence's pieces come out when it is full."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.open: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.fill = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: object, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.length - self.fill, len(ids) - at)
            self.open.append((doc, at, ids[at : at + take], len(ids)))
            self.fill += take
            at += take
            if self.fill == self.length:
                self._close(self.open)
                self.open, self.fill = [], 0

    def end(self) -> None:
        """Cuts the rest at powers of two, the largest first."""
        rest, self.open = self.open, []
        while rest:
            room, pieces = 1 << (sum(len(p[2]) for p in rest).bit_length() - 1), []
            while room:
                doc, start, ids, total = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                    ids = ids[:room]
                pieces.append((doc, start, ids, total))
                room -= len(ids)
            self._close(pieces)
        self.fill = 0


def range_bounds(encoded: DataFrame) -> list[tuple]:
    """Where the ranges part: keys (curve, doc_id) that cut the documents' bytes in about equal ranges.

    The keys come from a sample by hash, at most about KEYS a range, each with the weight of its bytes.
    """
    size = F.octet_length("ids")
    total, count = encoded.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    ranges = min(MOST_RANGES, -(-total // min(max(total // MANY, SMALL), RANGE_BYTES)))
    if ranges < 2:
        return []
    share = KEYS * ranges / count
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(11), "curve", "doc_id"), 11) / float(1 << 53) < share
    keys = sorted(((r["curve"], (r["doc_id"] is not None, 0 if r["doc_id"] is None else r["doc_id"])), r["size"]) for r in encoded.filter(drawn).select("curve", "doc_id", size.alias("size")).collect())
    if not keys:
        return []
    sums = np.cumsum([s for _, s in keys])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, ranges) / ranges)
    return sorted({keys[i][0] for i in at.tolist()})


def pack(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, eod: int = EOD) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document is its ids and the end mark; each id lies in exactly one piece, and no sequence
    needs padding if length is a power of two (else a range's last ones may). A null or empty
    text is the end mark alone; a very long one is tokenised whole by one task and cut into many pieces; null ids sort first;
    repeated rows are packed each on its own; an empty table gives no pieces. Other columns are left out, also where
    their names differ only by case. The ids are written once to the shared
    folder, so finding the ranges doesn't tokenise again, and a lost executor costs only what it
    was cutting. sequence_id is the range's number times 2^32 plus the place in it.
    """
    two = pick(df, [key, text]).toDF("doc_id", "text")
    kind = two.schema["doc_id"].dataType
    encoded = two.select("doc_id", encoder(tokenizer_path, eod)(F.coalesce("text", F.lit(""))).alias("e")).select("doc_id", "e.curve", "e.ids")
    encoded = written(encoded, "ids")
    bounds = df.sparkSession.sparkContext.broadcast(range_bounds(encoded))

    @arrow_udf("int")
    def range_of(curves: pa.Array, docs: pa.Array) -> pa.Array:
        keys = zip(curves.to_pylist(), docs.to_pylist())
        return pa.array([bisect_right(bounds.value, (c, (d is not None, 0 if d is None else d))) for c, d in keys], pa.int32())

    ranged = encoded.withColumn("range", range_of("curve", "doc_id")) if bounds.value else encoded.withColumn("range", F.lit(0))
    ranged = ranged.repartitionById(len(bounds.value) + 1, F.col("range")).sortWithinPartitions("range", "curve", "doc_id", "ids")
    fields = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now, doc_type = None, None, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.out))
            packer.out = []
            return pa.record_batch([pa.array(columns[0], doc_type), *[pa.array(c, f.type) for c, f in zip(columns[1:], fields)]], names=["doc_id", *fields.names])

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for at, doc, ids in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if at != now:
                    if packer is not None:
                        packer.end()
                        if packer.out:
                            yield flush()
                    packer, now = Packer(length, at << 32), at
                raw = ids.as_buffer()
                wide = raw[0] == 4
                packer.add(doc, np.frombuffer(raw, "<u4" if wide else "<u2", offset=1))
                if len(packer.out) >= 4096:
                    yield flush()
        if packer is not None:
            packer.end()
            if packer.out:
                yield flush()
        release()

    return ranged.select("range", "doc_id", "ids").mapInArrow(cut, PIECES.format(kind.simpleString()))
