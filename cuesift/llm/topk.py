"""Exact top-k by inner product with vector-approximation files.

The index is two files: a table of cells (one byte a component; the cells' width is a power of two for
each vector and stored with it), and the exact vectors, packed one after the other, which are read one by one
where the cells ask for it. A search has three steps:

1. All cells are scanned once; each task takes the blocks of queries from the shared folder, one after the other. The cells
   bound every score from below and above; a row stays a candidate of a query while its upper bound reaches the k-th best
   lower bound that the task has seen.
2. The k-th best lower bound of all tasks turns away most of these.
3. Each query's candidates are read in the order of their upper bounds until no unread vector can enter the k best.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..files import located, open_output, read_bytes, write_bytes
from .common import pick, scratch, written

SCALE = 1024
#: So many queries are held by a task at once; so many rows' cells are bounded at a time.
QUERY_BLOCK, ROW_BLOCK = 1024, 2048
#: Lower bounds that a task remembers from batch to batch, and files that it keeps open.
REMEMBERED, OPEN_FILES = 1 << 22, 64
_SAFE = 1 << 53


def integer_vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part (no nulls, all components finite, also 1024-fold), and floor(1024 * x) of each of these."""
    ok = np.zeros(len(column), bool)
    out = []
    for i, v in enumerate(column):
        if not v.is_valid or v.values.null_count:
            continue
        x = np.asarray(v.values).astype(np.float64)
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * x)
        if np.isfinite(x).all():
            ok[i] = True
            out.append(x)
    return ok, out


def product(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; scores beyond 64 bits stay at the nearest long."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if float(np.abs(rows).max()) * float(np.abs(query).max(initial=0)) * len(query) < _SAFE:
        return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([min(max(sum(int(a) * b for a, b in zip(r, q)), -(1 << 63)), (1 << 63) - 1) for r in rows], np.int64)


def packed(v: np.ndarray) -> bytes:
    """An integer vector in the fewest bytes a component, behind one byte that says how many (8: as doubles)."""
    top = float(np.abs(v).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind[-1].encode() + v.astype(kind).tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Packed vectors of one length as the rows of a matrix."""
    kinds = {r[0] for r in rows}
    if len(kinds) == 1:
        return np.frombuffer(b"".join(r[1:] for r in rows), f"<{'f' if kinds == {56} else 'i'}{chr(*kinds)}").reshape(len(rows), -1).astype(np.float64)
    return np.stack([unpacked([r])[0] for r in rows])


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The table of cells, written to the shared folder: vec_id, dims, width, cells, and where the exact vector lies (file, at, size).

    Every row is indexed but those whose vector is null or holds a null or non-finite component. Rows
    with a null id are left out. Other columns are too, also where their names differ only by case. An empty table gives an
    empty index. Each task writes one file of exact vectors; what a lost task has written is in no row.
    """
    two = pick(df, [key, vector]).toDF("vec_id", "v").filter("vec_id is not null")
    folder = scratch(df.sparkSession, "exact")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out, end = f"{folder}/{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            ok, vectors = integer_vectors(batch.column("v"))
            if not vectors:
                continue
            out = out or open_output(file)
            tops = np.maximum([float(np.abs(v).max(initial=0)) for v in vectors], 127)
            widths = np.exp2(np.ceil(np.log2(tops / 127)))
            raw = [packed(v) for v in vectors]
            sizes = np.array([len(r) for r in raw])
            out.write(b"".join(raw))
            columns = [
                batch.column("vec_id").filter(pa.array(ok)),
                pa.array([len(v) for v in vectors], pa.int32()),
                pa.array(widths, pa.float64()),
                pa.array([np.floor(v / w).astype(np.int8).tobytes() for v, w in zip(vectors, widths)], pa.binary()),
                pa.array([file] * len(vectors)),
                pa.array(end + np.cumsum(sizes) - sizes, pa.int64()),
                pa.array(sizes, pa.int32()),
            ]
            end += int(sizes.sum())
            yield pa.record_batch(columns, names=["vec_id", "dims", "width", "cells", "file", "at", "size"])
        if out:
            out.close()

    kind = two.schema["vec_id"].dataType.simpleString()
    return written(two.mapInArrow(cells, f"vec_id {kind}, dims int, width double, cells binary, file string, at long, size int"), "cells")


def query_blocks(queries: DataFrame, key: str, vector: str, block: int) -> list[str]:
    """The queries in files of the shared folder, at most ``block`` in each; their names. Queries without a proper vector are in none."""
    asked = pick(queries, [key, vector]).toDF("id", "v").filter("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    folder = scratch(queries.sparkSession, "queries")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, vectors = integer_vectors(batch.column("v"))
            ids = batch.column("id").filter(pa.array(ok))
            for a in range(0, len(vectors), block):
                part = pa.record_batch([ids.slice(a, block), pa.array([v for v in vectors[a : a + block]], pa.list_(pa.float64()))], names=["id", "v"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part)
                name = f"{folder}/{uuid.uuid4().hex}"
                write_bytes(name, sink.getvalue().to_pybytes())
                yield pa.record_batch([pa.array([name])], names=["name"])

    return sorted(r["name"] for r in asked.mapInArrow(save, "name string").collect())  # a name for so many queries


def read_block(name: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """A block's ids and vectors."""
    with pa.ipc.open_stream(read_bytes(name)) as stream:
        part = stream.read_all().combine_chunks()
    return np.array(part.column("id").to_pylist()), [np.asarray(v.values) for v in part.column("v").combine_chunks()]


class Bounds:
    """One block of queries against rows of cells, with the k best lower bounds so far of each query."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int, low: np.ndarray | None = None):
        self.k, self.ids, self.dims = k, ids, np.array([len(v) for v in vectors])
        self.by_dims = {d: (np.flatnonzero(self.dims == d), np.stack([v for v in vectors if len(v) == d])) for d in set(self.dims.tolist())}
        self.low = np.full((len(ids), k), -np.inf) if low is None else low

    def candidates(self, ids: np.ndarray, cells: np.ndarray, width: float) -> tuple[np.ndarray, ...]:
        """Query numbers, row numbers, lower and upper bounds of what may be among the k best."""
        out = []
        which, stack = self.by_dims.get(cells.shape[1], (np.zeros(0, np.int64), None))
        if not len(which):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64))
        spare = (width - 1) * np.minimum(stack, 0).sum(1), (width - 1) * np.maximum(stack, 0).sum(1)
        for a in range(0, len(ids), ROW_BLOCK):
            middle = (cells[a : a + ROW_BLOCK].astype(np.float64) @ stack.T) * width
            lower, upper = middle + spare[0], middle + spare[1]
            lower -= np.abs(lower) * 1e-9 + 1  # rounding can't hide a row
            upper += np.abs(upper) * 1e-9 + 1
            own = ids[a : a + ROW_BLOCK, None] == self.ids[which][None, :]
            lower[own] = upper[own] = -np.inf
            best = np.concatenate([self.low[which].T, lower])
            best = np.partition(best, len(best) - self.k, axis=0)[len(best) - self.k :]
            self.low[which] = best.T
            row, query = np.nonzero((upper >= best.min(0)) & (upper > -np.inf))
            out.append((which[query], row + a, lower[row, query], upper[row, query]))
        return tuple(np.concatenate(x) for x in zip(*out))


class Exact:
    """Exact vectors by file and place; a few files stay open."""

    def __init__(self) -> None:
        self.open: OrderedDict = OrderedDict()

    def read(self, file: str, at: int, size: int) -> np.ndarray:
        if file not in self.open:
            files, path = located(file)
            self.open[file] = files.open_input_file(path)
            if len(self.open) > OPEN_FILES:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(file)
        return unpacked([self.open[file].read_at(size, at)])


def search(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK, reads: Accumulator | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of the index, all if there are fewer.

    A query's own row (the same id) is no candidate; ties go to the smaller id. Queries without a
    proper vector, and rows of another dimension than a query, take no part. Repeated queries are one
    (the least vector, should they differ); repeated index rows are ranked each on its own. No queries
    or no rows give no result. Neither the driver nor a task holds more than a block of queries at a time,
    beside REMEMBERED bounds. ``reads`` counts the exact vectors read.
    """
    spark = index.sparkSession
    kind = index.schema["vec_id"].dataType.simpleString()
    blocks = query_blocks(queries, key, vector, block)
    if not blocks:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[str, np.ndarray] = {}
        for batch in batches:
            ids, dims, widths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "dims", "width"))
            groups = []
            for d, w in sorted({*zip(dims.tolist(), widths.tolist())}):
                at = np.flatnonzero((dims == d) & (widths == w))
                raw = b"".join(batch.column("cells").take(pa.array(at)).to_pylist())
                groups.append((at, np.frombuffer(raw, np.int8).reshape(len(at), d), w))
            for name in blocks:
                asked, vectors = read_block(name)
                bounds = Bounds(asked, vectors, k, low.get(name))
                for at, cells, w in groups:
                    query, row, lower, upper = bounds.candidates(ids[at], cells, w)
                    if len(query):
                        rows = pa.array(at[row])
                        there = [batch.column(c).take(rows) for c in ("vec_id", "file", "at", "size")]
                        numbers = [pa.array(query, pa.int32()), pa.array(lower), pa.array(upper)]
                        yield pa.record_batch([pa.array(asked[query]), pa.array([name] * len(query)), *numbers, *there], names=["query_id", "block", "query", "lower", "upper", "vec_id", "file", "at", "size"])
                if name in low or sum(x.size for x in low.values()) + bounds.low.size <= REMEMBERED:
                    low[name] = bounds.low

    columns = f"query_id {kind}, block string, query int, lower double, upper double, vec_id {kind}, file string, at long, size int"
    near = written(index.mapInArrow(scan, columns), "candidates")
    order = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    least = near.select("query_id", "lower").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).alias("least"))
    likely = near.join(least, "query_id").filter("least is null or upper >= least").drop("lower", "least")
    likely = likely.repartition("query_id").sortWithinPartitions("query_id", F.desc("upper"), "vec_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, held, now, best, over = Exact(), ("", []), None, [], False
        id_type, out = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.record_batch([pa.array(columns[0], id_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], id_type), pa.array(columns[3], pa.int64())], names=["query_id", "rank", "vec_id", "score"])

        def close() -> None:
            out.extend((now, n + 1, vec, -score) for n, (score, vec) in enumerate(best))

        for batch in batches:
            id_type = batch.schema.field("query_id").type
            for query_id, name, query, upper, vec, file, at, size in zip(*[batch.column(c).to_pylist() for c in ("query_id", "block", "query", "upper", "vec_id", "file", "at", "size")]):
                if query_id != now:
                    if now is not None:
                        close()
                    now, best, over = query_id, [], False
                if over or len(best) == k and upper < -best[-1][0]:
                    over = True  # all further ones of this query lie lower
                    continue
                if held[0] != name:
                    held = (name, read_block(name)[1])
                score = int(product(exact.read(file, at, size), held[1][query])[0])
                if reads is not None:
                    reads.add(1)
                best = sorted([*best, (-score, vec)])[:k]
            if len(out) >= 4096:
                yield flush()
        if now is not None:
            close()
        if out:
            yield flush()

    return likely.select("query_id", "block", "query", "upper", "vec_id", "file", "at", "size").mapInArrow(read, f"query_id {kind}, rank int, vec_id {kind}, score long")
