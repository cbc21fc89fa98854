"""Vector and matrix functions as array expressions, for columns of array<float> or array<double>. Sums run in double."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

ERF = (1.0614054, -1.4531521, 1.4214138, -0.28449672, 0.2548296)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def bound(value: Column, f: object) -> Column:
    """f(value) with value worked out once, also where f uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    """The inner product; as long as a (a shorter b gives null)."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def dot_with(vector: list[float], column: Column) -> Column:
    """Inner products with one given vector, in Arrow batches; another length is an error, a null vector gives null.

    Declared non-deterministic only so that a filter on the score doesn't run it a second time.
    """
    q = np.asarray(vector, np.float64)

    @arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        ok = np.asarray(rows.is_valid())
        sizes = np.asarray(rows.value_lengths().fill_null(len(q)))
        if (sizes != len(q)).any():
            raise ValueError(f"a vector of {int(sizes[sizes != len(q)][0])} components against a query of {len(q)}")
        flat = np.asarray(rows.flatten()).astype(np.float64).reshape(-1, len(q))
        out = np.full(len(rows), np.nan)
        out[ok] = flat @ q if len(q) else 0.0
        return pa.array(out, pa.float64(), mask=~ok)

    return run.asNondeterministic()(column)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def from_vec(flat: Column, rows: int, cols: int) -> Column:
    """A flat matrix of this shape; another number of values is an error."""
    wrong = F.raise_error(F.lit(f"the values don't make {rows} x {cols}"))
    return F.when(F.size(flat) == rows * cols, flat).otherwise(F.array(wrong.cast("double")))


def row(flat: Column, i: int, width: int) -> Column:
    """Row i of a matrix kept flat."""
    return F.slice(flat, i * width + 1, width)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


add_bias = add


def map_values(v: Column, f: object) -> Column:
    return F.transform(v, f)


def linear(v: Column, weight: list[list[float]], bias: list[float]) -> Column:
    """weight times v plus bias; weight has one row an output."""
    outputs = [dot(v, F.array(*[F.lit(float(x)) for x in w])) + float(b) for w, b in zip(weight, bias)]
    return F.array(*outputs)


def matmul_t(x: DataFrame, w: DataFrame) -> DataFrame:
    """(row, col, value) of X times W transposed, for matrices as (row, k, value); sums are combined before the shuffle."""
    a, b = x.toDF("row", "k", "x"), w.toDF("col", "k", "w")
    return a.join(b, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("w")).alias("value"))


def layer_norm(v: Column, gamma: Column, beta: Column, eps: float) -> Column:
    """(x - mean) / sqrt(variance + eps) * gamma + beta, with the variance of the whole."""
    centred = bound(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))

    def scaled(c: Column) -> Column:
        deviation = F.sqrt(dot(c, c) / F.size(c) + eps)
        return bound(deviation, lambda d: F.zip_with(F.zip_with(c, gamma, lambda x, g: x / d * g), beta, lambda x, b: x + b))

    return bound(centred, scaled)


def softmax(v: Column) -> Column:
    raised = bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top)))
    return bound(raised, lambda r: bound(total(r), lambda t: F.transform(r, lambda x: x / t)))


def erf(x: Column) -> Column:
    """The five-term approximation (absolute error below 1.5e-7); its sign at 0 is positive."""
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = F.lit(ERF[0])
    for c in ERF[1:]:
        poly = poly * t + c
    y = 1.0 - poly * t * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def gelu(x: Column) -> Column:
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2)))


def l2_normalize(v: Column) -> Column:
    return bound(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda norm: F.transform(v, lambda x: x / norm))


def half_to_float(bits: Column) -> Column:
    """A 16-bit pattern (as int) read as IEEE half precision."""
    bits = bits.cast("int")
    sign = F.when(bits.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    power, part = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    special = F.when(part == 0, sign * float("inf")).otherwise(float("nan"))
    normal = sign * F.pow(F.lit(2.0), (power - 25).cast("double")) * (part + 1024)
    return F.when(power == 31, special).when(power == 0, sign * part * 2.0**-24).otherwise(normal)


def bfloat_to_float(bits: Column) -> Column:
    """A 16-bit pattern (as int) read as bfloat16."""
    bits = bits.cast("int")
    sign = F.when(bits.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    power, part = F.shiftright(bits, 7).bitwiseAND(255), bits.bitwiseAND(127)
    special = F.when(part == 0, sign * float("inf")).otherwise(float("nan"))
    normal = sign * F.pow(F.lit(2.0), (power - 134).cast("double")) * (part + 128)
    return F.when(power == 255, special).when(power == 0, sign * part * 2.0**-133).otherwise(normal)


def div_up(a: Column, b: Column | int) -> Column:
    return F.ceil(a / b).cast("long")


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, pooled: the mean of each component over a key's vectors. Averages are combined before the shuffle."""
    means = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("m"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("pooled"))


#: Queries of one task's turn, and keys scored at a time.
QUERY_BLOCK, KEY_BLOCK = 2048, 1024


def _attended(scale: float) -> object:
    """Batches of (grp, block, role, id, v), each block's queries (role 0) before its keys (1), to (id, top, total, y).

    Keys are taken as they come: per query only the largest score, the sum of weights and the weighted sum are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, queries, state = None, [], [], None

        def done() -> pa.RecordBatch:
            top, total, y = state
            flat = pa.array((y / total[:, None]).reshape(-1), pa.float64())
            lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), flat)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(top), pa.array(total), lists], ["id", "top", "total", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            grp, block, role, key = (np.asarray(batch.column(i)) for i in range(4))
            v = np.asarray(batch.column(4).flatten()).astype(np.float64).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((np.diff(grp) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
                if (grp[a], block[a]) != now:
                    if state is not None:
                        yield done()
                    now, ids, queries, state = (grp[a], block[a]), [], [], None
                if role[a] == 0:
                    ids.append(key[a:b])
                    queries.append(v[a:b])
                    continue
                if not queries:
                    continue
                if state is None:
                    queries = [np.concatenate(queries)]
                    state = np.full(len(queries[0]), -np.inf), np.zeros(len(queries[0])), np.zeros_like(queries[0])
                for c in range(a, b, KEY_BLOCK):
                    keys = v[c : min(c + KEY_BLOCK, b)]
                    scores = queries[0] @ keys.T / scale
                    top = np.maximum(state[0], scores.max(1))
                    weights, shrink = np.exp(scores - top[:, None]), np.exp(state[0] - top)
                    state = top, state[1] * shrink + weights.sum(1), state[2] * shrink[:, None] + weights @ keys
        if state is not None:
            yield done()

    return run


def self_attention(df: DataFrame, key: str, group: str, vector: str, scale: float) -> DataFrame:
    """key (a long), y: every vector attends to all vectors of its group; softmax of inner products / scale, times the vectors.

    No pair is ever a row: a group's queries are dealt into blocks by a hash, and its keys pass by each block in
    Arrow batches. Rows without a group or a vector take no part; rows that repeat a key share one softmax.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(group).cast("long").alias("grp"), F.col(vector).alias("v")).filter("grp is not null and v is not null")
    sizes = rows.groupBy("grp").agg(div_up(F.count("*"), QUERY_BLOCK).alias("blocks"))
    rows = rows.join(sizes, "grp")
    order = ["grp", "block", "role", "id", "v"]
    queries = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("role", F.lit(0)).select(*order)
    keys = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("role", F.lit(1)).select(*order)
    dealt = queries.unionByName(keys).repartition("grp", "block").sortWithinPartitions("grp", "block", "role")
    parts = dealt.mapInArrow(_attended(scale), "id long, top double, total double, y array<double>")
    each = parts.groupBy("id").agg(F.collect_list(F.struct("top", "total", "y")).alias("each"))
    each = each.withColumn("top", F.array_max("each.top"))
    each = each.withColumn("each", F.transform("each", lambda r: F.struct((r["total"] * F.exp(r["top"] - F.col("top"))).alias("w"), r["y"].alias("y"))))
    each = each.withColumn("total", total(F.col("each.w")))
    none = F.transform(F.element_at("each", 1)["y"], lambda x: x * 0.0)
    y = F.aggregate("each", none, lambda a, r: F.zip_with(a, r["y"], lambda s, x: s + r["w"] / F.col("total") * x))
    return each.select(F.col("id").alias(key), y.alias("y"))
