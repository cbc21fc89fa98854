"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes: a node for every context of up to
``order`` bytes seen in training, with the counts of the bytes that followed. The code length of a text
under a language is exact PPM (escape method C, with exclusions) under these frozen counts; the
language with the shortest code wins. As the counts are frozen, what a byte costs depends only on
its deepest known context, so training works out one table of code lengths per node and byte, for
all languages side by side, and scoring a text is a walk down the tree and a look-up for each byte.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from .common import pick
from .words import column_bytes, release

ORDER = 3
#: Bounds of the training sample: about so many rows a language, none longer than so many bytes where shorter ones
#: are to be had; else so many whole texts.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES, WHOLE_TEXTS = 400, 1 << 16, 8
#: A context is kept if it was seen so often, and, the most frequent first, while the table of code lengths has at most so many entries.
LEAST, CELLS = 2, 1 << 24
#: Languages that share a tree at most, and trees whose tables a worker keeps; those of further trees are worked out anew for each batch.
GROUP, KEEP = 4, 3
RESULT = "struct<lang: string, score: double, bits_per_byte: double>"
UNKNOWN = "und"
STEP = 1 << 18
#: So many contexts' tables are worked out at a time.
NODES = 1024
_LETTER = regex.compile(r"\p{L}")


class Model:
    """Frozen statistics: the shared tree of contexts and, per language, the counts at its nodes."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER, least: int = LEAST):
        self.id = self.family = uuid.uuid4().hex
        self.whole = True  # no context seen often enough was left out for want of room
        self.languages = sorted(samples)
        self.order = order
        texts = {k: [t.encode() for t in v if t] for k, v in samples.items()}
        seen = sorted(set().union(*[set(b"".join(v)) for v in texts.values()] or [set()]))
        self.symbols = np.full(256, len(seen), np.int64)  # the last symbol stands for all bytes never seen
        self.symbols[seen] = np.arange(len(seen))
        self.width = w = len(seen) + 1
        self.parent, self.level = [np.zeros(1, np.int64)], [0, 1]
        # Per depth: the keys (parent node, byte further back) of its nodes, and each language's counts.
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        streams = {k: [self.symbols[np.frombuffer(t, np.uint8)] for t in v] for k, v in texts.items()}
        state = {k: [np.zeros(len(s), np.int64) for s in v] for k, v in streams.items()}
        for depth in range(order + 1):
            if depth:
                known = [np.concatenate([n[depth:] * w + s[:-depth] for n, s in zip(state[k], streams[k]) if len(s) > depth] or [np.zeros(0, np.int64)]) for k in self.languages]
                every = np.concatenate([x[x >= 0] for x in known] or [np.zeros(0, np.int64)])
                keys, times = np.unique(every, return_counts=True)
                base = self.level[-1]
                room = max(0, CELLS // (w * len(self.languages) or 1) - base)
                often = np.lexsort((keys, -times))[:room]
                self.whole &= room >= (times >= least).sum()
                keys = np.sort(keys[often][times[often] >= least])
                self.keys.append(keys)
                self.level.append(base + len(keys))
                for k in self.languages:
                    moved = []
                    for n, s in zip(state[k], streams[k]):
                        to = np.full(len(s), -(1 << 50), np.int64)
                        if len(s) > depth and len(keys):
                            key = n[depth:] * w + s[:-depth]
                            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                            to[depth:] = np.where(keys[place] == key, base + place, -(1 << 50))
                        moved.append(to)
                    state[k] = moved
            base, end = self.level[depth], self.level[depth + 1]
            table = np.zeros((len(self.languages), end - base, w), np.float32)
            for i, k in enumerate(self.languages):
                flat = [((n - base) * w + s)[n >= 0] for n, s in zip(state[k], streams[k])]
                flat = np.concatenate(flat or [np.zeros(0, np.int64)])
                table[i] = np.bincount(flat, minlength=(end - base) * w).reshape(end - base, w)
            self.counts.append(table)
        self.counts = [_sparse(t) for t in self.counts]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """child[node * width + byte]: the node one byte further back, or -1; cost[node * width + byte]: bits per language."""
        w, n = self.width, self.level[-1]
        child = np.full(n * w, -1, np.int32)
        cost = np.empty((n * w, len(self.languages)), np.float32)
        for depth in range(1, self.order + 1):
            child[self.keys[depth - 1]] = np.arange(self.level[depth], self.level[depth + 1])
        for i in range(len(self.languages)):
            above = None  # the counts one level up, and the shares of unseen bytes there
            for depth in range(self.order + 1):
                base, end = self.level[depth], self.level[depth + 1]
                counts = _dense(self.counts[depth], i)
                lower = np.empty((end - base, w), np.float64) if depth < self.order else None
                for a in range(0, end - base, NODES):
                    c = counts[a : a + NODES].astype(np.float64)
                    if above is None:
                        share = np.where(c == 0, 1 / np.maximum(256 - (c > 0).sum(1, keepdims=True), 1), 0.0)
                    else:
                        up = self.keys[depth - 1][a : a + NODES] // w - self.level[depth - 1]
                        rest = np.where(c > 0, 0, above[0][up])
                        kinds = (rest > 0).sum(1, keepdims=True)
                        below = np.maximum(rest.sum(1, keepdims=True) + kinds, 1)
                        share = np.where(rest > 0, rest / below, np.where(kinds > 0, kinds / below, 1.0) * above[1][up])
                    total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                    below = np.maximum(total + kinds, 1)
                    p = np.where(c > 0, c / below, np.where(total > 0, kinds / below, 1.0) * share)
                    at = (base + a) * w
                    cost[at : at + p.size, i] = -np.log2(np.maximum(p, 2.0**-40)).reshape(-1)
                    if lower is not None:
                        lower[a : a + NODES] = share
                above = counts, lower
        return child, cost


def _sparse(table: np.ndarray) -> tuple:
    """The shape of one language's table, and for each language the places and values of its counts."""
    flat = [x.reshape(-1) for x in table]
    at = [np.flatnonzero(f) for f in flat]
    return table.shape[1:], [(x.astype(np.int32), f[x]) for x, f in zip(at, flat)]


def _dense(kept: tuple, language: int) -> np.ndarray:
    out = np.zeros(int(np.prod(kept[0])), np.float32)
    at, values = kept[1][language]
    out[at] = values
    return out.reshape(kept[0])


class Models:
    """Models of neighbouring groups of languages, which are scored in turn."""

    def __init__(self, parts: list[Model]):
        self.parts = parts
        self.languages = [k for m in parts for k in m.languages]
        family = uuid.uuid4().hex
        for m in parts:
            m.family = family


def train(samples: dict[str, list[str]], order: int = ORDER, least: int = LEAST) -> Model | Models:
    """A model of all languages, in groups of at most GROUP; a group whose contexts don't all find room is halved.

    So what a language's tree holds doesn't depend on how many languages there are.
    """

    def grown(names: list[str]) -> list[Model]:
        model = Model({k: samples[k] for k in names}, order, least)
        if model.whole or len(names) < 2:
            return [model]
        return grown(names[: len(names) // 2]) + grown(names[len(names) // 2 :])

    names = sorted(samples)
    parts = [m for a in range(0, len(names), GROUP) for m in grown(names[a : a + GROUP])]
    return Models(parts) if len(parts) > 1 else parts[0] if parts else Model({}, order, least)


_ready: dict[str, dict[str, tuple[np.ndarray, np.ndarray]]] = {}


def _tables(model: Model) -> tuple[np.ndarray, np.ndarray]:
    if model.family not in _ready:
        _ready.clear()
        _ready[model.family] = {}
    kept = _ready[model.family]
    found = kept[model.id] if model.id in kept else model.tables()
    if len(kept) < KEEP:
        kept[model.id] = found
    return found


def code_lengths(model: Model | Models, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each whole text under each language, and the texts' bytes."""
    if isinstance(model, Models):
        each = [code_lengths(m, texts) for m in model.parts]
        return np.hstack([bits for bits, _ in each]), each[0][1]
    child, cost = _tables(model)
    data, bounds = column_bytes(texts)
    bits = np.zeros((len(bounds) - 1, len(model.languages)))
    for a in range(0, len(data), STEP):
        b = min(a + STEP, len(data))
        early = max(0, a - model.order)
        s = model.symbols[data[early:b]]
        lead = a - early
        node = np.zeros(b - a, np.int64)
        # How many bytes of its own text lie before each byte.
        t0 = int(np.searchsorted(bounds, a, "right")) - 1
        t1 = int(np.searchsorted(bounds, b, "left"))
        begins = bounds[t0:t1]
        offset = np.arange(a, b) - np.repeat(begins, np.diff(np.r_[np.maximum(begins, a), b]))
        alive = np.ones(b - a, bool)
        for depth in range(1, model.order + 1):
            back = np.zeros(b - a, np.int64)
            shift = lead - depth
            if shift >= 0:
                back[:] = s[shift : shift + b - a]
            else:
                back[-shift:] = s[: b - a + shift]
            down = child[node * model.width + back]
            alive &= (down >= 0) & (offset >= depth)
            node = np.where(alive, down, node)
        paid = cost[node * model.width + s[lead:]]
        cuts = np.maximum(begins, a) - a
        full = np.diff(np.r_[cuts, b - a]) > 0
        which = np.arange(t0, t1)[full]
        if len(which):
            bits[which] += np.add.reduceat(paid, cuts[full], axis=0, dtype=np.float64)
    return bits, np.diff(bounds)


def predict(model: Model | Models, texts: pa.Array) -> list[dict]:
    bits, sizes = code_lengths(model, texts)
    out = []
    for text, own, size in zip(texts, bits, sizes):
        if not size or not len(own) or not _LETTER.search(text.as_py()):
            out.append({"lang": UNKNOWN, "score": 0.0, "bits_per_byte": None})
            continue
        best = int(own.argmin())
        score = 1 / np.exp2(np.maximum(own[best] - own, -1000)).sum()
        out.append({"lang": model.languages[best], "score": float(score), "bits_per_byte": float(own[best] / size)})
    return out


def predictor(model: Broadcast) -> object:
    """The model as a column function: text to struct<lang, score, bits_per_byte>.

    It is declared non-deterministic only so that a filter on its result doesn't run it a second time.
    """

    @arrow_udf(RESULT)
    def identify(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
        out = pa.array(predict(model.value, texts.fill_null("")), kind)
        release()
        return out

    return identify.asNondeterministic()


def held_out(key: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, order: int = ORDER) -> Model | Models:
    """A model of every language that has a labelled text, from a bounded sample of the rows that aren't held out.

    The sample takes rows by a hash of their id: about ``rows`` for each language (never more than
    twice that), none longer than SAMPLE_TEXT_BYTES. A language that gets no row that way, as all its texts are longer, learns from up to
    WHOLE_TEXTS of its shortest, taken whole. What reaches the driver grows with the number of languages, not with
    the table. Rows without text or language teach nothing; a table without labelled rows gives a model
    without languages, which calls every text ``und``.
    """
    known = pick(df, [key, text, lang]).toDF("k", "t", "l").filter(~held_out(F.col("k")) & F.col("l").isNotNull() & (F.octet_length("t") > 0))
    short = F.octet_length("t") <= SAMPLE_TEXT_BYTES
    sizes = known.groupBy("l").agg(F.count_if(short).alias("n")).orderBy("l").collect()
    if not sizes:
        return Model({}, order)
    spark = df.sparkSession
    draw = F.xxhash64(F.lit(5), F.col("k"), F.octet_length("t"))
    chance = F.shiftrightunsigned(draw, 11) / float(1 << 53)
    shares = spark.createDataFrame([(r["l"], min(1.0, rows / max(r["n"], 1))) for r in sizes], "l string, share double")
    drawn = known.filter(short).join(F.broadcast(shares), "l").filter(chance < F.col("share")).withColumn("chance", chance)
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy("chance"))).filter(F.col("place") <= 2 * rows)
    samples: dict[str, list[str]] = {r["l"]: [] for r in sizes}
    for t, l in drawn.select("t", "l").collect():
        samples[l].append(t)
    if without := [(k,) for k, v in samples.items() if not v]:
        eighths = known.join(F.broadcast(spark.createDataFrame(without, "l string")), "l").groupBy("l", F.pmod(draw, F.lit(WHOLE_TEXTS)))
        for t, l in eighths.agg(F.min_by("t", F.struct(F.octet_length("t"), draw)).alias("t")).select("t", "l").collect():
            samples[l].append(t)
    return train(samples, order)


def identify_languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | Models | None = None) -> DataFrame:
    """df's key, text and language columns as k, t, l, with pred (lang, score, bits_per_byte) and held_out.

    pred.lang is ``und`` with score 0 if the text is null, empty or has no letter; else the language of the
    shortest code (ties: the first by name), and the score is its posterior probability. Only the text is
    looked at. Repeated rows are each predicted; an empty table gives an empty one.
    """
    model = model or fit(df, key, text, lang)
    identify = predictor(df.sparkSession.sparkContext.broadcast(model))
    return pick(df, [key, text, lang]).toDF("k", "t", "l").select("k", "t", "l", identify(F.coalesce("t", F.lit(""))).alias("pred"), held_out(F.col("k")).alias("held_out"))
