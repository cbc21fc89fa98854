"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A batch of changes (inserts, deletes, revisions) becomes signed rows, is tokenised once and summed to
one small table of deltas, which is committed by a marker of the batch's id that only one writer can
create. A batch that is already committed isn't counted again, so a retried or replayed batch changes nothing. The
totals are the sums of all committed deltas; ``compact`` folds them into a snapshot that remembers
which batches it holds.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import pick, scratch
from .tokens import byte_bpe
from .words import release

MEASURES = ("n_docs", "n_tokens", "n_bytes")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
CHANGES = ["op", "source", "lang", "text", "old_source", "old_lang", "old_text"]


def token_counter(path: str) -> object:
    """A column function: text to its number of ids; nulls and empty texts have none."""

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        t = byte_bpe(path)
        out = pa.array([len(t.encode(x.as_py())) if x.is_valid else 0 for x in texts], pa.int64())
        release()
        return out

    return count


def signed(changes: DataFrame) -> DataFrame:
    """Rows (sign, source, lang, text): an insert is +1, a delete -1, a revision takes the old row out and puts the new one in."""
    c = pick(changes, CHANGES)
    new = F.struct(F.lit(1).alias("sign"), "source", "lang", "text")
    old = F.struct(F.lit(-1).alias("sign"), F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_text").alias("text"))
    gone = F.struct(F.lit(-1).alias("sign"), "source", "lang", "text")
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))).cast("array<struct<sign: int, source: string, lang: string, text: string>>")
    rows = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(gone)).when(F.col("op") == "revise", F.array(old, new)).otherwise(wrong)
    return c.select(F.inline(rows))


def inserts(df: DataFrame, source: str = "source", lang: str = "lang", text: str = "text") -> DataFrame:
    """A table of documents as a batch of inserts."""
    none = F.lit(None).cast("string")
    return pick(df, [source, lang, text]).select(F.lit("insert").alias("op"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(text).alias("text"), none.alias("old_source"), none.alias("old_lang"), none.alias("old_text"))


class TokenLedger:
    """The committed deltas below one folder of a shared file system.

    Null sources and languages are groups of their own; a null or empty text is a document of no tokens and
    bytes; a very long text is tokenised whole. Groups whose documents were all taken out stay with zeros until ``totals`` leaves them
    out. Repeated rows in a batch count as often as they occur; an empty batch commits no rows. Columns of a
    batch beyond CHANGES are left out, also where their names differ from those only by case. Batches may be committed by several
    writers at once; ``compact`` is for one at a time.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer_path: str, version: str):
        self.spark, self.path, self.tokenizer, self.version = spark, path.rstrip("/"), tokenizer_path, version

    def _fs(self, path: str) -> tuple[object, object]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, below: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{below}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def deltas(self, changes: DataFrame) -> DataFrame:
        """The batch's sums; they are combined before the shuffle, so a hot source is one row a task."""
        rows = signed(changes).withColumn("tokens", token_counter(self.tokenizer)("text"))
        sums = [F.sum("sign").cast("long"), F.sum(F.col("sign") * F.col("tokens")), F.sum(F.col("sign") * F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))]
        return rows.groupBy("source", "lang").agg(*[s.alias(m) for s, m in zip(sums, MEASURES)]).select("source", "lang", F.lit(self.version).alias("tokenizer"), *MEASURES)

    def _marked(self) -> dict[str, str]:
        """Each committed batch that no snapshot has taken up yet, and the folder of its deltas."""
        if not self._list("batches"):
            return {}
        rows = self.spark.read.schema("batch string, folder string").json(f"{self.path}/batches").collect()  # one row a batch since the last snapshot
        return {r["batch"]: r["folder"] for r in rows}

    def _merged(self, snapshot: str | None) -> set[str]:
        return {r["batch"] for r in self.spark.read.schema("batch string").json(f"{self.path}/snapshots/{snapshot}/batches").collect()} if snapshot else set()

    def committed(self) -> set[str]:
        return self._merged(self._snapshot()) | set(self._marked())

    def _snapshot(self) -> str | None:
        return next(iter(reversed(self._list("snapshots"))), None)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Counts the batch unless its id is committed already; whether it was counted now.

        The deltas are written first; the marker is a file that comes to be whole or not at all, and not over another. So of
        several writers of one batch one counts, and a writer that dies before its marker leaves nothing that counts.
        """
        if not batch or set(batch) & set("/\\:"):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.committed():
            return False
        folder = scratch(self.spark, batch).rsplit("/", 1)[1]
        self.deltas(changes).write.parquet(f"{self.path}/deltas/{folder}")
        if self._mark(batch, json.dumps({"batch": batch, "folder": folder})):
            return True
        fs, gone = self._fs(f"{self.path}/deltas/{folder}")
        fs.delete(gone, True)
        return False

    def _mark(self, batch: str, text: str) -> bool:
        fs, target = self._fs(f"{self.path}/batches/batch-{batch}.json")
        fs.mkdirs(target.getParent())
        _, staged = self._fs(f"{self.path}/staging/{scratch(self.spark, batch).rsplit('/', 1)[1]}")
        out = fs.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # a second link to the whole file; fails if the name is taken
                try:
                    os.link(staged.toUri().getPath(), target.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            jvm = self.spark._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            try:
                context.rename(staged, target, never_over)
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                return False
            return True
        finally:
            fs.delete(staged, False)

    def totals(self) -> DataFrame:
        """The sums by source, lang and tokenizer, without groups that are empty again."""
        return self._sums(self._marked())

    def _sums(self, marked: dict[str, str]) -> DataFrame:
        """The sums of the last snapshot and of these batches; their rows are combined before they are shuffled."""
        snapshot = self._snapshot()
        merged = self._merged(snapshot)
        paths = [f"{self.path}/deltas/{folder}" for batch, folder in marked.items() if batch not in merged]
        if snapshot:
            paths.append(f"{self.path}/snapshots/{snapshot}/totals")
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        sums = self.spark.read.schema(DELTA).parquet(*paths).groupBy("source", "lang", "tokenizer").agg(*[F.sum(m).alias(m) for m in MEASURES])
        return sums.filter(" or ".join(f"{m} <> 0" for m in MEASURES))

    def compact(self) -> None:
        """Folds the batches committed so far into a new snapshot, committed by a rename, then drops what it holds."""
        marked = self._marked()
        ids = self._merged(self._snapshot()) | set(marked)
        number = int(self._snapshot() or 0) + 1
        staged = f"{self.path}/staging/{scratch(self.spark, 'snapshot').rsplit('/', 1)[1]}"
        self._sums(marked).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(i,) for i in sorted(ids)], "batch string").write.json(f"{staged}/batches")
        fs, to = self._fs(f"{self.path}/snapshots/{number:012d}")
        fs.mkdirs(to.getParent())
        _, source = self._fs(staged)
        if not fs.rename(source, to):
            raise RuntimeError(f"snapshot {number} couldn't be committed")
        for batch, folder in marked.items():
            fs.delete(self._fs(f"{self.path}/batches/batch-{batch}.json")[1], False)
            fs.delete(self._fs(f"{self.path}/deltas/{folder}")[1], True)
        for x in self._list("snapshots"):
            if int(x) < number:
                fs.delete(self._fs(f"{self.path}/snapshots/{x}")[1], True)
