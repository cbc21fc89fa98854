"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

1. language: texts that no language is found for go (no letters, no language more likely than
   the rest together, or 32 bytes or more that no language describes in fewer bits than they have); ``lang`` becomes the
   predicted language.
2. line_dedup: lines of at least 40 characters that occur in five documents or more stay in one; documents
   that have no text left go.
3. near_dedup: of documents linked by a similarity of 0.8 or more over five-word shingles, one stays.
4. decontamination: documents that hold ten consecutive words of a benchmark item (or the whole of a
   shorter one) go.
5. packing: what is left is cut into sequences of 1024 tokens.

Stages take (spark, docs, sf_dir) with the columns of ``documents`` and, but for the last, return those.
Other columns are left out, also where their names differ only by case. Null and empty texts go in the first
stage; a stage that is given them keeps them where its docstring doesn't say otherwise. Very long texts are worked on whole.
Repeated rows are treated alike, an empty table gives an empty one. run() logs the rows that each stage leaves.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesift.llm import decontam, langid, line_dedup, minhash, packing
from cuesift.llm.common import BLANKS, pick, written
from cuesift.llm.queries import byte_bpe_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: From so many bytes on, a text must cost fewer bits a byte than it has itself.
MIN_SCORE, PLAIN_BITS, PLAIN_BYTES = 0.5, 8.0, 32
log = logging.getLogger(__name__)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; null and letterless texts, undecided ones, and such in no learned language go.

    Learns from the labels that docs has; without any, nothing is left.
    """
    docs = pick(docs, COLUMNS)
    identify = langid.predictor(spark.sparkContext.broadcast(langid.fit(docs)))
    found = docs.withColumn("pred", identify(F.coalesce("text", F.lit(""))))
    described = (F.octet_length("text") < PLAIN_BYTES) | (F.col("pred.bits_per_byte") < PLAIN_BITS)
    kept = found.filter((F.col("pred.lang") != langid.UNKNOWN) & (F.col("pred.score") >= MIN_SCORE) & described)
    return kept.withColumn("lang", F.col("pred.lang")).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars follows the text. Those that hold nothing but blanks (then, or before) go."""
    out = line_dedup.dedup_lines(pick(docs, COLUMNS)).filter(F.trim("text", F.lit(BLANKS)) != "")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest id; null texts and texts without words are in no group and stay."""
    return minhash.drop_near_duplicates(pick(docs, COLUMNS), percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts have none and stay."""
    marked = decontam.mark_contaminated(pick(docs, COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.filter(~F.col("contaminated")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with the ids' checksum; a null or empty text is the end mark alone."""
    out = packing.pack(pick(docs, COLUMNS), byte_bpe_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Language ID and tokens are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            log.info("%s: %d documents left", name, docs.count())  # from the files' footers
    return docs
