"""Small documents with every awkward case, and helpers of the tests."""

import os
import random

import pytest

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(SF), reason="the tables aren't here")
#: Columns that clash with those that operators add, or differ from others only by case.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text string, shard int, n_dropped int, n_words int, main_text string, contaminated boolean"


def awkward_texts():
    rng = random.Random(0)
    words = ["alpha", "Beta", "GAMMA", "élan", "Straße", "x1", "über", "delta", "eps", "zeta"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_line = "This line is shared by a good many of the documents here."
    shared = [f"{prose(12)}\n{long_line}\n{prose(3)}", f"{prose(12)}\n  {long_line.upper()} \t\n", long_line, f"{long_line}\n{long_line}", f"É {prose(3)}\n{long_line}\r", f"{prose(9)}\n{long_line}"]
    base = prose(60)
    copies = [base, base, base.replace(" ", "  "), base.upper().replace("É", "é").replace("Ü", "ü"), base + " tail", prose(2) + " " + base]
    return [None, "", " \n\t", "\n\n", "one", "one two three", "!!! 123 ???", *shared, *copies, prose(6000), "a" * 300_000, "\0 ünï \x1c <|endoftext|>　x", prose(40)]


def awkward_docs(spark, texts=None):
    texts = awkward_texts() if texts is None else texts
    rows = [(None if i == 3 else i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None, "clash", 7, 7, 7, "clash", None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[12]]  # repeated rows
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def tables(spark, path, docs, **others):
    """Writes tables for queries that take a folder; plain columns only, as files can't hold names that differ by case."""
    docs.toDF(*[c if i < 5 else f"x{i}" for i, c in enumerate(docs.columns)]).write.parquet(f"{path}/documents.parquet")
    for name, df in others.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
