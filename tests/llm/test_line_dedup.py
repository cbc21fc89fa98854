import re

from cuesift.llm import line_dedup, queries
from tests.llm.data import awkward_docs, awkward_texts, no_docs

STRIP = " \t\n\x0b\f\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(STRIP))


def slow(docs, min_chars=40, min_docs=5):
    """docs: list of (id, text); rows that repeat an id are one document."""
    held = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(d)
    hot = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, str(r)))


def test_against_brute_force(spark):
    docs = awkward_docs(spark)
    pairs = [(r[0], r[1]) for r in docs.collect()]
    out = line_dedup.dedup_lines(docs)
    got = [(r[0], r[1], r["n_lines"], r["n_dropped"]) for r in out.collect()]
    assert order(got) == order(slow(pairs))
    assert any(n for *_, n in got) and {"n_dropped_in", "Text", "shard"} <= set(out.columns)
    assert line_dedup.dedup_lines(docs, min_chars=1, min_docs=2).count() == docs.count()


def test_small_thresholds(spark):
    texts = [t for t in awkward_texts() if t is None or len(t) < 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.dedup_lines(docs, min_chars=3, min_docs=2).collect()]
    assert order(got) == order(slow(list(enumerate(texts)), 3, 2))


def test_repeated_rows_are_one_document(spark):
    """A line of two ids in five rows, of four ids in five rows, of five in five, and of null ids and four others."""
    line = lambda k: f"line number {k}, of forty characters at the least"
    rows = [(1, f"{line(0)}\nx")] * 4 + [(2, line(0)), (3, line(1)), (3, line(1)), (4, line(1)), (5, line(1)), (6, line(1))]
    rows += [(i, line(2)) for i in range(7, 12)] + [(i, line(3)) for i in (None, None, 12, 13, 14, 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in line_dedup.dedup_lines(docs).collect()]
    assert order(got) == order(slow(rows))
    assert {r[0] for r in got if r[3]} == {7, 8, 9, 10, None, 12, 13, 14}


def test_empty(spark):
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0
    assert "op4_line_dedup" in queries.ORACLES


def test_long_text_of_repeated_lines(spark):
    """A text of 200,000 lines, half of which go: in proportion to its length, not to lines times dropped lines."""
    line = lambda k: f"line number {k}, of forty characters at the least"
    long = "\n".join(line(i) for i in range(200_000))
    short = [(i, "\n".join(line(k) for k in range(0, 200_000, 2))) for i in range(2, 6)]
    docs = spark.createDataFrame([(1, long), *short], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1]["n_lines"] == 200_000 and got[1]["n_dropped"] == 100_000 and got[5]["n_dropped"] == 0
    assert got[1]["text"] == "\n".join(line(i) for i in range(1, 200_000, 2)) and got[2]["text"] == ""


def test_lists_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_TEXTS", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_PLACES", 0)
    docs = awkward_docs(spark)
    got = [(r[0], r[1], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()]
    assert order(got) == order(slow([(r[0], r[1]) for r in docs.collect()]))
