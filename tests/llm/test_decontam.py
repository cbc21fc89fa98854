import hashlib
import random
import re

from cuesift.llm import decontam, queries
from tests.llm.data import awkward_docs, no_docs, tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def slow(texts, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[p : p + n]), set()).add("null" if i is None else str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p : p + n])) in grams:
                    hit.update(range(p, p + n))
                    found |= grams[g]
        out.append((len(w), hit, sorted(found)))
    return out


def covered(r):
    return {p for s in r["hit_spans"] for p in range(s["start"], s["end"])}


def test_against_brute_force(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["a", "B", "cé", "d1", "E"]) for _ in range(n))
    items = [(i, prose(rng.choice([3, 7, 9, 10, 11, 25, 40]))) for i in range(30)] + [(None, "null id item of exactly these words"), (5, prose(30)), (40, None), (41, ""), (42, "?!")]
    texts = [prose(rng.randrange(60)) for _ in range(60)] + [f"{prose(4)}, {items[k][1]} {prose(4)}" for k in range(35) if items[k][1]] + [None, "", "x" * 2_000_000 + " " + prose(30)]
    docs = spark.createDataFrame([(i, t, "clash", True) for i, t in enumerate(texts)], "doc_id long, text string, Text string, contaminated boolean").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = slow(texts, items)
    for block, blocks in ((decontam.BLOCK_BYTES, 4), (300, 100), (300, 2), (600, 1)):
        out = decontam.mark_contaminated(docs, bench, block_bytes=block, pass_blocks=blocks)
        assert "contaminated_in" in out.columns
        for r in out.collect():
            n, hit, found = want[r[0]]
            assert (r["n_words"], covered(r), r["item_ids"], r["contaminated"]) == (n, hit, found, bool(hit)), r[0]
            assert all(a["end"] < b["start"] or a["end"] <= b["start"] for a, b in zip(r["hit_spans"], r["hit_spans"][1:]))


def test_long_items_only(spark):
    """With windows of ten words alone, fingerprints lose no shared span."""
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    items = [(i, prose(40)) for i in range(10)]
    texts = []
    for n in range(5, 20):
        for i, t in items:
            at = rng.randrange(40 - n)
            texts.append(prose(8) + " " + " ".join(t.split()[at : at + n]) + " " + prose(8))
    out = decontam.mark_contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = slow(texts, items)
    assert all((covered(r), r["item_ids"]) == want[r[0]][1:] for r in out.collect())
    assert 0 < sum(bool(x[1]) for x in want) < len(texts)


def test_repeated_items_are_one(spark):
    """A document that hits two rows of one item_id, under one block and under several."""
    items = [(1, "one two three"), (2, "seven eight"), (1, "four five six"), (None, "nine ten"), (None, "ten eleven")]
    texts = ["one two three and four five six", "seven eight nine ten eleven", "none"]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 1):
        got = {r["doc_id"]: r["item_ids"] for r in decontam.mark_contaminated(docs, bench, block_bytes=block).collect()}
        assert got == {0: ["1"], 1: ["2", "null"], 2: []}


def test_edges_and_query(spark, tmp_path):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontam.mark_contaminated(no_docs(spark), bench).count() == 0
    docs = awkward_docs(spark)
    clean = decontam.mark_contaminated(docs, bench.limit(0))
    assert clean.filter("contaminated").count() == 0 and clean.count() == docs.count()
    rows = {r["doc_id"]: r for r in queries.op2_decontamination(spark, tables(spark, tmp_path, docs, benchmark=bench)).collect()}
    assert rows[5]["n_hit"] == 3 and rows[5]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and rows[4]["items_sha256"] == hashlib.sha256(b"").hexdigest() and rows[0]["n_words"] == 0
