import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuesift.llm import packing, queries, token_counts, tokens
from tests.llm.data import awkward_docs, awkward_texts, awkward_texts, no_docs, tables

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_both_libraries_agree(plain):
    rng = random.Random(2)
    odd = ["".join(rng.choice("ab é\t\n\r\xa0\x85'sll 12³☃字 ") for _ in range(rng.randrange(60))) for _ in range(400)]
    fast = tokens.ByteBpe(PATH)
    assert fast.fast is not None
    for t in [*odd, *(t or "" for t in awkward_texts()), " " * 5000 + "x", "it's we'll\n\n  x"]:
        assert list(fast.encode(t)) == plain.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_take_the_plain_way():
    assert tokens.ByteBpe(public_tokenizers.path("word_bpe_49k.json")).fast is None


def check_pieces(rows, texts, plain, length=1024):
    """rows: pieces of texts (a list; repeats allowed) by doc_id."""
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in rows)
    ids = {d: {len(x) for x in xs} for d, xs in want.items()}
    total = 0
    for d, start, n, whole, crc in pieces:
        d = None if d == -1 else d
        assert whole in ids[d] and any(len(x) == whole and zlib.crc32(x[start : start + n].tobytes()) == crc for x in want[d])
        total += n
    assert total == sum(len(x) for xs in want.values() for x in xs)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0


def test_packing(spark, tmp_path, plain):
    docs = awkward_docs(spark)
    texts = [(r[0], r[1]) for r in docs.collect()]
    rows = queries.op7_packing(spark, tables(spark, tmp_path, docs)).collect()
    check_pieces(rows, texts, plain)
    assert packing.pack(no_docs(spark), PATH).count() == 0


def test_packing_is_the_same_in_every_run(spark, monkeypatch):
    """Many ranges, other parts of the input: the same pieces; a copied text lies in several ranges."""
    monkeypatch.setattr(packing, "SMALL", 2000)
    texts = [f"text number {i % 50} of some words, {'and more of them, ' * (i % 7)}" for i in range(400)] + ["a copy of it all " * 20] * 200
    docs = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    runs = [sorted((r["doc_id"] is not None, *[x for x in r if x is not None]) for r in packing.pack(docs.repartition(n), PATH).collect()) for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2]
    used = {r["sequence_id"] >> 32 for r in packing.pack(docs, PATH).collect()}
    assert len(used) > 5 and len({r["sequence_id"] >> 32 for r in packing.pack(docs, PATH).filter("doc_id >= 400").collect()}) > 1


def test_neighbours_share_sequences():
    """Hilbert keys visit each cell once, one step at a time."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    plane, rng = packing.projection(), np.random.default_rng(0)
    topic = rng.integers(0, 50000, 100)
    near = [packing.cell(rng.choice(topic, 400), plane) for _ in range(10)]
    far = [packing.cell(rng.integers(0, 50000, 400), plane) for _ in range(10)]
    assert np.std(near, axis=0).mean() < np.std(far, axis=0).mean()


CHANGES = "op string, source string, lang string, text string, old_source string, old_lang string, old_text string, Extra int"


def totals(ledger):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_bytes"]) for r in ledger.totals().collect()}


def test_ledger(spark, tmp_path, plain):
    n = lambda t: len(plain.encode(t or "", add_special_tokens=False).ids)
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"), PATH, "v1")
    assert totals(ledger) == {}
    docs = awkward_docs(spark)
    held = {}

    def put(source, lang, text, sign):
        d, k, b = held.get((source, lang, "v1"), (0, 0, 0))
        held[source, lang, "v1"] = (d + sign, k + sign * n(text), b + sign * len((text or "").encode()))

    for r in docs.collect():
        put(r["source"], r["lang"], r[1], 1)
    assert ledger.commit("load", token_counts.inserts(docs)) and totals(ledger) == held
    assert not ledger.commit("load", token_counts.inserts(docs)) and totals(ledger) == held
    edits = spark.createDataFrame([("revise", "s", "fr", "nouveau texte", "s", "en", "one", 1), ("delete", None, None, None, None, None, None, 1), ("insert", "t", None, "x", None, None, None, 1)], CHANGES)
    assert ledger.commit("edits", edits)
    for source, lang, text, sign in [("s", "en", "one", -1), ("s", "fr", "nouveau texte", 1), (None, None, None, -1), ("t", None, "x", 1)]:
        put(source, lang, text, sign)
    want = {k: v for k, v in held.items() if any(v)}
    assert totals(ledger) == want
    ledger.compact()
    assert totals(ledger) == want and not ledger.commit("edits", edits) and ledger.committed() == {"load", "edits"}
    assert ledger.commit("more", edits.limit(0)) and totals(ledger) == want
    newer = token_counts.TokenLedger(spark, ledger.path, PATH, "v2")
    assert newer.commit("v2", token_counts.inserts(docs.limit(5))) and {k[2] for k in totals(newer)} == {"v1", "v2"}
    newer.compact()
    assert {k: v for k, v in totals(newer).items() if k[2] == "v1"} == want
    with pytest.raises(Exception, match="unknown change"):
        ledger.commit("bad", edits.withColumnRenamed("op", "o").selectExpr("'upsert' as op", "*"))
    with pytest.raises(ValueError):
        ledger.commit("a/b", edits)
    assert totals(ledger) == totals(newer)


def test_two_writers_of_one_batch(spark, tmp_path, plain):
    """Both get past the look at what is committed, and write their deltas; one of them counts."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    docs = awkward_docs(spark).limit(6)
    alone = token_counts.TokenLedger(spark, str(tmp_path / "alone"), PATH, "v1")
    alone.commit("load", token_counts.inserts(docs))
    barrier = Barrier(3)

    class Slow(token_counts.TokenLedger):
        def committed(self):
            found = super().committed()
            barrier.wait(60)
            return found

    ledgers = [Slow(spark, str(tmp_path / "both"), PATH, "v1") for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        won = list(pool.map(lambda x: x.commit("load", token_counts.inserts(docs)), ledgers))
    assert sorted(won) == [False, False, True] and totals(ledgers[0]) == totals(alone)


def test_counts_query(spark, tmp_path, plain):
    docs = awkward_docs(spark, awkward_texts() + ["a word " * 90, "two words " * 70])
    sizes = [len(r[1] or "") for r in docs.collect()]
    assert min(sizes) < 500 and any(500 <= n < 1000 for n in sizes) and max(sizes) >= 1000
    want = {}
    for r in docs.collect():
        k = (r["source"], r["lang"])
        d, t, b = want.get(k, (0, 0, 0))
        want[k] = (d + 1, t + len(plain.encode(r[1] or "", add_special_tokens=False).ids), b + len((r[1] or "").encode()))
    rows = queries.op3_token_counts(spark, tables(spark, tmp_path, docs)).collect()
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"], r["n_bytes"]) for r in rows} == want
