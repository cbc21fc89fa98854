import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cuesift.llm import langid, queries
from tests.llm.data import SF, awkward_docs, needs_tables, no_docs

SAMPLES = {"x": ["the cat sat on the mat", "the hat", ""], "y": ["le chat était là", "le mât et la été"]}


def slow_bits(samples, order, alphabet, text):
    """PPM with method C and exclusions, byte by byte, from plain counts."""
    counts = {}
    for s in samples:
        b = s.encode()
        for i, c in enumerate(b):
            for k in range(min(order, i) + 1):
                own = counts.setdefault(b[i - k : i], {})
                own[c] = own.get(c, 0) + 1
    b, bits = text.encode(), 0.0
    for i, c in enumerate(b):
        out, gone, p = 0.0, set(), 1.0
        for k in range(min(order, i), -1, -1):
            own = {s: n for s, n in counts.get(b[i - k : i], {}).items() if s not in gone}
            if not own:
                continue
            below = sum(own.values()) + len(own)
            if c in own:
                p *= own[c] / below
                break
            p *= len(own) / below
            gone |= set(own)
        else:
            p *= 1 / (256 - len(gone))
        bits += out - math.log2(p)
    return bits


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_code_lengths(order):
    model = langid.Model(SAMPLES, order, least=1)
    texts = ["the cat", "là", "zzz", "the mât 是", "t", ""]
    bits, sizes = langid.code_lengths(model, pa.array(texts))
    assert sizes.tolist() == [len(t.encode()) for t in texts]
    for t, own in zip(texts, bits):
        for k, got in zip(model.languages, own):
            assert got == pytest.approx(slow_bits(SAMPLES[k], order, model.width, t), rel=1e-5), (t, k)


def test_probabilities_sum_to_one():
    model = langid.Model(SAMPLES, 3)
    child, cost = model.tables()
    p = 2.0 ** -cost.reshape(-1, model.width, len(model.languages)).astype(float)
    weight = np.r_[np.ones(model.width - 1), 256 - (model.width - 1)]
    assert np.allclose((p * weight[None, :, None]).sum(1), 1, atol=1e-5)
    assert child.max() < model.level[-1]


def test_steps_and_slices(monkeypatch):
    """Texts are scored alike however the bytes are cut into steps."""
    rng = random.Random(0)
    texts = ["".join(rng.choice("the cat là ") for _ in range(rng.randrange(40))) for _ in range(60)]
    model = langid.Model(SAMPLES, 3, least=1)
    whole, _ = langid.code_lengths(model, pa.array(texts))
    monkeypatch.setattr(langid, "STEP", 7)
    cut, _ = langid.code_lengths(model, pa.array(texts))
    part, _ = langid.code_lengths(model, pa.array(texts).slice(11, 20))
    assert np.allclose(whole, cut) and np.allclose(part, whole[11:31])


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    rows = langid.identify_languages(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["t"] or "")
        assert (r["pred"]["lang"], 0 <= r["pred"]["score"] <= 1) == ("en" if letters else "und", True)
        assert r["held_out"] == (r["k"] is not None and zlib.crc32(str(r["k"]).encode()) % 4 == 2)
    assert langid.identify_languages(no_docs(spark)).count() == 0
    unlabelled = docs.withColumnRenamed("lang", "other").withColumnRenamed("source", "lang").filter("lang is null")
    assert {r["pred"]["lang"] for r in langid.identify_languages(unlabelled).collect()} == {"und"}


@needs_tables
def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op5_language_id(spark, sf).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert len(held) > 150 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 600)
    model = langid.Model(SAMPLES, 3, least=1)
    assert model.level[-1] * model.width * 2 <= 600
    child, cost = model.tables()
    p = 2.0 ** -cost.reshape(-1, model.width, 2).astype(float)
    weight = np.r_[np.ones(model.width - 1), 256 - (model.width - 1)]
    assert np.allclose((p * weight[None, :, None]).sum(1), 1, atol=1e-5)


def test_numbers_and_marks_are_no_letters():
    model = langid.Model(SAMPLES)
    assert [r["lang"] == "und" for r in langid.predict(model, pa.array(["²³ 12 _ ٣ Ⅷ", "ª", "是", "1a"]))] == [True, False, False, False]


def test_groups_score_as_one(monkeypatch):
    """Groups of languages, also halved ones, give the code lengths of one tree; tables beyond KEEP are worked out anew."""
    samples = {f"l{i}": [f"{chr(97 + i)}{t} {chr(110 + i)}" for t in SAMPLES["xy"[i % 2]]] for i in range(9)}
    texts = pa.array(["the cat", "là", "zzz", "", "the mât 是", "b c d"])
    one, _ = langid.code_lengths(langid.Model(samples, 3, least=1), texts)
    many = langid.train(samples, 3, least=1)
    monkeypatch.setattr(langid, "KEEP", 1)
    monkeypatch.setattr(langid, "CELLS", 6000)
    halved = langid.train(samples, 3, least=1)
    assert len(many.parts) == 3 < len(halved.parts) and all(m.whole for m in halved.parts)
    for model in (many, halved, many):
        bits, _ = langid.code_lengths(model, texts)
        assert model.languages == sorted(samples) and np.allclose(bits, one, rtol=1e-5)


def test_every_language_is_learned(spark):
    """More than 64 languages, one of long texts alone, and one of empty texts, which teach nothing."""
    word = lambda i: "".join(chr(0x4E00 + 40 * i + k) for k in range(5))
    rows = [(f"l{i:03d}", f"{word(i)} " * 3) for i in range(80) for _ in range(6)] + [("long", f"{word(90)} " * 5000)] * 6 + [("none", "")] * 6
    docs = spark.createDataFrame([(k, t, l) for k, (l, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == [f"l{i:03d}" for i in range(80)] + ["long"]
    found = langid.identify_languages(docs, model=model).collect()
    assert all(r["pred"]["lang"] == (r["l"] if r["t"] else "und") for r in found)
    assert all(r["pred"]["bits_per_byte"] < 4 for r in found if r["l"] == "long")
