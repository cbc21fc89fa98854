import corpus_pipeline as cp
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuesift.llm import langid
from tests.llm.data import SF, awkward_docs, awkward_texts, needs_tables, tables
from tests.llm.test_decontam import slow as slow_decontam
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_minhash import slow as slow_near
from tests.llm.test_tokens import check_pieces


def spoken(text, pred):
    """What the language stage keeps."""
    return pred["lang"] != "und" and pred["score"] >= 0.5 and (len(text.encode()) < 32 or pred["bits_per_byte"] < 8)


def blank(text):
    return not text.strip(" \t\n\x0b\f\r")


def rows(df):
    return {r["doc_id"]: tuple(r) for r in df.select(*cp.COLUMNS).collect()}


@needs_tables
def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 30000")
    before = rows(docs)
    out = cp.language(spark, docs, SF)
    assert out.columns == docs.columns
    after = rows(out)
    model = langid.fit(docs)
    import pyarrow as pa

    pred = dict(zip(before, langid.predict(model, pa.array([r[1] for r in before.values()]))))
    assert after == {d: (d, t, pred[d]["lang"], s, n) for d, (_, t, _, s, n) in before.items() if spoken(t or "", pred[d])}
    assert len(after) >= 0.99 * len(before)

    docs, before = out, after
    out = cp.line_dedup_stage(spark, docs, SF)
    after = rows(out)
    want = {d: t for d, t, *_ in slow_lines([(d, r[1]) for d, r in before.items()])}
    assert out.columns == cp.COLUMNS and after == {d: (d, want[d], r[2], r[3], len(want[d])) for d, r in before.items() if not blank(want[d])}

    docs, before = out, after
    out = cp.near_dedup(spark, docs, SF)
    after = rows(out)
    groups = slow_near([(d, r[1]) for d, r in before.items()], 80)
    assert out.columns == cp.COLUMNS and after == {d: r for d, r in before.items() if groups[d][1] == d}

    docs, before = out, after
    out = cp.decontamination(spark, docs, SF)
    after = rows(out)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = slow_decontam([r[1] for r in before.values()], items)
    assert out.columns == cp.COLUMNS and after == {d: r for (d, r), (_, hit, _) in zip(before.items(), hits) if not hit}
    assert 0 < len(after) < len(before)

    out = cp.pack(spark, out, SF)
    check_pieces(out.collect(), [(d, r[1]) for d, r in after.items()], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


@needs_tables
def test_run_is_its_stages(spark):
    assert 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None
    got = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in cp.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
    assert {d for d, *_ in got} == {r[0] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_awkward_and_empty_tables(spark, tmp_path, k):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = cp.STAGES[k]
    docs = awkward_docs(spark)
    kept = stage(spark, docs, str(tmp_path)).count()
    assert kept > 0 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if k == 1:
        want = slow_lines([(r[0], r[1]) for r in docs.collect()])
        assert kept == sum(not blank(t) for _, t, *_ in want)


def test_run_against_brute_force_of_all_lengths(spark, tmp_path):
    """run()'s pieces, whole, on null, empty and very long texts too."""
    import pyarrow as pa

    texts = awkward_texts() + ["one two three four", None, "alpha Beta delta élan GAMMA zeta " * 10_000]
    assert max(len(t or "") for t in texts) >= 300_000 and "" in texts
    items = [(1, "one two three")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    path = tables(spark, tmp_path, docs, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    found = langid.predict(langid.fit(docs), pa.array([t or "" for t in texts]))
    left = [(i, t) for (i, t), f in zip(enumerate(texts), found) if spoken(t or "", f)]
    left = [(d, t) for d, t, *_ in slow_lines(left) if not blank(t)]
    groups = slow_near(left, 80)
    left = [(d, t) for d, t in left if groups[d][1] == d]
    left = [x for x, (_, hit, _) in zip(left, slow_decontam([t for _, t in left], items)) if not hit]
    assert max(len(t) for _, t in left) >= 300_000
    check_pieces(cp.run(spark, path).collect(), left, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


@needs_tables
def test_languages_that_nobody_taught(spark):
    """Noise and unknown languages go, whatever their score; the table's own documents stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    strange = ["Это русский текст, которого модель никогда не видела, и он довольно длинный.", "これは日本語の文章です。モデルは一度も見たことがありません。", "qzxv kwjq xzvq jjkq wvxz qqzx " * 5, "1234 5678 !!!"]
    more = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r[0] for r in cp.language(spark, docs.unionByName(more), SF).select("doc_id").collect()}
    own = {r[0] for r in docs.collect() if any(c.isalpha() for c in r[1] or "")}
    assert own <= kept and not any(d >= 10**6 for d in kept)


def test_emptied_documents_go(spark):
    line = "This very line is in six of the documents, so it stays in one."
    docs = spark.createDataFrame([(i, f"{line}\n \n{line}", "en", "s", 1) for i in range(6)] + [(9, "other", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in cp.line_dedup_stage(spark, docs, "").collect()} == {5, 9}
