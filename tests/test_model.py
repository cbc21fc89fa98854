import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesift import cli
from cuesift.functions import tensor
from cuesift.functions.encoder import PRESETS, Encoder, erf, gelu, model_files
from cuesift.functions.wordpiece import WordPiece, decode, encode
from cuesift.operators.batching import embed
from cuesift.plans.queries import TOY, toy_weights
from cuesift.sources import index, safetensors
from cuesift.sources.vocab import load_vocab, read_vocab
from tests.test_captions import FILE

VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hel", "##lo", "hello", "##s", "!", "'", "un", "##aff", "##able", "a"]


@pytest.mark.parametrize("text,most,want", [("Hellos! unaffable", 256, [2, 6, 7, 8, 10, 11, 12, 3]), ("hello hello hello hello", 4, [2, 6, 6, 3]), ("xyz a" + "a" * 100, 256, [2, 1, 1, 3]), ("", 256, [2, 3]), ("unaffable", 4, [2, 10, 11, 3]), ("a", 1, [3])])
def test_wordpiece(text, most, want):
    assert WordPiece(VOCAB, most).encode(text) == want


def test_wordpiece_columns(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join([*VOCAB, "a "]) + "\n")
    vocab = load_vocab(str(tmp_path / "vocab.txt"))
    assert vocab.ids["a"] == 14 and dict(read_vocab(spark, str(tmp_path / "vocab.txt")).collect())["a"] == 14
    df = spark.createDataFrame([("hello a",), (None,)], "s string").select(encode(spark, vocab, F.col("s")).alias("ids"))
    assert [r[0] for r in df.collect()] == [[2, 6, 14, 3], None]
    assert df.select(decode(vocab, F.col("ids"))).first()[0] == ["[CLS]", "hello", "a ", "[SEP]"]
    with pytest.raises(ValueError, match="SEP"):
        WordPiece(["[CLS]", "[PAD]", "[UNK]"])


def test_half_decoding():
    for dtype, pairs in {"F16": [(0x3C00, 1.0), (1, 5.9604644775390625e-08), (0x200, 3.0517578125e-05), (0x3FF, 6.097555160522461e-05), (0x7C00, float("inf")), (0xC000, -2.0)], "BF16": [(0x3F80, 1.0)]}.items():
        for bits, want in pairs:
            assert safetensors.decode(struct.pack("<H", bits) + b"x", dtype)[0] == want
    with pytest.raises(ValueError):
        safetensors.decode(b"", "I8")


@pytest.mark.parametrize("dtype,prefix", [("F32", ""), ("F32", "bert."), ("F16", ""), ("BF16", "bert.")])
def test_weights_and_encoder(spark, tmp_path, dtype, prefix):
    path = str(tmp_path / "model.safetensors")
    weights = toy_weights(TOY, len(VOCAB))
    safetensors.write(path, {prefix + k: v for k, v in weights.items()}, dtype)
    file = safetensors.SafeTensors(path)
    assert set(file.names()) == {prefix + k for k in weights} and "__metadata__" not in file
    assert np.allclose(file.tensor("embeddings.LayerNorm.weight"), weights["embeddings.LayerNorm.weight"], rtol=1e-2)
    rows = {r["name"]: r for r in safetensors.read_safetensors(spark, path).collect()}
    name = prefix + "embeddings.token_type_embeddings.weight"
    assert rows[name]["shape"] == [2, 32] and rows[name]["dtype"] == dtype and np.allclose(rows[name]["values"], file.tensor(name).reshape(-1))
    model = Encoder(file.all(), TOY)
    together, alone = model.embed([[2, 6, 3], [2, 6, 7, 8, 10, 3], [2, 3]]), model.embed([[2, 6, 3]])
    assert np.allclose(together[0], alone[0], atol=1e-5) and np.allclose(np.linalg.norm(together, axis=1), 1, atol=1e-5)


def test_encoder_step_by_step():
    """The forward pass of one sequence, with loops."""
    w = toy_weights(TOY, len(VOCAB))
    ids = [2, 6, 7, 3]

    def norm(x, at):
        return np.array([(r - r.mean()) / np.sqrt(r.var() + TOY.eps) * w[f"{at}.weight"] + w[f"{at}.bias"] for r in x])

    lin = lambda x, at: x @ w[f"{at}.weight"].T + w[f"{at}.bias"]
    x = norm(np.array([w["embeddings.word_embeddings.weight"][t] + w["embeddings.position_embeddings.weight"][i] + w["embeddings.token_type_embeddings.weight"][0] for i, t in enumerate(ids)]), "embeddings.LayerNorm")
    for layer in range(TOY.layers):
        at = f"encoder.layer.{layer}"
        q, k, v = (lin(x, f"{at}.attention.self.{n}") for n in ("query", "key", "value"))
        ctx = np.zeros_like(x)
        d = TOY.hidden // TOY.heads
        for h in range(TOY.heads):
            s = slice(h * d, h * d + d)
            for i in range(len(ids)):
                e = np.exp([q[i, s] @ k[j, s] / np.sqrt(d) for j in range(len(ids))])
                ctx[i, s] = (e / e.sum()) @ v[:, s]
        a = norm(lin(ctx, f"{at}.attention.output.dense") + x, f"{at}.attention.output.LayerNorm")
        f = lin(a, f"{at}.intermediate.dense")
        x = norm(lin(gelu(f.astype(np.float32)), f"{at}.output.dense") + a, f"{at}.output.LayerNorm")
    want = x.mean(0) / np.linalg.norm(x.mean(0))
    assert np.allclose(Encoder(w, TOY).embed([ids])[0], want, atol=1e-5)
    cls = Encoder(w, type(TOY)(**{**TOY.__dict__, "pooling": "cls"})).embed([ids])[0]
    assert np.allclose(cls, x[0] / np.linalg.norm(x[0]), atol=1e-5)
    assert abs(float(erf(np.float32(0.5))) - 0.5204998778) < 1e-6
    assert model_files("e5-large")[2].heads == 16 and set(PRESETS) == {"mini-lm", "gte-small", "gte-base", "e5-large"}


def test_array_functions(spark):
    df = spark.range(1).select(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)).alias("v"))
    run = lambda c: df.select(c).first()[0]
    v = F.col("v")
    assert np.allclose(run(tensor.softmax(v)), np.exp([-3, -2, 0]) / np.exp([-3, -2, 0]).sum())
    assert np.allclose(run(tensor.l2_normalize(v)), np.array([1, 2, 4]) / np.sqrt(21))
    assert run(tensor.l2_normalize(tensor.zeros(2))) == [0.0, 0.0]
    assert run(tensor.row(v, 1, 1)) == [2.0] and run(tensor.div_up(F.lit(7), 2)) == 4 and run(tensor.dot(v, v)) == 21.0
    assert run(tensor.dot(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0.0


def test_index(spark, tmp_path):
    rows = [(i, f"v{i % 3}", f"text \"{i}\" é", i * 1.5, i * 2.5, [float(i), 1.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "chunk_idx long, vod_id string, text string, start double, end double, embedding array<float>")
    path = str(tmp_path / "index")
    index.write_index(df.filter("vod_id <> 'v2'"), path, "toy", 2, buckets=4)
    fresh = index.missing_videos(df, index.read_index(spark, path, "toy"))
    assert {r["vod_id"] for r in fresh.collect()} == {"v2"}
    index.write_index(fresh, path, "toy", 2, mode="append")
    assert sorted(map(tuple, index.read_index(spark, path).select(df.columns).collect())) == [tuple(r) for r in rows]
    assert index.of_videos(spark, path, ["v1"]).count() == 3
    with pytest.raises(ValueError):
        index.read_index(spark, path, "other")
    with pytest.raises(ValueError):
        index.write_index(fresh, path, "toy", 3, mode="append")
    with pytest.raises(Exception, match="components"):
        index.write_index(df, str(tmp_path / "bad"), "toy", 3)
    with pytest.raises(Exception, match="match"):
        index.with_vectors(df.drop("embedding"), df.select("chunk_idx", "embedding").limit(3)).collect()
    files = str(tmp_path / "files")
    index.export_files(df, files)
    assert list(json.load(open(f"{files}/meta.json"))[0]) == ["vod_id", "text", "start", "end"]
    with open(f"{files}/vectors.f32", "ab") as f:
        f.write(b"\0\0\0")
    back = index.import_files(spark, files, block=4).orderBy("chunk_idx").select(df.columns).collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in rows]


def test_command_line_and_stream(spark, tmp_path):
    raw = tmp_path / "subs" / "channel" / "raw"
    raw.mkdir(parents=True)
    (raw / "v1.vtt").write_text(FILE)
    weights, vocab = str(tmp_path / "m.safetensors"), tmp_path / "vocab.txt"
    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *[x + c for c in "abcdefghijklmnopqrstuvwxyz" for x in ("", "##")]]
    vocab.write_text("\n".join(tokens))
    config = PRESETS["mini-lm"].__class__(384, 12, 1, 64)
    safetensors.write(weights, toy_weights(config, len(tokens)))
    PRESETS["mini-lm"], kept = config, PRESETS["mini-lm"]
    try:
        base = ["-q", "hello chat", "--subs", str(tmp_path / "subs"), "--index", str(tmp_path / "ix"), "--weights", weights, "--vocab", str(vocab), "-p", "-1"]
        saved = cli.run(spark, cli.parser().parse_args(["save", *base]))
        assert saved == cli.run(spark, cli.parser().parse_args(["load", *base])) and saved[0][0] == 0 and saved[0][2].startswith("https://youtube.com/watch?v=v1&t=")
        with pytest.raises(SystemExit):
            cli.parser().parse_args(["load"])
        from cuesift.streaming.ingest import append_files

        (raw / "v2.vtt").write_text(FILE)
        files = [str(raw / "v1.vtt"), str(raw / "v2.vtt")]
        for _ in range(2):
            append_files(spark, files, 0, str(tmp_path / "ix"), load_vocab(str(vocab)), weights, config, "mini-lm")
        assert sorted(r[0] for r in index.read_index(spark, str(tmp_path / "ix")).select("vod_id").collect()) == ["v1"] * 4 + ["v2"] * 4
    finally:
        PRESETS["mini-lm"] = kept


def test_embed_keeps_rows(spark, tmp_path):
    path = str(tmp_path / "w.safetensors")
    safetensors.write(path, toy_weights(TOY, len(VOCAB)))
    df = spark.createDataFrame([(i, "hello " * i) for i in range(20)] + [(20, None)], "i int, text string")
    out = {r["i"]: r["embedding"] for r in embed(df, WordPiece(VOCAB), path, TOY, batch=3).collect()}
    model = Encoder(toy_weights(TOY, len(VOCAB)), TOY)
    assert len(out) == 21 and np.allclose(out[5], model.embed([WordPiece(VOCAB).encode("hello " * 5)])[0], atol=1e-5)


def test_stream(spark, tmp_path):
    from cuesift.streaming.ingest import ingest_stream

    weights = str(tmp_path / "w.safetensors")
    safetensors.write(weights, toy_weights(TOY, len(VOCAB)))
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.vtt").write_text(FILE)
    (tmp_path / "lists").mkdir()
    path = str(tmp_path / "ix")
    empty = spark.createDataFrame([], "chunk_idx long, vod_id string, text string, start double, end double, embedding array<float>")
    index.write_index(empty, path, "toy", TOY.hidden, buckets=2)
    for turn, names in enumerate((["a"], ["a", "b"], ["c"])):
        (tmp_path / "lists" / f"{turn}.txt").write_text("".join(f"{tmp_path}/{n}.vtt\n" for n in names))
        paths = spark.readStream.text(str(tmp_path / "lists")).withColumnRenamed("value", "path")
        ingest_stream(paths, path, str(tmp_path / "checkpoint"), WordPiece(VOCAB), weights, TOY, "toy").awaitTermination(60)
    rows = index.read_index(spark, path, "toy").collect()
    assert sorted(r["vod_id"] for r in rows) == ["a"] * 4 + ["b"] * 4 + ["c"] * 4 and len({r["chunk_idx"] for r in rows}) == 12


def test_attention_in_blocks():
    """Scores of one block of sequences at a time are held, and scores that exp can't take are shifted first."""
    import tracemalloc

    model = Encoder(toy_weights(TOY, len(VOCAB)), TOY, np.float64)
    ids = [[2, *[4 + (i + j) % 10 for j in range(254)], 3] for i in range(64)]
    tracemalloc.start()
    together = model.embed(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and np.allclose(together[7], model.embed([ids[7]])[0], atol=1e-12)
    rng = np.random.default_rng(1)
    for scale in (1.0, 40.0):
        q, k, v = (rng.normal(size=(3, 2, 5, 4)) * s for s in (scale, scale, 1.0))
        out = np.where(np.arange(5) < np.array([5, 3, 1])[:, None], 0, -1e30)[:, None, None, :]
        scores = q @ k.transpose(0, 1, 3, 2) + out
        scores = np.exp(scores - scores.max(-1, keepdims=True))
        assert np.allclose(model._context(q, k, v, out), scores / scores.sum(-1, keepdims=True) @ v, atol=1e-12)
