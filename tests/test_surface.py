import io

from cuesift.functions.register import register
from cuesift.functions.wordpiece import WordPiece
from cuesift.progress import Progress
from cuesift.shared import drop_scratch, globally_ranked, written
from cuesift.sources.manifest import read_manifest, write_manifest
from tests.test_captions import FILE, WORDS
from tests.test_model import VOCAB
from pyspark.sql import functions as F


def test_sql_names(spark):
    register(spark, WordPiece(VOCAB))
    row = spark.sql("select collapse('ha ha ha ha ha!') c, decode_entities('&amp;') d, fix_query('WALF') q, timecode('00:01.500') t, wordpiece('hello') w, collapse(null) n").first()
    assert tuple(row) == ("ha ha ha!", "&", "wolf", 1.5, [2, 6, 3], None)
    spark.createDataFrame([(FILE,)], "body string").createOrReplaceTempView("files")
    words = spark.sql("select w.* from files, lateral caption_words(body) w order by seq").collect()
    assert [r["text"] for r in words] == [w for w, _ in WORDS]


def test_manifest(spark, tmp_path):
    paths = spark.createDataFrame([("/x/b/raw/2.vtt",), ("/x/b/raw/1.vtt",), ("/x/a/raw/_3.vtt",)], "path string")
    write_manifest(paths, str(tmp_path / "manifest.json"))
    assert (tmp_path / "manifest.json").read_text() == '{"entries":[{"channel_id":"a","parsed_files":["_3.vtt"]},{"channel_id":"b","parsed_files":["1.vtt","2.vtt"]}]}'
    assert sorted(map(tuple, read_manifest(spark, str(tmp_path / "manifest.json")).collect())) == [("a", "_3.vtt"), ("b", "1.vtt"), ("b", "2.vtt")]
    write_manifest(paths.limit(0), str(tmp_path / "none.json"))
    assert read_manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_progress():
    out = io.StringIO()
    p = Progress("corpus", 3, out)
    p.tick()
    p.tick(2)
    assert out.getvalue() == "\rcorpus: processing 3 items\n\rcorpus: 0%\rcorpus: 33%\rcorpus: 100%" and Progress("x", 0, out).percent == 100


def test_ranks_and_scratch(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("x"), "id").repartition(7)
    ranked = globally_ranked(df, [F.desc("x"), F.asc("id")])
    got = [(r["x"], r["id"]) for r in ranked.orderBy("rank").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and {r[0] for r in ranked.select("rank").collect()} == set(range(1000))
    kept = written(df, "kept")
    assert kept.count() == 1000
    drop_scratch(spark)
