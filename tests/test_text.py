import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuesift.functions import text

COLLAPSE = [
    ("I'll I'll I'll wake up", 3, 1, "I'll wake up"),
    ("No, no, no, no, no. Happy debut.", 3, 1, "No. Happy debut."),
    ("Yes. Yes. Yes. Yes. Okay.", 3, 1, "Yes. Okay."),
    ("we do we do we do it", 3, 1, "we do it"),
    ("a a b a a b", 3, 1, "a b"),
    ("Maybe we do two streams.", 3, 1, "Maybe we do two streams."),
    ("Yes. Yes. Yes. Yes.", 3, 2, "Yes. Yes."),
    ("ha ha ha ha ha!", 4, 3, "ha ha ha!"),
    ("ha ha ha", 4, 3, "ha ha ha"),
    ("a b a b a b a b c", 4, 3, "a b a b a b c"),
    ("- - - - - x", 4, 3, "- - - - - x"),
    ("no, NO. no? no! no -", 4, 0, "no -"),
    ("a b c d e " * 4, 4, 3, ("a b c d e " * 4).strip()),
    ("  x\t y ", 4, 3, "x y"),
    ("", 4, 3, ""),
    ("a - a - a - a -", 4, 3, "a - a - a "),
    ("Yes! yes yes yes yes...", 4, 3, "Yes! yes yes..."),
]
TIMECODES = [
    ("00:00:01.5", 1.005), ("00:00:01,500", None), ("01:02.030", 62.03), ("c.colorE5E5E5", None), ("1:02:03.250", 3723.25), ("5.", None), (" 00:01.5 ", 1.005),
    ("x.5", None), ("00:00:01.5.6", 1.0056), ("00::01.5", None), ("1e1.0", 10.0), ("inf.0", float("inf")), ("1_0.0", None), ("1d.0", None), ("", None), ("+1.5", 1.005),
]


@pytest.mark.parametrize("source,n,keep,want", COLLAPSE)
def test_collapse(source, n, keep, want):
    assert text.collapse_text(source, n, keep) == want


def test_collapse_column(spark):
    rows = spark.createDataFrame([("ha ha ha ha ha!",), (None,), ("",)], "s string").select(text.collapse(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in rows] == ["ha ha ha!", None, ""]


def test_norms_that_are_kept_are_short():
    kept = text._short_norm.cache_info().currsize
    assert text.norm("A-" * 500) == "a" * 500 and text._short_norm.cache_info().currsize == kept


def test_results_in_parts(monkeypatch):
    """Results become Arrow arrays part by part, not as one list of all strings of a batch."""
    import pyarrow as pa

    sizes, array = [], pa.array
    monkeypatch.setattr(text, "HELD", 40)
    monkeypatch.setattr(text.pa, "array", lambda x, *a: (sizes.append(len(x)), array(x, *a))[1])
    rows = ["ha " * 5, None, "", "x" * 30] * 9
    got = text._each(array(rows, pa.string()), text.collapse_text)
    assert got.to_pylist() == [None if r is None else text.collapse_text(r) for r in rows] and max(sizes) <= 12


def slow_collapse(source, most, keep):
    """The definition, step by step."""
    tokens, keep = text.split_ws(source), max(keep, 1)
    while True:
        norms, out, i, changed = [text.norm(t) for t in tokens], [], 0, False
        while i < len(tokens):
            done = False
            for n in range(1, most + 1):
                if i + 2 * n > len(tokens):
                    break
                if not any(norms[i : i + n]):
                    continue
                reps = 1
                while norms[i + reps * n : i + (reps + 1) * n] == norms[i : i + n]:
                    reps += 1
                if reps > keep:
                    out.extend(tokens[i : i + keep * n])
                    out[-1] = text.with_tail(out[-1], tokens[i + reps * n - 1])
                    i, changed, done = i + reps * n, True, True
                    break
            if not done:
                out.append(tokens[i])
                i += 1
        if not changed:
            return " ".join(out)
        tokens = out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "A.", "-", "b!", "'"]), max_size=24), st.integers(1, 4), st.integers(0, 3))
def test_collapse_like_its_definition(words, most, keep):
    assert text.collapse_text(" ".join(words), most, keep) == slow_collapse(" ".join(words), most, keep)


def test_collapse_words_is_its_single_word_pass(spark):
    from cuesift.operators.collapse import collapse_words

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "A,", "a.", "b", "-", "b!"]) for _ in range(rng.randrange(20)))) for i in range(60)] + [(60, ""), (61, "x")]

    def once(source):
        tokens = text.split_ws(source)
        norms = [text.norm(t) for t in tokens]
        return " ".join(text._one_pass(tokens, norms, 1, 3) or tokens)

    got = dict(collapse_words(spark.createDataFrame(rows, "i int, s string"), "i", "s", 3).collect())
    assert got == {i: once(s) for i, s in rows}


def test_timecodes(spark):
    df = spark.createDataFrame([(s,) for s, _ in TIMECODES], "s string")
    assert [r[0] for r in df.select(text.parse_timecode(F.col("s"))).collect()] == [w for _, w in TIMECODES]
    assert [text.timecode(s) for s, _ in TIMECODES] == [w for _, w in TIMECODES]


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


def test_tags_and_cleaning(spark):
    assert one(spark, text.strip_tags, "a <b>c</b> >> d <unclosed e") == "a c  d "
    assert one(spark, text.clean_caption, "a\tb\nc >> vakvax") == "a b c  vacvac's"
    assert one(spark, text.query_nouns, "WALF kerobel Tini") == "wolf carobel tiny" == text.fix_query("WALF kerobel Tini")


@pytest.mark.parametrize(
    "a,b,least,want",
    [("It will either", "will either be the Stanley Parable", 2, "It will either be the Stanley Parable"), ("a  b", "c", 1, "a  b c"), ("a  b", "c", 0, "a b c"), ("x Y,", "y z", 1, "x Y, z"), ("a", "a", 2, "a a")],
)
def test_merge_overlap(spark, a, b, least, want):
    assert one(spark, lambda x, y: text.merge_overlap(x, y, least), a, b) == want


def test_norms_and_tokens(spark):
    for token in ["Don't!", "ΟΔΟΣ", "naïve—", "٣५", "कि", "…", "", "İx"]:
        assert one(spark, text.norm_token, token) == text.norm(token), token
    assert one(spark, text.basic_tokens, "Hi, you're 2,5€ 👍\x00ÉΣ") == ["hi", ",", "you", "'", "re", "2", ",", "5", "€", "👍", "éσ"]
    for first, last in [("no,", "no."), ("-", "x!"), ("a?!", "--"), ("", ""), ("a", "b'")]:
        assert one(spark, text.merge_punct, first, last) == text.with_tail(first, last), (first, last)


def test_entities():
    assert text.decode_word("&nbsp;&amp;&lt;&gt;&quot;&#39;") == " &<>\"'"
    assert text.decode_word("&amp &notit; &#x41; &#65; ﬁ &#xD800; &#99999999;") == "&amp &notit; A A fi &#xD800; &#99999999;"
