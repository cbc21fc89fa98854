import os

import pytest

from cuesift.functions.captions import Word, chunk_words, file_chunks, line_words, parse_captions, plain
from cuesift.sources.captions import PER_FILE, find_files, read_chunks, read_words

FILE = """WEBVTT
Kind: captions
Language: en

00:00:00.080 --> 00:00:02.000 align:start position:0%
\x20
Hello<00:00:00.400><c> chat,</c><00:00:00.900><c> VAK</c><00:00:01.200><c> here</c>

00:00:02.000 --> 00:00:02.010 align:start position:0%
Hello chat, VAK here
\x20

00:00:02.010 --> 00:00:20.000 align:start position:0%
Hello chat, VAK here
&gt;&gt;<00:00:02.500><c> [&nbsp;__&nbsp;]</c><00:00:16.000><c> no</c><00:00:16.100><c> no</c><00:00:16.200><c> no</c><00:00:16.300><c> no!</c>

00:00:46.000 --> 00:00:47.000
VAX stream

00:00:47.000 --> 00:00:48.000
VAX stream
"""
WORDS = [("hello", 0.08), ("chat,", 0.4), ("vak", 0.9), ("here", 1.2), (">>", 2.01), ("[swears]", 2.5), ("no", 16.0), ("no", 16.1), ("no", 16.2), ("no!", 16.3), ("vax", 46.0), ("stream", 46.0), ("vax", 47.0), ("stream", 47.0)]


def rounded(words):
    return [(w, round(t, 6)) for w, t in words]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_file_to_words_to_chunks(newline):
    source = FILE.replace("\n", newline)
    words = parse_captions(source)
    # a fraction counts milliseconds
    assert [w.text for w in words] == [w for w, _ in WORDS]
    assert [round(w.t, 6) for w in words] == [t for _, t in WORDS]
    chunks = [(round(c.start, 6), round(c.end, 6), c.text) for c in file_chunks("x.en.vtt", source)]
    assert chunks == [(0.08, 16.3, "hello chat, vac here [swears] no no no!"), (16.0, 16.3, "no no no!"), (46.0, 47.0, "vac's stream vac's stream"), (46.0, 47.0, "vac's stream vac's stream")]


def test_lines():
    assert plain("a <b>c</b> >> d <unclosed e") == "a c  d "
    assert [w.text for w in line_words("a <b>c</b> >> d <unclosed e", 0.0)] == ["a", "c", ">>", "d"]
    assert line_words("a<c>b", 1.0) == [Word("ab", 1.0)]
    assert line_words("&Eacute;", 0.0) == [Word("é", 0.0)]


def test_windows_never_end():
    with pytest.raises(ValueError):
        chunk_words([Word("a", 0.0)], "v", 30.0, 0.0)
    with pytest.raises(ValueError):
        chunk_words([Word("a", 0.0), Word("b", float("inf"))], "v")
    assert chunk_words([], "v") == []


def test_corpus(spark, tmp_path):
    raw = tmp_path / "channel" / "raw"
    raw.mkdir(parents=True)
    (tmp_path / "not-a-folder").write_text("x")
    for name in ("_abc.en.vtt", "x.y.vtt", ".dot.vtt"):
        (raw / name).write_text(FILE)
    assert [os.path.basename(p) for p in find_files(str(tmp_path))] == [".dot.vtt", "_abc.en.vtt", "x.y.vtt"]
    chunks = read_chunks(spark, str(tmp_path)).orderBy("chunk_idx").collect()
    assert [(r["chunk_idx"], r["vod_id"]) for r in chunks] == [(f * PER_FILE + i, v) for f, v in enumerate(["", "_abc", "x"]) for i in range(4)]
    assert read_words(spark, str(tmp_path)).count() == 3 * len(WORDS)
    (raw / "bad.vtt").write_bytes(b"00:00:01.000 --> x\n\xff\n")
    with pytest.raises(Exception, match="utf-8"):
        read_chunks(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        find_files(str(tmp_path / "missing"))
