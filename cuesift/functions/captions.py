"""WebVTT captions to timed words to sliding-window chunks, one file at a time."""

from __future__ import annotations

from typing import NamedTuple

from .text import collapse_text, decode_word, split_ws, strip_ws, timecode


class Word(NamedTuple):
    text: str
    t: float


class Chunk(NamedTuple):
    vod_id: str
    text: str
    start: float
    end: float


WINDOW, STRIDE, MAX_NGRAM, KEEP = 30.0, 15.0, 4, 3
MASKED, SPOKEN = "[&nbsp;__&nbsp;]", "[swears]"


def plain(line: str) -> str:
    """The line's text outside tags; an unclosed tag takes the rest, and no > stays."""
    kept = [part if i == 0 else part.partition(">")[2] for i, part in enumerate(line.split("<"))]
    return "".join(kept).replace(">", "")


def line_words(line: str, start: float) -> list[Word]:
    """The words of one cue line. Timecode tags set the time of what follows; other tags vanish without a break."""
    out: list[Word] = []
    now, run = start, []
    head, *tagged = line.replace(MASKED, SPOKEN).lower().split("<")
    run.append(head)
    rest = "<".join(tagged) if tagged else None

    def flush() -> None:
        out.extend(Word(decode_word(w), now) for w in split_ws("".join(run)))
        run.clear()

    while rest is not None:
        tag, _, rest = rest.partition(">")
        if (at := timecode(tag)) is not None:
            flush()
            now = at
        text, more, rest = rest.partition("<")
        run.append(text)
        if not more:
            rest = None
    flush()
    return out


def parse_captions(source: str) -> list[Word]:
    """All words of a file in its order. The first line of a longer cue goes if it repeats the line before it."""
    words: list[Word] = []
    before = ""
    for block in source.replace("\r\n", "\n").split("\n\n"):
        *lines, rest = block.split("\n")
        lines = [x.removesuffix("\r") for x in lines] + [rest] * bool(rest)
        cue = next((i for i, x in enumerate(lines) if "-->" in x), None)
        start = timecode(lines[cue].split("-->")[0]) if cue is not None else None
        if start is None:
            continue
        payload = lines[cue + 1 :]
        if len(payload) > 1 and strip_ws(plain(payload[0])) == before:
            payload = payload[1:]
        for line in payload:
            if strip_ws(line):
                words += line_words(line, start)
                before = strip_ws(plain(line))
    return words


def chunk_words(words: list[Word], vod_id: str, window: float = WINDOW, stride: float = STRIDE) -> list[Chunk]:
    """Half-open windows from the first word on, each as its words' text and first and last times; empty ones are left out.

    Both ends of a window only ever move forward over the words in their order, also where times
    go back. A stride that isn't positive, or an infinite last time, is an error.
    """
    if not words:
        return []
    at, last = words[0].t, words[-1].t
    if not stride > 0 or last == float("inf"):
        raise ValueError("windows would never end")
    out, low = [], 0
    while at <= last:
        while low < len(words) and words[low].t < at:
            low += 1
        high = low
        while high < len(words) and words[high].t < at + window:
            high += 1
        if high > low:
            part = words[low:high]
            out.append(Chunk(vod_id, " ".join(w.text for w in part), part[0].t, part[-1].t))
        at += stride
    return out


def clean_chunk(text: str) -> str:
    text = text.replace("\t", " ").replace("\n", " ").replace(">", "").replace("vak", "vac").replace("vax", "vac's")
    return collapse_text(text, MAX_NGRAM, KEEP)


def file_chunks(name: str, source: str) -> list[Chunk]:
    """The cleaned chunks of one file; the video's id is the file's name up to its first dot."""
    vod_id = name.split(".", 1)[0]
    return [c._replace(text=clean_chunk(c.text)) for c in chunk_words(parse_captions(source), vod_id)]
