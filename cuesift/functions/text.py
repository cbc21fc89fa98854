"""Text functions. Everything that columns can express is a Column; only the sequential rest is Arrow-batched Python.

White space is Unicode White_Space and alphanumerics are Alphabetic or N*, in Java's and Python's
regular expressions alike; lower-casing a single character at a time knows no final sigma.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from html.entities import html5

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .tensor import bound

WS = r"\p{IsWhite_Space}"
ALNUM = r"\p{IsAlphabetic}\p{N}"
#: What a number may look like in a time code: no blanks, no underscores, no type suffix.
NUMBER = r"^[+-]?(?:(?i:inf|infinity|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def ws_tokens(text: Column) -> Column:
    """The pieces between white space; none for blank text."""
    return F.filter(F.split(text, f"{WS}+"), lambda t: t != "")


def lower_chars(text: Column) -> Column:
    """Each character lower-cased on its own: a capital sigma never becomes a final one."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def strip_tags(text: Column) -> Column:
    """Text outside <...>. An unclosed < eats the rest, and every > goes."""
    return F.regexp_replace(text, "<[^>]*>?|>", "")


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.when(text.rlike("^[+-]?(?i:inf|infinity)$"), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(text.rlike("^[+-]?(?i:nan)$"), F.lit(float("nan"))).otherwise(text.try_cast("double")))


def parse_timecode(text: Column) -> Column:
    """Seconds of h:m:s.f with any number of colons; f counts milliseconds (so .5 is 5 ms). Null if it isn't one."""
    t = trim_ws(text)
    dot = F.instr(t, ".")
    left = F.split(F.substring(t, F.lit(1), dot - 1), ":")
    right = F.substring(t, dot + 1, F.length(t))
    seconds = F.aggregate(left, F.lit(0.0), lambda acc, p: acc * 60 + _number(p))
    return F.when((dot > 0) & right.rlike(NUMBER) & F.forall(left, lambda p: p.rlike(NUMBER)), seconds + _number(right) / 1000)


def clean_caption(text: Column) -> Column:
    """Tabs and line feeds to spaces, no >, and the two channel spellings put right."""
    flat = F.translate(text, "\t\n>", "  ")
    return F.replace(F.replace(flat, F.lit("vak"), F.lit("vac")), F.lit("vax"), F.lit("vac's"))


QUERY_NOUNS = (("walf", "wolf"), ("kerobel", "carobel"), ("tini", "tiny"))


def query_nouns(text: Column) -> Column:
    out = F.lower(text)
    for wrong, right in QUERY_NOUNS:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def fix_query(text: str) -> str:
    """query_nouns for one query on the driver."""
    text = text.lower()
    for wrong, right in QUERY_NOUNS:
        text = text.replace(wrong, right)
    return text


def norm_token(token: Column) -> Column:
    """Letters, digits and apostrophes, in lower case."""
    return lower_chars(F.regexp_replace(token, f"[^{ALNUM}']", ""))


def merge_punct(first: Column, last: Column) -> Column:
    """first without the punctuation at its end, with that of last."""
    body = F.regexp_replace(first, f"[^{ALNUM}']+$", "")
    tail = F.when(last.rlike(f"[{ALNUM}']"), F.regexp_extract(last, f"[^{ALNUM}']*$", 0)).otherwise("")
    return F.concat(body, tail)


def merge_overlap(a: Column, b: Column, least: int) -> Column:
    """a and b joined over the longest run of at least ``least`` tokens that ends a and begins b; else as they are, with a space."""

    def longest(x: Column) -> Column:
        most = F.least(F.size(x["an"]), F.size(x["bn"]))
        sizes = F.sequence(F.lit(least), F.greatest(F.lit(least), most))
        same = lambda k: (k == 0) | (F.slice(x["an"], F.size(x["an"]) - k + 1, F.greatest(k, F.lit(0))) == F.slice(x["bn"], F.lit(1), k))
        return F.when(F.lit(least) <= most, F.array_max(F.filter(sizes, same)))

    def merged(t: Column) -> Column:
        norms = F.struct(F.transform(t["at"], norm_token).alias("an"), F.transform(t["bt"], norm_token).alias("bn"))
        joined = lambda k: F.when(k.isNull(), F.concat(a, F.lit(" "), b)).otherwise(F.array_join(F.concat(t["at"], F.slice(t["bt"], k + 1, F.size(t["bt"]))), " "))
        return bound(bound(norms, longest), joined)

    return bound(F.struct(ws_tokens(a).alias("at"), ws_tokens(b).alias("bt")), merged)


def basic_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; every other visible character is a token of its own."""
    return F.regexp_extract_all(lower_chars(text), F.lit(f"[{ALNUM}]+|[^{ALNUM}{WS}\\p{{Cc}}]"), F.lit(0))


# -- The same in Python, for sequential work within one text -------------------------------

#: Characters of results that are held as Python strings; the longest token whose norm is kept.
HELD, SHORT = 1 << 20, 32
_WS_RUN = re.compile("[\t-\r \x85\xa0  -     　]+")
_NOT_WORD = regex.compile(r"[^\p{Alphabetic}\p{N}']+")
_NOT_WORD_END = regex.compile(r"[^\p{Alphabetic}\p{N}']+\Z")
_NUMBER = re.compile(NUMBER.replace("(?i:inf|infinity|nan)", "[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN]"))
_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z0-9]+);")


def split_ws(text: str) -> list[str]:
    return [t for t in _WS_RUN.split(text) if t]


def strip_ws(text: str) -> str:
    lead = _WS_RUN.match(text)
    start = lead.end() if lead else 0
    end = len(text)
    while end > start and _WS_RUN.fullmatch(text[end - 1]):
        end -= 1
    return text[start:end]


def timecode(text: str) -> float | None:
    """parse_timecode of one string."""
    left, dot, right = strip_ws(text).partition(".")
    parts = left.split(":")
    if not dot or not all(_NUMBER.match(x) and not x.endswith("\n") for x in (right, *parts)):
        return None
    seconds = 0.0
    for p in parts:
        seconds = seconds * 60 + float(p)
    return seconds + float(right) / 1000


def _entity(m: re.Match) -> str:
    name = m.group(1)
    if name[0] != "#":
        return html5.get(name + ";", m.group(0))
    try:
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return m.group(0) if 0xD800 <= code <= 0xDFFF else chr(code)
    except (ValueError, OverflowError):
        return m.group(0)


def decode_word(text: str) -> str:
    """Character references that end in a semicolon, then NFKC."""
    return unicodedata.normalize("NFKC", _ENTITY.sub(_entity, text))


def _norm(token: str) -> str:
    return "".join(c.lower() for c in _NOT_WORD.sub("", token))


_short_norm = lru_cache(1 << 15)(_norm)


def norm(token: str) -> str:
    """norm_token of one string; only short ones are kept, so the cache is small whatever the texts hold."""
    return _short_norm(token) if len(token) <= SHORT else _norm(token)


def with_tail(first: str, last: str) -> str:
    tail = _NOT_WORD_END.search(last)
    return _NOT_WORD_END.sub("", first) + (tail.group(0) if tail and tail.start() > 0 else "")


def _may_repeat(norms: list[str], most: int, keep: int) -> bool:
    """Whether any run of more than ``keep`` equal n-grams can be there: keep * n matches in a row at distance n."""
    for n in range(1, most + 1):
        run = 0
        for x, y in zip(norms, norms[n:]):
            run = run + 1 if x == y else 0
            if run >= keep * n:
                return True
    return False


def _one_pass(tokens: list[str], norms: list[str], most: int, keep: int) -> list[str] | None:
    out, i, changed, total = [], 0, False, len(tokens)
    while i < total:
        for n in range(1, min(most, (total - i) // 2) + 1):
            gram = norms[i : i + n]
            if norms[i + n] != gram[0] or not any(gram):
                continue
            stop = i + n
            while norms[stop : stop + n] == gram:
                stop += n
            if stop - i > keep * n:
                out += tokens[i : i + keep * n]
                out[-1] = with_tail(out[-1], tokens[stop - 1])
                i, changed = stop, True
                break
        else:
            out.append(tokens[i])
            i += 1
    return out if changed else None


def collapse_text(text: str, max_ngram: int = 4, keep: int = 3) -> str:
    """Runs of more than ``keep`` equal n-grams cut to ``keep``, shortest n-grams first, until nothing changes."""
    keep, tokens = max(keep, 1), split_ws(text)
    while True:
        norms = [norm(t) for t in tokens]
        shorter = _one_pass(tokens, norms, max_ngram, keep) if _may_repeat(norms, max_ngram, keep) else None
        if shorter is None:
            return " ".join(tokens)
        tokens = shorter


def _each(texts: pa.Array, f: Callable[[str], str]) -> pa.Array:
    """f of each text, null of null. No more than some megabytes are held as Python strings at a time."""
    parts, out, held = [], [], 0
    for x in texts:
        out.append(f(x.as_py()) if x.is_valid else None)
        held += len(out[-1] or "")
        if held > HELD:
            parts.append(pa.array(out, pa.string()))
            out, held = [], 0
    return pa.concat_arrays([*parts, pa.array(out, pa.string())])


def collapse(text: Column, max_ngram: int = 4, keep: int = 3) -> Column:
    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return _each(texts, lambda x: collapse_text(x, max_ngram, keep))

    return run(text)


def decode_entities(text: Column) -> Column:
    """decode_word over a column; a text without & skips the table."""

    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return _each(texts, decode_word)

    return run(text)
