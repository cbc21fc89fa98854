"""WordPiece over a vocabulary of any size: lower-casing basic tokens, greedy longest pieces, whole-word [UNK]."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

MAX_LEN, MAX_WORD = 256, 100
#: So many characters of a text are looked at first, then eight times as many.
PART = 1024
SPECIAL = ("[CLS]", "[SEP]", "[PAD]", "[UNK]")
_BASIC = regex.compile(r"[\p{Alphabetic}\p{N}]+|[^\p{Alphabetic}\p{N}\p{White_Space}\p{Cc}]")


class WordPiece:
    """A vocabulary and its encoder. lines: one token a line; a later duplicate takes the id."""

    def __init__(self, lines: list[str], max_len: int = MAX_LEN):
        if max_len < 1:
            raise ValueError("max_len must be at least 1")
        self.lines, self.max_len = lines, max_len
        self.ids = {token.rstrip(): i for i, token in enumerate(lines)}
        missing = [t for t in SPECIAL if t not in self.ids]
        if missing:
            raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
        self.cls, self.sep, self.pad, self.unk = (self.ids[t] for t in SPECIAL)
        self.longest = max(map(len, self.ids))
        self.word = lru_cache(1 << 16)(self._word)

    def __reduce__(self) -> tuple:
        return WordPiece, (self.lines, self.max_len)

    def _word(self, word: str) -> tuple[int, ...]:
        if len(word) > MAX_WORD:
            return (self.unk,)
        out, start = [], 0
        while start < len(word):
            lead = "##" if start else ""
            for end in range(min(len(word), start + self.longest), start, -1):
                piece = self.ids.get(lead + word[start:end])
                if piece is not None:
                    out.append(piece)
                    start = end
                    break
            else:
                return (self.unk,)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """[CLS], pieces, [SEP]: at most max_len ids. No more of the text is looked at than they need."""
        size = PART
        while True:
            part = text[:size]
            low = part.replace("Σ", "σ").lower()  # each character on its own: the capital sigma alone looks at its neighbours
            ids, whole = [self.cls], size >= len(text)
            for m in _BASIC.finditer(low):
                if len(ids) >= self.max_len - 1 or not whole and m.end() == len(low):  # a word that may go on
                    break
                ids += self.word(m.group())
            if whole or len(ids) >= self.max_len - 1:
                return ids[: self.max_len - 1] + [self.sep]
            size *= 8

    def decode(self, ids: list[int]) -> list[str]:
        return [self.lines[i] for i in ids]


def encode(spark: SparkSession, vocab: WordPiece, text: Column) -> Column:
    """array<int> of ids; the vocabulary is broadcast (it is a model's, of some tens of thousands of lines)."""
    held = spark.sparkContext.broadcast(vocab)

    @arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([held.value.encode(x.as_py()) if x.is_valid else None for x in texts], pa.list_(pa.int32()))

    return run(text)


def decode(vocab: WordPiece, ids: Column) -> Column:
    """array<string> of the tokens as they stand in the vocabulary; an id outside it is an error."""

    @arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        if len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < len(vocab.lines):
            raise ValueError("an id lies outside the vocabulary")
        tokens = pc.take(pa.array(vocab.lines, pa.string()), flat)
        ends = np.r_[0, np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens, mask=column.is_null())

    return run(ids)
