"""Words of whole Arrow string columns as 64-bit hashes, by numpy over the UTF-8 bytes.

A word class over code points that treats everything from U+0080 on alike is a class over UTF-8
bytes, so no text is decoded. Words are hashed after A-Z went to a-z. Beside the hashes (8 bytes a
word) only a quarter of a megabyte is worked on at a time, however long a text is.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

STEP = 1 << 18
_BASE = 0x9E6C63D0676A9A99
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
#: Everything but blanks (space, tab to carriage return).
NON_BLANK = np.ones(256, bool)
NON_BLANK[[32, 9, 10, 11, 12, 13]] = False
#: Letters and digits of ASCII and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: list[np.ndarray] = []


def release() -> None:
    """Gives freed memory back to the system, so that idle workers of earlier stages hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def powers() -> list[np.ndarray]:
    if not _powers:
        for x in (_BASE, _INVERSE):
            p = np.full(STEP + 1, x, _U)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry at the end); nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and where each text's words begin among them (one more entry at the end)."""
    flags = is_word[data]
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = flags[inner]
    last[inner - 1] = flags[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    del flags, first, last
    out = np.empty(len(start), _U)
    up, down = powers()
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STEP, "right")))
        base, stop = start[i], end[j - 1]
        if stop - base > STEP:  # one word longer than a step
            out[i] = int.from_bytes(hashlib.blake2b(LOWER_BYTES[data[base:stop]].tobytes(), digest_size=8).digest(), "little")
        else:
            sums = np.zeros(stop - base + 1, _U)
            np.cumsum((LOWER_BYTES[data[base:stop]].astype(_U) + _U(1)) * up[: stop - base], out=sums[1:])
            s, e = start[i:j] - base, end[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * down[s])
        i = j
    return out, np.searchsorted(start, bounds)


def gram_hashes(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash for each run of n words, runs across texts included; as many as there are words, less n - 1."""
    if len(words) < n:
        return np.zeros(0, _U)
    m = len(words) - n + 1
    out, power = words[:m].copy(), 1
    for k in range(1, n):
        power = power * factor & 0xFFFFFFFFFFFFFFFF
        out += words[k : k + m] * _U(power)
    return mix(out)
