"""Ids of public tokenizers for whole texts. The vocabulary's path is a parameter everywhere."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array

#: The split that byte-level BPE of this family is built on.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters alone are split alike by both libraries, whatever their Unicode version.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*\Z")
_ready: dict[str, "ByteBpe"] = {}


class ByteBpe:
    """A tokenizers file of a byte-level BPE; plain texts go through the faster library with the same ranks."""

    def __init__(self, path: str):
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = _same_ranks(path, spec)

    @property
    def slow(self) -> object:
        """The file's own library, loaded when a text asks for it."""
        if self._slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def encode(self, text: str) -> array:
        """The ids without added special tokens, as unsigned 32-bit."""
        if self.fast is not None and _PLAIN.match(text) and not any(s in text for s in self.special):
            try:
                return array("I", self.fast.encode_ordinary(text))
            except BaseException as e:  # its regular expressions panic on some very long runs
                if type(e).__name__ != "PanicException":
                    raise
        return array("I", self.slow.encode(text, add_special_tokens=False).ids)


def _same_ranks(path: str, spec: dict) -> object | None:
    """The faster library's encoder, if the file is a plain byte-level BPE whose ids are ranks; else None."""
    import tiktoken

    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or split.get("use_regex", True) is False:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    try:
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    except KeyError:
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"].get(a + b) for a, b in merges]
    if order != sorted(order):  # merge order must be id order
        return None
    return tiktoken.Encoding(base64.b16encode(path.encode()).decode(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_bpe(path: str) -> ByteBpe:
    """The tokenizer of this path, loaded once a worker."""
    if path not in _ready:
        _ready[path] = ByteBpe(path)
    return _ready[path]
