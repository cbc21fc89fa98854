"""A BERT-style sentence encoder in numpy, for batches of padded id sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .tensor import ERF


#: So many attention scores are worked on at a time.
CACHED = 1 << 17


@dataclass(frozen=True)
class Config:
    hidden: int
    heads: int
    layers: int
    intermediate: int
    eps: float = 1e-12
    pooling: str = "mean"  # or "cls"


PRESETS = {
    "mini-lm": Config(384, 12, 6, 1536),
    "gte-small": Config(384, 12, 12, 1536),
    "gte-base": Config(768, 12, 12, 3072),
    "e5-large": Config(1024, 16, 24, 4096),
}
MODEL_DIRS = {"mini-lm": "models/all-MiniLM-L6-v2", "gte-small": "models/gte-small", "gte-base": "models/gte-base", "e5-large": "models/e5-large"}


def model_files(name: str) -> tuple[str, str, Config]:
    """Weights file, vocabulary file and configuration of a known model."""
    return f"{MODEL_DIRS[name]}/model.safetensors", f"{MODEL_DIRS[name]}/vocab.txt", PRESETS[name]


def erf(x: np.ndarray) -> np.ndarray:
    of = x.dtype.type
    t = 1 / (1 + of(0.3275911) * np.abs(x))
    poly = np.full_like(t, ERF[0])
    for c in ERF[1:]:
        poly *= t
        poly += of(c)
    poly *= t
    poly *= np.exp(-x * x)
    return np.copysign(1 - poly, x)


def gelu(x: np.ndarray) -> np.ndarray:
    of = x.dtype.type
    out = erf(x * of(np.sqrt(0.5)))
    out += 1
    out *= x
    out *= of(0.5)
    return out


def normed(x: np.ndarray, gamma: np.ndarray, beta: np.ndarray, eps: float) -> np.ndarray:
    part = x.dtype.type(1 / x.shape[-1])
    out = x - np.einsum("...i->...", x)[..., None] * part
    out /= np.sqrt(np.einsum("...i,...i->...", out, out)[..., None] * part + x.dtype.type(eps))
    out *= gamma
    out += beta
    return out


class Encoder:
    """Weights by name (with or without a leading 'bert.') and the forward pass, in single or double precision."""

    def __init__(self, weights: dict[str, np.ndarray], config: Config, dtype: type = np.float32):
        self.config, self.dtype = config, np.dtype(dtype)
        self.weights = {k.removeprefix("bert.") if k.removeprefix("bert.") not in weights else k: np.asarray(v, dtype) for k, v in weights.items()}
        self.types = self["embeddings.token_type_embeddings.weight"][0]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.weights[name]

    def _linear(self, x: np.ndarray, at: str) -> np.ndarray:
        return x @ self[f"{at}.weight"].T + self[f"{at}.bias"]

    def _norm(self, x: np.ndarray, at: str) -> np.ndarray:
        return normed(x, self[f"{at}.weight"], self[f"{at}.bias"], self.config.eps)

    def _context(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, block_out: np.ndarray | None) -> np.ndarray:
        """softmax(q k + block_out) v. Scores are worked on in place, one sequence's at a time or as many as fit a cache.

        No score is larger than the product of the longest q and k. Where that is small, exp can't overflow, and
        taking the maximum off first, which changes nothing else, is left out.
        """
        n, heads, length, _ = q.shape
        longest = lambda y: np.sqrt(np.einsum("nhld,nhld->nhl", y, y).max())
        safe = longest(q) * longest(k) <= np.log(np.finfo(self.dtype).max) / 2
        out, step = np.empty_like(v), max(1, CACHED // (heads * length * length))
        space = np.empty((min(step, n), heads, length, length), self.dtype)
        for i in range(0, n, step):
            part = slice(i, i + step)
            scores = np.matmul(q[part], k[part].transpose(0, 1, 3, 2), out=space[: len(q[part])])
            if block_out is not None:
                scores += block_out[part]
            if not safe:
                scores -= scores.max(-1, keepdims=True)
            np.exp(scores, out=scores)
            np.matmul(scores, v[part], out=out[part])
            out[part] /= scores.sum(-1, keepdims=True)
        return out

    def _layer(self, x: np.ndarray, block_out: np.ndarray | None, at: str) -> np.ndarray:
        n, length, hidden = x.shape
        heads = self.config.heads
        split = lambda y: np.ascontiguousarray(y.reshape(n, length, heads, hidden // heads).transpose(0, 2, 1, 3))
        q, k, v = (split(self._linear(x, f"{at}.attention.self.{w}")) for w in ("query", "key", "value"))
        q *= self.dtype.type(1 / np.sqrt(hidden // heads))
        merged = self._context(q, k, v, block_out).transpose(0, 2, 1, 3).reshape(n, length, hidden)
        a = self._norm(self._linear(merged, f"{at}.attention.output.dense") + x, f"{at}.attention.output.LayerNorm")
        inner = gelu(self._linear(a, f"{at}.intermediate.dense"))
        return self._norm(self._linear(inner, f"{at}.output.dense") + a, f"{at}.output.LayerNorm")

    def forward(self, sequences: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Last hidden states (n, longest, hidden) and the mask of real tokens; shorter sequences are padded with id 0."""
        longest = max(map(len, sequences))
        ids, mask = np.zeros((len(sequences), longest), np.int64), np.zeros((len(sequences), longest), self.dtype)
        for i, s in enumerate(sequences):
            ids[i, : len(s)], mask[i, : len(s)] = s, 1
        x = self["embeddings.word_embeddings.weight"][ids] + self["embeddings.position_embeddings.weight"][:longest] + self.types
        x = self._norm(x, "embeddings.LayerNorm")
        block_out = None if mask.all() else np.where(mask[:, None, None, :] > 0, 0, -1e30).astype(self.dtype)
        for i in range(self.config.layers):
            x = self._layer(x, block_out, f"encoder.layer.{i}")
        return x, mask

    def embed(self, sequences: list[list[int]]) -> np.ndarray:
        """Unit vectors, one a sequence; padding takes no part, so neighbours in a batch don't matter."""
        x, mask = self.forward(sequences)
        pooled = x[:, 0] if self.config.pooling == "cls" else (x * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        return (pooled / np.maximum(np.sqrt((pooled * pooled).sum(1, keepdims=True)), self.dtype.type(1e-12))).astype(self.dtype)
