"""A decoder-only transformer as an embedder, in numpy: the last token's state at unit length.

Root-mean-square norms, grouped-query attention with rotary positions, optional query and key norms and
biases, gated feed-forward layers. Weights come from a model file's tensors; a batch of texts is embedded by
one task, the weights are read there once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from waymark.sources.model_file import Q8_0, dequantize, parse


def rms(x: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * weight


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def rotate(x: np.ndarray, base: float) -> np.ndarray:
    """Rotary positions; x: tokens, heads, size. The halves of a head are the pairs' two parts."""
    n, half = len(x), x.shape[-1] // 2
    angle = np.arange(n)[:, None] * base ** (-np.arange(half) / half)
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    a, b = x[..., :half], x[..., half:]
    return np.concatenate([a * cos - b * sin, a * sin + b * cos], -1)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Causal; each key head serves the same number of query heads."""
    n, heads, size = q.shape
    group = heads // k.shape[1]
    k, v = np.repeat(k, group, 1), np.repeat(v, group, 1)
    s = np.einsum("ihd,jhd->hij", q, k) / np.sqrt(size)
    s = np.where(np.tril(np.ones((n, n), bool)), s, -np.inf)
    return np.einsum("hij,jhd->ihd", softmax(s), v).reshape(n, heads * size)


class Quantized:
    """A matrix of 8-bit blocks of 32 with a scale each, multiplied and looked up without being unpacked as a whole."""

    ROWS = 1024

    def __init__(self, raw: bytes, rows: int, columns: int):
        b = np.frombuffer(raw, np.dtype([("d", "<f2"), ("q", "i1", 32)])).reshape(rows, columns // 32)
        self.d, self.q = b["d"], b["q"]

    def rows(self, at) -> np.ndarray:
        d, q = self.d[at].astype(np.float32), self.q[at]
        return (d[..., None] * q).reshape(*d.shape[:-1], -1)

    def product(self, x: np.ndarray) -> np.ndarray:
        """x times the transposed matrix, ROWS of its rows at a time."""
        return np.concatenate([x @ self.rows(slice(i, i + self.ROWS)).T for i in range(0, len(self.d), self.ROWS)], -1)


@dataclass
class Model:
    weights: dict[str, np.ndarray | Quantized]
    layers: int
    heads: int
    kv_heads: int
    eps: float = 1e-6
    base: float = 1e6

    @staticmethod
    def load(raw: bytes) -> Model:
        """Raises ValueError for a file without tensors, or of another architecture."""
        meta, tensors = parse(raw)
        arch = meta.get("general.architecture")
        if not tensors or arch not in ("qwen2", "qwen3"):
            raise ValueError("not a model that can be run")
        w = {}
        for t in tensors:
            if t["name"] != "output.weight":
                if t["dtype"] == Q8_0 and len(t["dims"]) == 2:
                    w[t["name"]] = Quantized(t["data"], t["dims"][1], t["dims"][0])
                    continue
                x = dequantize(t["data"], t["dtype"])
                w[t["name"]] = x.reshape(t["dims"][::-1]) if len(t["dims"]) > 1 else x
        get = lambda k, d: meta.get(f"{arch}.{k}", d)
        return Model(w, get("block_count", 28), get("attention.head_count", 16), get("attention.head_count_kv", 8), get("attention.layer_norm_rms_epsilon", 1e-6), get("rope.freq_base", 1e6))

    def _linear(self, name: str, x: np.ndarray) -> np.ndarray:
        w = self.weights[f"{name}.weight"]
        out = w.product(x) if isinstance(w, Quantized) else x @ w.T
        return out + self.weights[f"{name}.bias"] if f"{name}.bias" in self.weights else out

    def embed(self, ids: list[int]) -> np.ndarray:
        table = self.weights["token_embd.weight"]
        x = (table.rows(ids) if isinstance(table, Quantized) else table[ids]).astype(float)
        for i in range(self.layers):
            p = f"blk.{i}"
            h = rms(x, self.weights[f"{p}.attn_norm.weight"], self.eps)
            q, k, v = (self._linear(f"{p}.attn_{c}", h).reshape(len(ids), n, -1) for c, n in (("q", self.heads), ("k", self.kv_heads), ("v", self.kv_heads)))
            if f"{p}.attn_q_norm.weight" in self.weights:
                q, k = rms(q, self.weights[f"{p}.attn_q_norm.weight"], self.eps), rms(k, self.weights[f"{p}.attn_k_norm.weight"], self.eps)
            x = x + self._linear(f"{p}.attn_output", attention(rotate(q, self.base), rotate(k, self.base), v))
            h = rms(x, self.weights[f"{p}.ffn_norm.weight"], self.eps)
            x = x + self._linear(f"{p}.ffn_down", silu(self._linear(f"{p}.ffn_gate", h)) * self._linear(f"{p}.ffn_up", h))
        last = rms(x[-1], self.weights["output_norm.weight"], self.eps)
        n = np.sqrt((last * last).sum())
        return last / n if n > 0 else last


def embedder(read_model, encode):
    """For semantic.embed: read_model() gives the file's bytes and encode(text) the token ids, both on the executor."""

    def run(batches):
        model = None
        for pdf in batches:
            model = model or Model.load(read_model())
            yield pd.DataFrame({"id": pdf["id"], "embedding": [model.embed(encode(t)).astype(np.float32) for t in pdf["input"]]})

    return run
