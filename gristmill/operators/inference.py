"""Int8 inference arithmetic over whole arrays: groups, products, norms, rotation, attention."""

from __future__ import annotations

import numpy as np


def quantise(x: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """8-bit values and one scale per group; rows are padded to whole groups with zeros."""
    pad = -x.shape[-1] % group
    g = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, pad)]).reshape(*x.shape[:-1], -1, group)
    scale = np.abs(g).max(-1) / 127
    q = np.sign(g) * np.floor(np.abs(g) / np.where(scale == 0, 1, scale)[..., None] + 0.5)
    return q.astype(np.int8), scale.astype(np.float32)


def matmul(w: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows of `w` times `x`: 32-bit sums within groups, scales between them."""
    sums = np.einsum("rgk,gk->rg", w[0].astype(np.int32), x[0].astype(np.int32))
    return (sums * w[1] * x[1]).sum(-1).astype(np.float32)


def rmsnorm(x: np.ndarray, weight: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return weight * x / np.sqrt((x * x).mean() + eps)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def rotate(x: np.ndarray, position: int, base: float = 10000.0) -> np.ndarray:
    """Rotary positions over pairs of neighbouring components."""
    half = np.arange(0, x.shape[-1], 2)
    angle = position * base ** (-half / x.shape[-1])
    a, b = x[..., 0::2], x[..., 1::2]
    out = np.empty_like(x)
    out[..., 0::2], out[..., 1::2] = a * np.cos(angle) - b * np.sin(angle), a * np.sin(angle) + b * np.cos(angle)
    return out


def attend(q: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    return softmax(keys @ q / np.sqrt(len(q))) @ values


def swiglu(gate: np.ndarray, up: np.ndarray) -> np.ndarray:
    return gate / (1 + np.exp(-gate)) * up
