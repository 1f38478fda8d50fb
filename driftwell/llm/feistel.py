"""A keyed permutation of 0..n-1: a Feistel network over the next power of two, walked until it falls below n."""

from __future__ import annotations

import numpy as np

ROUNDS = 6  # even, so that both halves end with the width they began with


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (two multiply and shift steps)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _widths(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.array([max(2, int(v - 1).bit_length()) for v in n.tolist()], np.uint64)
    low = bits >> np.uint64(1)
    return bits - low, low


def _network(x: np.ndarray, high: np.ndarray, low: np.ndarray, keys: np.ndarray, inverse: bool) -> np.ndarray:
    one = np.uint64(1)
    left, right = x >> low, x & ((one << low) - one)
    left_width, right_width = high.copy(), low.copy()
    with np.errstate(over="ignore"):
        for r in range(ROUNDS):
            turn = np.uint64(ROUNDS - 1 - r if inverse else r)
            key = mix64(keys + turn * np.uint64(0x9E3779B97F4A7C15))
            if inverse:
                left, right = (right ^ mix64(left ^ key)) & ((one << right_width) - one), left
            else:
                left, right = right, (left ^ mix64(right ^ key)) & ((one << left_width) - one)
            left_width, right_width = right_width, left_width
    return (left << right_width) | right


def permute(x: np.ndarray, n: np.ndarray | int, key: np.ndarray | int, inverse: bool = False) -> np.ndarray:
    """Image of each x under the permutation of 0..n-1 that ``key`` selects; n and key may differ from row to row."""
    x = np.asarray(x).astype(np.uint64)
    n = np.broadcast_to(np.asarray(n).astype(np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key).astype(np.uint64), x.shape)
    sizes, where = np.unique(n, return_inverse=True)
    high, low = (w[where.reshape(-1)] for w in _widths(sizes))
    out = _network(x, high, low, key, inverse)
    while (outside := out >= n).any():
        out[outside] = _network(out[outside], high[outside], low[outside], key[outside], inverse)
    return out.astype(np.int64)
