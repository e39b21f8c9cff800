"""Hashed n-gram features of a piece of texts: a bucket for every position, and sums of weights by row."""

from __future__ import annotations

import numpy as np

from hourwise.llm.arrays import FOLD, FOLDED_BYTE, U64, Piece, mix, span_hashes, words

U32 = np.uint32
_MUL = [U32(x | 1) for x in np.random.default_rng(5).integers(1 << 20, 1 << 31, 8).tolist()]


def byte_grams(p: Piece, order: int, bits: int, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the n-gram at each byte position, first and end positions by row) for n = ``order``."""
    b = (FOLD[p.buf] if fold else p.buf).astype(U32)
    n = max(0, len(b) - order + 1)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, dtype=U32)
    for i in range(order):
        h += b[i: n + i] * _MUL[i]
        h ^= h >> U32(13)
    h *= U32(0x85EBCA6B)
    lo = np.minimum(p.off[:-1], n)
    return (h >> U32(32 - bits)).astype(np.int32), lo, np.maximum(lo, np.minimum(p.off[1:] - order + 1, n))


def word_grams(p: Piece, order: int, bits: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each run of ``order`` words, first and end positions by row)."""
    w = words(p)
    h = span_hashes(p.buf, w.start, w.end, FOLDED_BYTE) if fold else span_hashes(p.buf, w.start, w.end)
    n = max(0, len(h) - order + 1)
    g = h[:n].copy()
    for i in range(1, order):
        g = g * U64(0x100000001B3) + h[i: n + i]
    lo = np.minimum(w.first[:-1], n)
    return (mix(g + U64(order)) >> U64(64 - bits)).astype(np.int32), lo, np.maximum(lo, np.minimum(w.first[1:] - order + 1, n))


def range_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[hi] - total[lo]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, label: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """(a, b) of the logistic calibration sigmoid(a * score + b), by Newton steps."""
    x, theta = np.column_stack([score, np.ones(len(score))]), np.array([1.0, 0.0])
    start = theta.copy()
    for _ in range(rounds):
        q = sigmoid(x @ theta)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(2), x.T @ (q - label) + ridge * (theta - start))
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])
