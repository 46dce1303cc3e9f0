"""Hashed character n-grams of whole texts as numpy columns."""

from __future__ import annotations

import numpy as np

BITS = 16
DIMS = 1 << BITS


def grams(text: str, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Bucket of every character n-gram of the lower-cased text, digits as 0 and white space as one blank."""
    lowered = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(lowered.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    c = np.where((c >= 48) & (c <= 57), np.uint64(48), c)
    found = []
    h = np.zeros(len(c), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, max(orders) + 1):
            h = (h[:len(c) - k + 1] * np.uint64(0x100000001B3) + c[k - 1:] + np.uint64(k)) if k <= len(c) else h[:0]
            if k in orders:
                m = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append((m >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts), buckets ascending."""
    g = grams(text)
    if len(g) < 4096:
        return np.unique(g, return_counts=True)
    full = np.bincount(g, minlength=DIMS)
    index = np.flatnonzero(full)
    return index, full[index]
