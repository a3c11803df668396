"""Hashed word shingles and MinHash signatures of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from ._common import remember

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_WORDS: dict[bytes, int] = {}
_WORDS_LIMIT = 500_000
remember("shingles", _WORDS)


def words(text: str | None) -> list[bytes]:
    """Words [^ \\t-\\r]+ of the text with A-Z lower-cased, as UTF-8 (bytes.lower and bytes.split do just that)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    if len(_WORDS) > _WORDS_LIMIT:
        _WORDS.clear()
    known = _WORDS
    for w in ws:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def shingle_set(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = word_hashes(ws)
    take = min(width, len(h))
    out = np.full(len(h) - take + 1, take, np.uint64)
    for i in range(take):
        out = mix(out * _A + h[i : len(h) - take + 1 + i] * _B + _C)
    return np.unique(out)


class MinHash:
    """k minima of a set under k maps of the upper half of its hashes."""

    def __init__(self, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            np.minimum(out, (x[at : at + 512, None] * self.mul + self.add).min(0), out=out)
        return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
