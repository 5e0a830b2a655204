"""Word shingles of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd factors of the combined hash: arbitrary fixed values.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
WORDS = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """A-Z lower-cased, words between ASCII white space, distinct runs of `size` words; fewer words are one run."""

    def __init__(self, size: int = 5):
        self.size = size
        self.known = _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > WORDS:
            self.known.clear()
        w = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(w))
        n = len(w) - k + 1
        with np.errstate(over="ignore"):
            h = np.full(n, k, np.uint64)
            for i in range(k):
                h = (h ^ (h >> np.uint64(29))) * _FACTORS[i] + w[i : i + n]
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        h.sort()
        if n > 1:
            keep = np.empty(n, bool)
            keep[0] = True
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            h = h[keep]
        return h


def set_key(tokens: np.ndarray) -> bytes:
    """16 bytes that are equal for equal sets."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
