"""64-bit hashes of words and word shingles, in whole arrays at a time and alike on every machine."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_U = np.uint64
_draw = np.random.Generator(np.random.PCG64(20_240_501))
#: Odd multipliers by a word's place in its shingle.
_WORD = _draw.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _piece(raw: bytes) -> np.ndarray:
    words = raw.lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, in order."""
    raw = (text or "").encode()
    if len(raw) <= PIECE:
        return _piece(raw)
    parts, k = [], 0
    while k < len(raw):  # pieces end at white space
        found = _GAP.search(raw, k + PIECE)
        e = found.start() if found else len(raw)
        parts.append(_piece(raw[k:e]))
        k = e
    return np.concatenate(parts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of the whole sequence where there are fewer."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _WORD[j]
    return np.unique(mix(total + _U(k)))


class MinHash:
    """Signatures of `size` values. Each is the low 16 bits of the least hash under one function."""

    def __init__(self, size: int = 128):
        d = np.random.Generator(np.random.PCG64(907))
        self.a = d.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = d.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signature(self, s: np.ndarray) -> bytes:
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for k in range(0, len(s), 4096):
            x, y = (s[k : k + 4096] >> _U(32)).astype(np.uint32), s[k : k + 4096].astype(np.uint32)
            v = (x[:, None] + y[:, None] * self.b) * self.a
            v = (v ^ (v >> np.uint32(15))) * self.b
            np.minimum(least, v.min(0), out=least)
        return (least & np.uint32(65535)).astype("<u2").tobytes()
