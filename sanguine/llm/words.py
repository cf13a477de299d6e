"""64-bit hashes of all words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: ASCII punctuation and white space part words; letters are lower-cased before.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, below 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 20)
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def hashed_bytes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges of bytes of a."""
    power, inverse = _power(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(texts: list[str | None], table: bytes = _TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's begin: (words, texts + 1)."""
    coded = [(t or "").lower().encode("utf-8", "replace").translate(table) for t in texts]
    a = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    letter = np.concatenate(([False], a != 32, [False]))
    starts = np.flatnonzero(letter[1:-1] & ~letter[:-2])
    ends = np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
    texts_at = np.concatenate(([0], np.cumsum([len(c) + 1 for c in coded]))) if coded else np.zeros(1, np.int64)
    return hashed_bytes(a, starts, ends), np.searchsorted(starts, texts_at)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
