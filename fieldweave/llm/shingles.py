"""Word shingles of texts as 64-bit hashes, computed for a whole text with array arithmetic."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's next text."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, _U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if size <= 1 << 22:
            _powers[key] = have
    return have[:n]


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word (lower case, split at white space)."""
    data = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    if not data:
        return np.empty(0, _U)
    raw = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * powers(BASE, len(raw)), dtype=_U)))
    return mix((sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), len(raw))[starts])


def shingles(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order and how often each occurs.

    A text of fewer than ``size`` words is one shingle; a text without words has none.
    """
    words = word_hashes(text)
    if not len(words):
        return words, np.empty(0, np.int64)
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, _U)
    for i in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + words[i:len(words) - n + 1 + i]
    return np.unique(mix(out), return_counts=True)
