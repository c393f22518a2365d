"""Word and shingle hashes of a batch of texts, in numpy.

The texts of a batch are laid end to end as UTF-8 bytes; a word is a run of
bytes that are no separators. Word hashes come from one running sum of
byte * R**position (mod 2**64), made position-free by R**-start, then mixed.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5

# Separator bytes. SPACES: as in [^\x20\x09-\x0D]+; PUNCTUATION: all of ASCII but
# letters and digits (a byte of a non-ASCII character belongs to a word).
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[:128] = [not chr(c).isalnum() for c in range(128)]

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        filled, factor = 1, base
        while filled < size:  # doubling: p[k:2k] = p[:k] * base**k
            take = min(filled, size - filled)
            out[filled:filled + take] = out[:take] * np.uint64(factor)
            factor = factor * factor % (1 << 64)
            filled += take
        _POWERS[base] = have = out
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each text and the total)."""
    joined = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])  # after each text's stop byte
    in_word = ~separators[joined]
    in_word[ends_of - 1] = False
    edge = np.diff(in_word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.empty(len(joined) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(_R, len(joined)), out=sums[1:])
    words = (sums[ends] - sums[starts]) * _powers(_R_INV, len(joined))[starts]
    first = np.searchsorted(starts, np.concatenate(([0], ends_of)))
    return mixed(words), first


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of its first word, number of the text) of every run of k
    words within a text."""
    n = len(words)
    if n < k:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text_of[:n - k + 1] == text_of[k - 1:])
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        total = mixed(total + words[j:n - k + 1 + j] + np.uint64(j + 1))
    return total[at], at, text_of[at]


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = SHINGLE,
                   short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every run of k words within a text. With
    ``short`` a text of 1 to k-1 words has one shingle, all its words."""
    out, _, of = windows(words, first, k)
    if short:
        sizes = np.diff(first)
        lone = np.flatnonzero((sizes > 0) & (sizes < k))
        if len(lone):
            extra = np.zeros(len(lone), dtype=np.uint64)
            for j in range(k - 1):
                has = sizes[lone] > j
                extra[has] = mixed(extra[has] + words[first[lone[has]] + j] + np.uint64(j + 1))
            out, of = np.concatenate([out, mixed(extra + np.uint64(77))]), np.concatenate([of, lone])
    return out, of


def batches(texts: list, most_bytes: int = 1 << 20, most_texts: int = 1 << 30):
    """Slices of a list of texts (None: empty) with about ``most_bytes`` each, and no
    more than ``most_texts``, so the arrays above stay bounded; one longer text is a
    slice of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (size + n > most_bytes or i - start >= most_texts):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
