"""SHA-256 over many rows at once, with states that can be kept and resumed.

``hashlib`` objects can be copied but not stored. Here a hash state is eight
32-bit words, so a table can hold it and another task can go on from it. All
inputs are hex digests: 64 characters, which is one SHA-256 block, so a state
after any number of digests stands at a block border.
"""

from __future__ import annotations

import math

import numpy as np

_W = np.uint32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root_bits(p: int, root: int) -> int:
    """The first 32 bits after the point of p's square or cube root."""
    scaled = p << (32 * root)
    if root == 2:
        return math.isqrt(scaled) & 0xFFFFFFFF
    lo, hi = 0, 1 << 40
    while lo < hi:  # integer cube root
        mid = (lo + hi + 1) // 2
        if mid**3 <= scaled:
            lo = mid
        else:
            hi = mid - 1
    return lo & 0xFFFFFFFF


_ROUND = [_W(_root_bits(p, 3)) for p in _primes(64)]
#: The state before any input.
START = np.array([_root_bits(p, 2) for p in _primes(8)], dtype=_W)

_HEX = np.array([(ord(f"{b:02x}"[0]) << 8) | ord(f"{b:02x}"[1]) for b in range(256)], dtype=_W)


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> _W(k)) | (x << _W(32 - k))


def _schedule(block: list) -> list:
    w = list(block)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> _W(3))) + w[t - 7]
                 + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> _W(10))))
    return w


def _rounds(state: np.ndarray, w: list) -> np.ndarray:
    """The states (n x 8) after one more block each."""
    a, b, c, d, e, f, g, h = (state[:, k].copy() for k in range(8))
    for t in range(64):
        x = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (_ROUND[t] + w[t])
        y = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + x, c, b, a, x + y
    return state + np.stack((a, b, c, d, e, f, g, h), axis=1)


def take_digest(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """States (n x 8) after the hex text of digests (n x 32 bytes)."""
    if not len(state):
        return state
    with np.errstate(over="ignore"):
        return _rounds(state, _schedule([(_HEX[digest[:, 2 * j]] << _W(16)) | _HEX[digest[:, 2 * j + 1]]
                                         for j in range(16)]))


def _padding(digests: int) -> list:
    bits = digests * 512
    block = [np.full(1, v, dtype=_W) for v in (0x80000000, *[0] * 13, bits >> 32, bits & 0xFFFFFFFF)]
    with np.errstate(over="ignore"):
        return _schedule(block)


_PADDING = {k: _padding(k) for k in range(4)}


def close(state: np.ndarray, digests: int) -> np.ndarray:
    """Digests (n x 32 bytes) of states that have taken ``digests`` digests."""
    if not len(state):
        return np.empty((0, 32), dtype=np.uint8)
    with np.errstate(over="ignore"):
        out = _rounds(state, _PADDING.get(digests) or _padding(digests))
    return np.ascontiguousarray(out.astype(">u4")).view(np.uint8).reshape(-1, 32)
