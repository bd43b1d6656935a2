"""Words of many texts at once, as 64-bit hashes, over the bytes of a batch."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: White space that parts words: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    up, _ = powers(len(codes) + 1)
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(TABLE[codes] * up[: len(codes)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end], the same wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * COEF[-1])


def spans(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in part; a run ends where a row ends."""
    edge = np.zeros(len(part) + 1, bool)
    edge[off] = True
    before = np.zeros(len(part), bool)
    before[1:] = part[:-1]
    before[edge[:-1]] = False
    after = np.zeros(len(part), bool)
    after[:-1] = part[1:]
    after[edge[1:]] = False
    return np.flatnonzero(part & ~before), np.flatnonzero(part & ~after) + 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and where each row's words begin (with the end)."""
    start, end = spans(~SPACE[data], off)
    return range_hash(prefix_hash(LOWER[data]), start, end), np.searchsorted(start, off)


def shingles(words: np.ndarray, first: np.ndarray, n: int):
    """For each row the sorted distinct hashes of its n-word shingles; a shorter row is one shingle."""
    if len(words) >= n:
        whole = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            whole += words[k : len(words) - n + 1 + k] * COEF[k]
        whole = mix(whole)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            u = np.sort(whole[a : b - n + 1])
            keep = np.ones(len(u), bool)
            np.not_equal(u[1:], u[:-1], out=keep[1:])
            yield u[keep]
        elif b > a:
            yield mix((words[a:b] * COEF[32 : 32 + b - a]).sum(keepdims=True) + COEF[40 + b - a])
        else:
            yield np.zeros(0, np.uint64)
