"""Vectorised word and shingle hashes for use inside tasks.

Each byte has a random 64-bit value; a word's hash is a polynomial of its bytes, taken from prefix
sums modulo 2**64 and then mixed. Equal words have equal hashes; different words collide with
probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _bytes_table() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    table[65:91] = table[97:123]  # A-Z as a-z
    return table


_BYTES = _bytes_table()
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCT = np.ones(256, bool)
_PUNCT[48:58] = _PUNCT[65:91] = _PUNCT[97:123] = _PUNCT[128:] = False
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size, out = max(n, 1 << 16), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=U))
        if n > 4 * _SEGMENT:
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def word_hashes(text: str | None, punctuation: bool = False) -> np.ndarray:
    """uint64 hash of each word, in order; A-Z count as a-z. punctuation: ASCII punctuation also parts words."""
    raw = (text or "").encode("utf-8", "replace")
    table, parts, at = _PUNCT if punctuation else _SPACE, [], 0
    while len(raw) - at > _SEGMENT:  # very long texts go in segments that end between words
        gaps = np.flatnonzero(table[np.frombuffer(raw, np.uint8, _SEGMENT, at)])
        if len(gaps) and gaps[-1]:
            end = at + int(gaps[-1])
        else:  # no gap but the one that the last segment ended at: on to the next
            rest = np.flatnonzero(table[np.frombuffer(raw, np.uint8, offset=at + 1)])
            end = at + 1 + int(rest[0]) if len(rest) else len(raw)
        parts.append(_hashes(raw[at:end], table))
        at = end
    parts.append(_hashes(raw[at:], table))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _hashes(raw: bytes, parting: np.ndarray) -> np.ndarray:
    if not raw:
        return np.zeros(0, U)
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~parting[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, U)
    up, down = _tables(len(data))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTES[data] * up[: len(data)], dtype=U)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words; fewer words count as one run, none as none."""
    n = len(words)
    if not n:
        return words
    width_here = min(width, n)
    out = np.full(n - width_here + 1, U(width_here), dtype=U)
    for k in range(width_here):
        out = (out ^ (out >> U(29))) * U(0xD6E8FEB86659FD93) + words[k : n - width_here + 1 + k]
    return mix(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(windows(word_hashes(text), width))


def signature(sets: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes, as two signed longs."""
    a = np.add.reduce(mix(sets ^ U(0x5851F42D4C957F2D)), dtype=U) + U(len(sets))
    b = np.add.reduce(mix(sets + U(0x2545F4914F6CDD1D)), dtype=U)
    return int(np.asarray(a).astype(np.int64)), int(np.asarray(b).astype(np.int64))
