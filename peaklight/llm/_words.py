"""Word and shingle hashes of whole blocks of text, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
MULT = U(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT to the powers 0..n-1 and the same of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", MULT), ("down", _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


#: One random number for each byte; A-Z count as a-z.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
FOLDED = BYTE.copy()
FOLDED[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def segment_hashes(data: np.ndarray, table: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true; a run ends where a row ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lowered, and the offsets of the rows in them."""
    starts, ends = spans(~SPACE[data], offsets)
    return segment_hashes(data, FOLDED, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of k words.

    A row with 1 to k-1 words has one shingle, the whole sequence; one without words has none.
    """
    words, at = word_hashes(data, offsets)
    seed = U(0x8CB92BA72F3D8DD7)
    rolled = words.copy()
    for j in range(1, k):
        if len(words) > j:
            rolled = mix(rolled[: len(words) - j] * seed + words[j:])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            x = words[a : a + 1]
            for j in range(a + 1, b):
                x = mix(x * seed + words[j : j + 1])
            out.append(mix(x + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
