"""Words and their hashes for whole batches of texts at once.

No hash here is a polynomial modulo a power of two: for these, whatever the
base, there are pairs of distinct strings of 1,024 symbols with equal hashes.
Each step goes through a finaliser instead, so equal hashes of distinct words or
sequences come about by chance only, with 2**-64 a pair and seed.
"""

from __future__ import annotations

import hashlib

import numpy as np

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SEEDS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Longer words are hashed one by one.
LONG = 64
#: The bytes of a little-endian lane that belong to a word with so many left.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LEFT, _RIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A hash of buf[start:end] for each segment: lanes of eight bytes, chained through the finaliser."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + np.uint64(seed))
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded.data, 0, (1,))
    short = size <= LONG
    at, k = (None, 0) if short.all() else (np.flatnonzero(short), 0)
    while at is None or len(at):
        left = (size if at is None else size[at]) - k
        if at is None:
            out = mixed(out ^ (lanes[starts] & _MASK[np.minimum(left, 8)]))
            at = np.flatnonzero(left > 8)
        else:
            out[at] = mixed(out[at] ^ (lanes[starts[at] + k] & _MASK[np.minimum(left, 8)]))
            at = at[left > 8]
        k += 8
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return out


def window_hashes(values: np.ndarray, n: int, seed: int = SEEDS[0]) -> np.ndarray:
    """A hash of values[i:i+n] for every i, put together from stretches of doubled widths."""
    count = max(len(values) - n + 1, 0)
    level, width, done, out = mixed(values ^ np.uint64(seed)), 1, 0, None
    while count:
        if n & width:
            part = level[done : done + count]
            out = part if out is None else mixed(out * _LEFT + part * _RIGHT)
            done += width
        if 2 * width > n:
            return out
        level = mixed(level[:-width] * _RIGHT + level[width:] * _LEFT)
        width *= 2
    return np.empty(0, np.uint64)


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text (and in all)."""
    inside = ~WHITE[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(buf))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, seed: int = SEEDS[0]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text."""
    starts, ends, before = word_bounds(buf, offsets)
    return byte_hashes(buf, starts, ends, seed), before
