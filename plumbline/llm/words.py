"""Words of many texts at once, found and hashed on their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plumbline.llm.common import SPACE

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words that are letters, digits or beyond ASCII, and of words that are anything but white space.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
INK = np.array([b not in SPACE for b in range(256)])

_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Bytes that are hashed at once, and the powers of the polynomial's point and of its inverse up to there.
_BLOCK = 1 << 18


def _powers(x: np.uint64) -> np.ndarray:
    out = np.full(_BLOCK, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _BACK = _powers(_P), _powers(_P_INV)


@dataclass
class Words:
    """`low` holds the bytes with A-Z in lower case; word i is low[start[i]:end[i]] of text row[i]; text t has n[t]."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    n: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of a polynomial in its bytes, worked out block by block."""
        begins, ends = np.zeros(len(self.start), np.uint64), np.zeros(len(self.start), np.uint64)
        total, power, back = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
        unshift = np.zeros(len(self.start), np.uint64)
        for lo in range(0, len(self.low), _BLOCK):
            seg = self.low[lo : lo + _BLOCK]
            upto = np.concatenate([total, np.cumsum(_BYTE[seg] * (_POWERS[: len(seg)] * power), dtype=np.uint64) + total])
            x, y = np.searchsorted(self.start, [lo, lo + len(seg)])
            begins[x:y] = upto[self.start[x:y] - lo]
            unshift[x:y] = _BACK[self.start[x:y] - lo] * back
            x, y = np.searchsorted(self.end, [lo + 1, lo + len(seg) + 1])
            ends[x:y] = upto[self.end[x:y] - lo]
            total, power, back = upto[-1:], power * _POWERS[-1:] * _P, back * _BACK[-1:] * _P_INV
        h = (ends - begins) * unshift
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def find_words(data: np.ndarray, offsets: np.ndarray, ink: np.ndarray) -> Words:
    low = LOWER[data]
    inside = ink[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(low, start, end, row, np.bincount(row, minlength=len(offsets) - 1))


def window_hashes(h: np.ndarray, most: int):
    """(length, hashes of the windows that start at each word) for lengths 1 to `most`; ends of texts don't count."""
    acc = np.zeros(0, np.uint64)
    for n in range(1, most + 1):
        if len(h) < n:
            return
        acc = h * _MIX if n == 1 else acc[: len(h) - n + 1] * _Q + h[n - 1 :]
        yield n, acc
