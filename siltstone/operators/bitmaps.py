"""Compressed bitmaps over small integers, after the roaring scheme.

The numbers of one key range are split by their upper bits into containers of 65,536; a container
is a sorted array while it is sparse and a bit set when it is dense.
"""

from __future__ import annotations

import numpy as np

#: Fixed sizes of the scheme: a bit set takes 8,192 bytes, as much as 4,096 two-byte numbers.
_DENSE = 4096
_BYTES = 8192


def _pack(low: np.ndarray) -> np.ndarray:
    """A container of distinct sorted numbers below 65,536."""
    if len(low) <= _DENSE:
        return low.astype(np.uint16)
    bits = np.zeros(_BYTES * 8, np.uint8)
    bits[low] = 1
    return np.packbits(bits)


def _is_bits(c: np.ndarray) -> bool:
    return c.dtype == np.uint8


def _numbers(c: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(c)) if _is_bits(c) else c.astype(np.int64)


def _has(c: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which of the numbers ``low`` the container holds."""
    low = low.astype(np.int64)
    if _is_bits(c):
        return (c[low >> 3] >> (7 - (low & 7)) & 1).astype(bool)
    if not len(c):
        return np.zeros(len(low), bool)
    at = np.minimum(np.searchsorted(c, low), len(c) - 1)
    return c[at] == low


class Bitmap:
    """A set of non-negative integers."""

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self.containers = containers or {}

    @classmethod
    def of(cls, numbers: np.ndarray) -> Bitmap:
        numbers = np.unique(np.asarray(numbers, np.int64))
        high, at = np.unique(numbers >> 16, return_index=True)
        return cls({int(h): _pack(part & 0xFFFF) for h, part in zip(high, np.split(numbers, at[1:]), strict=True)} if len(numbers) else {})

    def and_not(self, other: Bitmap) -> Bitmap:
        out = {}
        for h, c in self.containers.items():
            o = other.containers.get(h)
            if o is None:
                out[h] = c
            elif _is_bits(c) and _is_bits(o):
                out[h] = _pack(_numbers(c & ~o))
            else:
                low = _numbers(c)
                out[h] = _pack(low[~_has(o, low)])
        return Bitmap({h: c for h, c in out.items() if len(c)})

    def and_(self, other: Bitmap) -> Bitmap:
        out = {}
        for h, c in self.containers.items():
            o = other.containers.get(h)
            if o is not None:
                if _is_bits(c) and _is_bits(o):
                    out[h] = _pack(_numbers(c & o))
                else:
                    a, b = (o, c) if _is_bits(c) else (c, o)
                    low = _numbers(a)
                    out[h] = _pack(low[_has(b, low)])
        return Bitmap({h: c for h, c in out.items() if len(c)})

    def or_(self, other: Bitmap) -> Bitmap:
        out = dict(self.containers)
        for h, c in other.containers.items():
            o = out.get(h)
            out[h] = c if o is None else _pack(np.union1d(_numbers(c), _numbers(o)))
        return Bitmap(out)

    def numbers(self) -> np.ndarray:
        """The members in ascending order."""
        parts = [(h << 16) + _numbers(c) for h, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.containers.values())
