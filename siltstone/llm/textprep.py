"""Array-level text kernels shared by the operators of this subpackage.

Texts of one Arrow batch are laid end to end in one code-point array, so every step
(window hashes, masks, minima) is a handful of numpy passes over the whole batch and
never a Python loop over characters.
"""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the rolling hash and of the final mixing (splitmix64).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as uint32 code points, and the length of each."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), lengths


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values: neighbours end up unrelated."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of points[i:i+k] for every i; shorter than points by k - 1.

    A window of length a+b is joined from windows of lengths a and b, so k costs about
    2·log2(k) passes.
    """
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width = mix64(points.astype(np.uint64) + np.uint64(1)), 1
        base = _BASE
        done, done_width = None, 0
        rest = k
        while True:
            if rest & 1:
                if done is None:
                    done, done_width = power, width
                else:
                    m = len(done) - width
                    done = done[:m] * base + power[done_width : done_width + m]
                    done_width += width
            rest >>= 1
            if not rest:
                break
            m = len(power) - width
            power = power[:m] * base + power[width : width + m]
            width, base = width * 2, base * base
        return mix64(done[:n])


def windows_of(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions (in the joined array) of windows lying inside one text, and their text's number."""
    starts = np.cumsum(lengths) - lengths
    count = np.maximum(lengths - k + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), count)
    first = np.cumsum(count) - count
    return np.arange(count.sum()) - np.repeat(first - starts, count), owner


def slices(texts: list[str], most_texts: int, most_chars: int = 4_000_000) -> list[tuple[int, int]]:
    """Stretches of a batch small enough to be laid end to end: bounded in texts and, but for one longer text, in characters."""
    out, start, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= most_texts or size + len(text) > most_chars):
            out.append((start, i))
            start, size = i, 0
        size += len(text)
    return [*out, (start, len(texts))] if len(texts) else []
