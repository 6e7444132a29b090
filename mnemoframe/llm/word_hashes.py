"""64-bit hashes of all words of many texts at once, in numpy.

The bytes of a word, each replaced by a random number, are the digits of a polynomial in an odd base, modulo 2^64. Sums
over all words come from one running sum over the bytes, so no word is ever cut out. Two different words have one hash
about once in 2^60 pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Bytes whose running sum is held at once; a longer word makes its own piece.
_PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """What separates words: ``separators`` are byte values; A-Z count as a-z."""

    def __init__(self, separators: bytes):
        fold = np.arange(256)
        fold[65:91] += 32
        self.digit = mix((fold + 1).astype(np.uint64) * np.uint64(_BASE))
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.digit[~self.inside] = 0
        assert not self.inside[10], "a line feed separates texts"

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all ``texts`` one behind the other, and where each text's begin (one more at the end).

        Null texts have no words.
        """
        none = np.zeros(len(texts) + 1, np.int64)
        if not len(texts):
            return np.empty(0, np.uint64), none
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), b"\n")[0].as_buffer()
        data = np.frombuffer(joined, np.uint8)
        none[1:] = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
        inside = self.inside[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _PIECE, "right")))
            a, b = int(starts[lo]), int(ends[hi - 1])
            up, down = _powers(b - a + 1)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.digit[data[a:b]] * up[: b - a], out=total[1:])
            at, to = starts[lo:hi] - a, ends[lo:hi] - a
            out[lo:hi] = mix((total[to] - total[at]) * down[at] + (to - at).astype(np.uint64))
            lo = hi
        return out, np.searchsorted(starts, none)


_HELD: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if n > len(_HELD[0]):
        held = max(n, _PIECE + 1)
        made = []
        for base in (_BASE, _BACK):
            p = np.full(held, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if held > _PIECE + 1:
            return made
        _HELD[:] = made
    return _HELD
