"""Vectorised text helpers shared by the corpus operators.

Everything here works on one Arrow batch inside a task: the UTF-8 bytes of a text column are
viewed in place as numpy arrays, cut into pieces of bounded size, and words are found and
hashed without making a Python object for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is still handled whole.
PIECE_BYTES = 2 << 20

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


#: A random 64-bit value for each byte, and the same with A-Z read as a-z.
BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _GOLD)
_lowered = np.arange(256)
_lowered[65:91] += 32
LOWER_VALUES = BYTE_VALUES[_lowered]
LOWER_BYTES = _lowered.astype(np.uint8)

#: The white space that parts words: blank, and tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), PIECE_BYTES + 1)
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each byte span data[start:end]."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)


@dataclass
class Piece:
    """Some whole rows of a batch: rows lo to hi, their bytes, and each row's bounds in them."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def pieces(text: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The bytes of a string column, some rows at a time; null reads as an empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    if not len(text):
        return
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield Piece(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    """The words of a piece: their byte spans, and for each row the range of its words."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(piece: Piece, parting: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs without parting bytes (white space); none crosses from one row into the next."""
    n = len(piece.data)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(parting[piece.data], out=inside[1:-1])
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cut = piece.bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[inside[cut] & inside[cut + 1]]
    starts[both] = True
    ends[both] = True
    first = np.flatnonzero(starts[:n])
    last = np.flatnonzero(ends)
    return Words(first, last, np.searchsorted(first, piece.bounds))


def grouped_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values[bounds[i]:bounds[i + 1]] for each i; 0 for an empty range."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def code_points(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The piece's code points, and the byte offset of each with the end's offset last."""
    cp = np.frombuffer(bytes(piece.data).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.zeros(len(cp) + 1, dtype=np.int64)
    if len(cp) == len(piece.data):
        at[1:] = np.arange(1, len(cp) + 1)
    else:
        np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000), out=at[1:])
    return cp, at


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The spans as byte strings."""
    raw = bytes(data)
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
