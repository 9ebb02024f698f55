"""Words as runs of letters, lower-cased, and the hashes of their characters.

Like textvec this works on whole pieces of text with numpy; here the units are code points.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

from . import textvec as tv
from .bpe import _LETTER, _classes

_U = np.uint64


@functools.lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@functools.lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """A random 32-bit value of each code point."""
    return (tv.mix(np.arange(0x110000, dtype=np.uint64) + _U(7)) >> _U(32)).astype(np.uint32)


@dataclass
class LetterWords:
    """The letters of a piece end to end; words as ranges of letters; rows as ranges of words."""

    letters: np.ndarray
    words: np.ndarray
    rows: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.words)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        values = tv.mix(self.letters.astype(np.uint64) + _U(3))
        up, down = tv._POWERS.upto(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        a, b = self.words[:-1], self.words[1:]
        return tv.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

    def trigrams(self, bits: int) -> np.ndarray:
        """For each letter a bucket of it with its neighbours in the word, in 2**bits buckets."""
        code = _codes()[self.letters]
        before, after = np.zeros_like(code), np.zeros_like(code)
        before[1:] = code[:-1]
        after[:-1] = code[1:]
        before[self.words[:-1]] = 0
        after[self.words[1:] - 1] = 0
        mixed = (before * np.uint32(0x85EBCA6B) ^ code) * np.uint32(0xC2B2AE35) + after * np.uint32(0x27D4EB2F)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x9E3779B1)
        return (mixed >> np.uint32(32 - bits)).astype(np.int32)


def letter_words(piece: tv.Piece) -> LetterWords:
    cp, at = tv.code_points(piece)
    n = len(cp)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = _classes()[cp] == _LETTER
    edge = piece.bounds if n == len(piece.data) else np.searchsorted(at, piece.bounds)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[: n - 1]
    before[edge[edge < n]] = False
    start = np.flatnonzero(inside[:n] & ~before)
    where = np.flatnonzero(inside[:n])
    letters = _lower()[cp[where]]
    bounds = np.append(np.searchsorted(where, start), len(where))
    return LetterWords(letters, bounds, np.searchsorted(start, edge))
