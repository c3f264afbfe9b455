"""Poisson draws of many units at once, from the md5 of (seed, block of replicates, unit).

The digests are those of ``hashlib``, worked out for thousands of short messages side by side: one array per word.
"""

from __future__ import annotations

import hashlib
import math
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa

# Four hex digits from which on a unit counts once, twice, ... more (Poisson of mean 1).
STEPS = ("5e2d", "bc5a", "eb71", "fb23", "ff10", "ffd9", "fffa", "ffff")
PER_HASH = 8  # replicates that share one md5 of 32 hex digits

# how often a unit counts, by the number that its four hex digits spell, and by that number with its bytes swapped
_TIMES = np.searchsorted([int(t, 16) for t in STEPS], np.arange(1 << 16), side="right").astype(np.uint8)
_TIMES_SWAPPED = np.ascontiguousarray(_TIMES[np.arange(1 << 16, dtype="<u2").view(">u2")])

# Fixed values of md5 (RFC 1321): rotations, sines, the word that each round adds, and the start.
_TURNS = [t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ONE_BLOCK = 55  # bytes of a message that md5 takes in one round
_AT_ONCE = 8192  # messages side by side: their words stay in a processor's cache


def _md5_words(words: Sequence[np.ndarray | None], n: int) -> list[np.ndarray]:
    """The four words of the digests of n messages of one block; a word that is 0 in all messages is None."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(_SINES[i])
        if words[_WORDS[i]] is not None:
            f += words[_WORDS[i]]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t)
        f <<= np.uint32(_TURNS[i])
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [x + np.uint32(v) for x, v in zip((a, b, c, d), _START)]


class Draws:
    """How often units count in the replicates of a block, for one block after another."""

    def __init__(self, units: pa.Array, seed: int) -> None:
        raw = units.cast(pa.large_binary())
        at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
        self.n, self.seed, self.units = len(raw), seed, raw
        self.sizes = np.diff(at)
        self.parts = []
        for lo in range(0, self.n, _AT_ONCE):
            size = self.sizes[lo:lo + _AT_ONCE]
            kept = np.minimum(size, _ONE_BLOCK)
            row = np.repeat(np.arange(len(size)), kept)
            col = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
            text = np.zeros((len(size), kept.max() + 1), np.uint8)
            text[row, col] = data[np.repeat(at[lo:lo + len(size)], kept) + col]
            text[np.arange(len(size)), kept] = 0x80
            self.parts.append(text)
        self.head, self.words = -1, []

    def _moved(self, head: int) -> None:
        """The messages' words, the units' texts behind ``head`` bytes that are still 0."""
        self.head, self.words = head, []
        for i, text in enumerate(self.parts):
            m = np.zeros((len(text), 64), np.uint8)
            width = min(text.shape[1], 64 - head)
            m[:, head:head + width] = text[:, :width]
            w = m.view("<u4").T.astype(np.uint32, order="C")
            w[14] = 8 * (head + self.sizes[i * _AT_ONCE:i * _AT_ONCE + len(text)])
            w[15] = 0
            self.words.append([v if v.any() else None for v in w])

    def _digests(self, head: bytes) -> Iterator[tuple[slice, list[np.ndarray]]]:
        """Places of units and the four words of the md5 of ``head`` and their texts; wrong for texts beyond one block."""
        if len(head) > 24:
            raise ValueError("a seed of at most ten digits is expected")
        if len(head) != self.head:
            self._moved(len(head))
        first = np.frombuffer(head.ljust(24, b"\x00"), "<u4")
        for i, words in enumerate(self.words):
            n = len(self.parts[i])
            own = list(words)
            for j in range(-(-len(head) // 4)):
                own[j] = np.full(n, first[j], np.uint32) if own[j] is None else own[j] | np.uint32(first[j])
            yield slice(i * _AT_ONCE, i * _AT_ONCE + n), _md5_words(own, n)

    def _long(self, head: bytes) -> Iterator[tuple[int, bytes]]:
        """Places and digests of the texts beyond one block."""
        for i in np.flatnonzero(self.sizes + len(head) > _ONE_BLOCK):
            yield i, hashlib.md5(head + self.units[int(i)].as_py()).digest()

    def block(self, k: int) -> np.ndarray:
        """Weights in the PER_HASH replicates of block ``k``, one row a replicate."""
        head = f"{self.seed}|{k}|".encode()
        out = np.empty((PER_HASH, self.n), np.uint8)
        for at, words in self._digests(head):
            for j, v in enumerate(words):
                out[2 * j:2 * j + 2, at] = _TIMES_SWAPPED[v.view(np.uint16)].reshape(-1, 2).T
        for i, digest in self._long(head):
            out[:, i] = _TIMES[np.frombuffer(digest, ">u2")]
        return out

    def first_bits(self, k: int) -> np.ndarray:
        """First 32 bits of the md5 of (seed|k) and the units' texts, which bring their own bar."""
        head = f"{self.seed}|{k}".encode()
        out = np.empty(self.n, np.uint32)
        for at, words in self._digests(head):
            out[at] = words[0].byteswap()
        for i, digest in self._long(head):
            out[i] = int.from_bytes(digest[:4], "big")
        return out
