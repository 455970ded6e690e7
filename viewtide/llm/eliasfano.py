"""Elias-Fano sequences and an n-gram trie on them, in flat buffers that can be memory-mapped.

A monotone sequence keeps each value's low bits packed and its high bits in unary; a directory of
counts for every 64 bits leads to any one or zero. All operations take whole arrays of queries.
"""

from __future__ import annotations

import struct

import numpy as np

_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Place of the k-th one in a byte, by byte and k.
_PLACE = np.argsort(1 - _BYTE, axis=1, kind="stable").astype(np.uint8)
_COUNT = _BYTE.sum(axis=1).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of width bits, end to end."""
    if not width:
        return np.zeros(8, np.uint8)
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)])


def _unpack(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values at some places; widths up to 56 bits lie in eight bytes from the first one's byte on."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    byte = bit >> 3
    word = np.zeros(len(at), np.uint64)
    for i in range((width + 14) // 8):
        word |= data[byte + i].astype(np.uint64) << np.uint64(8 * i)
    return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


class EliasFano:
    """A non-decreasing sequence of unsigned numbers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        words = np.bitwise_count(high.view(np.uint64)).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(words)))
        self.zeros = np.arange(len(words) + 1) * 64 - self.ones

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        # packed in pieces, as bits are spread to bytes on the way
        low = [_pack(values[i : i + 65536] & np.uint64((1 << width) - 1), width)[: -8 if width else None] for i in range(0, n, 65536)]
        low = np.concatenate([*low, np.zeros(8, np.uint8)]) if n else np.zeros(8, np.uint8)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[places] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones (or zeros), from 0."""
        sums = self.ones if one else self.zeros
        word = np.searchsorted(sums, k, side="right") - 1
        rest = k - sums[word]
        out = word * 64
        data = self.high
        live = np.ones(len(k), bool)
        for i in range(8):
            byte = data[word * 8 + i]
            byte = byte if one else ~byte
            count = _COUNT[byte].astype(np.int64)
            here = live & (rest < count)
            out[here] += i * 8 + _PLACE[byte[here], rest[here]]
            live &= ~here
            rest -= np.where(live, count, 0)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.width)) | _unpack(self.low, self.width, i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is at least x; n where there is none."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        high = (x >> np.uint64(self.width)).astype(np.int64)
        buckets = int(self.zeros[-1])
        inside = high < buckets
        h = np.where(inside, high, 0)
        end = np.where(inside, self._select(h, False) - h, self.n)
        start = np.where(inside & (h > 0), self._select(np.maximum(h - 1, 0), False) - np.maximum(h - 1, 0), np.where(inside, 0, self.n))
        end = np.minimum(end, self.n)
        low = x & np.uint64((1 << self.width) - 1)
        at = np.minimum(start, end)
        last = end.copy()
        live = np.flatnonzero(at < last)
        while len(live):  # halves what is left of the bucket
            mid = (at[live] + last[live]) // 2
            less = _unpack(self.low, self.width, mid) < low[live]
            at[live] = np.where(less, mid + 1, at[live])
            last[live] = np.where(less, last[live], mid)
            live = live[at[live] < last[live]]
        return at

    def dump(self) -> list[bytes]:
        return [struct.pack("<QQQQ", self.n, self.width, len(self.low), len(self.high)), self.low.tobytes(), bytes(-len(self.low) % 8), self.high.tobytes()]

    @classmethod
    def load(cls, data: np.ndarray, at: int) -> tuple["EliasFano", int]:
        """A sequence in a buffer of bytes, as a view, and where it ends."""
        n, width, low, high = struct.unpack("<QQQQ", data[at : at + 32].tobytes())
        a, b = at + 32, at + 32 + low + -low % 8
        return cls(n, width, data[a : a + low], data[b : b + high]), b + high


class NgramTrie:
    """Contexts in order, each with its successors: pointers and successors are Elias-Fano, probabilities 16-bit codes.

    Successors of a context are stored relative to it: to each is added the last value of the context
    before, which makes the level one monotone sequence. A lookup adds the same base and takes the sequence's successor.
    """

    STEPS = 4096
    NONE = 65535

    def __init__(self, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.pointers, self.successors, self.codes = pointers, successors, codes

    @classmethod
    def build(cls, contexts: int, context: np.ndarray, word: np.ndarray, log10: np.ndarray) -> "NgramTrie":
        """From distinct (context, word) in order, both small numbers, and their log10 probabilities."""
        starts = np.searchsorted(context, np.arange(contexts + 1))
        ends = starts[1:] - 1
        last = np.where(starts[1:] > starts[:-1], np.take(word, np.maximum(ends, 0), mode="clip") + 1 if len(word) else 0, 0)
        base = np.concatenate(([0], np.cumsum(last)))[:-1]
        values = word + base[context] if len(word) else word
        codes = np.minimum(np.round(-log10 * cls.STEPS), cls.NONE - 1).astype(np.uint16)
        return cls(EliasFano.encode(starts), EliasFano.encode(values), codes)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of (context, word) pairs; NONE where there is none."""
        if not len(context) or not self.successors.n:
            return np.full(len(context), self.NONE, np.uint16)
        some, number = np.unique(context, return_inverse=True)
        lo, hi = (self.pointers.get(some + i).astype(np.int64) for i in (0, 1))
        before = np.where(lo > 0, self.successors.get(np.maximum(lo - 1, 0)) + np.uint64(1), np.uint64(0))
        x = before[number] + word.astype(np.uint64)
        at = self.successors.successor(x)
        inside = at < hi[number]
        found = np.zeros(len(x), bool)
        found[inside] = self.successors.get(at[inside]) == x[inside]
        out = np.full(len(x), self.NONE, np.uint16)
        out[found] = self.codes[at[found]]
        return out

    def dump(self) -> bytes:
        return b"".join([*self.pointers.dump(), *self.successors.dump(), struct.pack("<Q", len(self.codes)), self.codes.tobytes()])

    @classmethod
    def load(cls, data: np.ndarray) -> "NgramTrie":
        """A trie over a buffer of bytes, which may be a mapped file."""
        pointers, at = EliasFano.load(data, 0)
        successors, at = EliasFano.load(data, at)
        (n,) = struct.unpack("<Q", data[at : at + 8].tobytes())
        return cls(pointers, successors, data[at + 8 : at + 8 + 2 * n].view(np.uint16))
