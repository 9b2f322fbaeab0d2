"""An n-gram trie in Elias-Fano coded levels: monotone pointers, and successors found by a search
that stays within their context. One mapped buffer holds all levels: anonymous memory of the task that built
it, or a file."""

from __future__ import annotations

import mmap

import numpy as np

_POP8 = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th zero of a byte.
_ZERO8 = np.zeros((256, 8), np.uint8)
#: Place of the k-th one of a byte.
_ONE8 = _ZERO8[::-1]
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if not _b >> i & 1):
        _ZERO8[_b, _k] = _i


class EliasFano:
    """A monotone sequence of n integers below `top`: low bits packed, high bits as unary gaps."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        zeros = 64 - _POP8[high].reshape(-1, 8).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(zeros)])  # zeros before each 64-bit word
        self.ones = np.arange(len(self.before)) * 64 - self.before

    @staticmethod
    def coded(values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.int64)
        length = n + (int(top) >> bits) + 2
        marks = np.zeros(-(-length // 64) * 64, np.uint8)
        marks[(v >> bits) + np.arange(n)] = 1
        low = np.zeros((n * bits >> 6) + 2, np.uint64)
        if bits:
            bit, x = np.arange(n, dtype=np.uint64) * np.uint64(bits), (v & ((1 << bits) - 1)).astype(np.uint64)
            word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, x << off)
            over = off + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (np.uint64(64) - off[over]))
        return EliasFano(n, bits, low, np.packbits(marks, bitorder="little"))

    def zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[word]
        at = word * 8
        for _ in range(7):  # at most 8 bytes to pass
            here = 8 - _POP8[self.high[at]].astype(np.int64)
            go = left >= here
            if not go.any():
                break
            left = left - here * go
            at = at + go
        return at * 8 + _ZERO8[self.high[at], left]

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i: the high bits are the zeros before the i-th one."""
        word = np.searchsorted(self.ones, i, "right") - 1
        left = i - self.ones[word]
        at = word * 8
        for _ in range(7):  # at most 8 bytes to pass
            here = _POP8[self.high[at]].astype(np.int64)
            go = left >= here
            if not go.any():
                break
            left = left - here * go
            at = at + go
        place = at * 8 + _ONE8[self.high[at], left]
        return (place - i) << self.low_bits | self.low_at(i)

    def low_at(self, i: np.ndarray) -> np.ndarray:
        """The low bits at places i, from two neighbouring words of the packed ones."""
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        x = self.low[word] >> off
        over = off + np.uint64(self.low_bits) > 64
        x[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return (x & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def search(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x, its place among the values at lo to hi (excluded), and whether it is there: the bucket of
        its high bits, cut to that range, is halved by low bits."""
        h, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        first = np.where(h > 0, self.zero(np.maximum(h - 1, 0)) - np.maximum(h - 1, 0), 0)
        last = self.zero(h) - h
        lo, hi = np.maximum(lo, first), np.minimum(hi, last)
        end = hi.copy()
        while len(todo := np.flatnonzero(lo < hi)):
            mid = (lo[todo] + hi[todo]) >> 1
            below = self.low_at(mid) < low[todo]
            lo[todo[below]], hi[todo[~below]] = mid[below] + 1, mid[~below]
        hit = lo < end
        k = np.flatnonzero(hit)
        hit[k] = self.low_at(lo[k]) == low[k]
        return lo, hit

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high]


def quantised(values: np.ndarray, codes: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint8, below `codes`) and the book of their values (float32): the values themselves where
    they are few, else the means of ranges with equally many."""
    found, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
    if len(found) <= codes:
        return inverse.astype(np.uint8), found.astype(np.float32)
    bin_of = np.minimum((np.cumsum(n) - n) * codes // n.sum(), codes - 1)
    _, bin_of = np.unique(bin_of, return_inverse=True)
    book = np.bincount(bin_of, found * n) / np.bincount(bin_of, n)
    return bin_of[inverse].astype(np.uint8), book.astype(np.float32)


class NgramTrie:
    """Level 1: contexts, with the pointer to their first successor and a coded backoff. Level 2: their
    successors, sorted, and a coded probability each. A context's successors are made to follow the
    last one's by adding context * width, so one monotone sequence holds all; a pair is sought between its
    context's two pointers."""

    def __init__(self, width: int, pointers: EliasFano, successors: EliasFano, p: np.ndarray, p_book: np.ndarray, b: np.ndarray, b_book: np.ndarray):
        self.width, self.pointers, self.successors = width, pointers, successors
        self.p, self.p_book, self.b, self.b_book = p, p_book, b, b_book

    @staticmethod
    def built(n_contexts: int, width: int, context: np.ndarray, word: np.ndarray, log_p: np.ndarray, log_b: np.ndarray) -> NgramTrie:
        """context and word: pairs sorted by both; width: more than the largest word; log_b: per context."""
        first = np.searchsorted(context, np.arange(n_contexts + 1))
        p, p_book = quantised(log_p)
        b, b_book = quantised(log_b)
        succ = EliasFano.coded(context.astype(np.int64) * width + word, max(1, n_contexts * width))
        return NgramTrie(width, EliasFano.coded(first, len(word) + 1), succ, p, p_book, b, b_book)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the pairs' probabilities, 255 where a pair isn't there."""
        if not self.successors.n or not len(word):
            return np.full(len(word), 255, np.uint8)
        of, at = np.unique(np.concatenate([context, context + 1]), return_inverse=True)
        edge = self.pointers.get(of)[at]
        at, hit = self.successors.search(context.astype(np.int64) * self.width + word, edge[: len(word)], edge[len(word) :])
        return np.where(hit, self.p[np.minimum(at, self.successors.n - 1)], 255).astype(np.uint8)

    def to_bytes(self) -> bytes:
        parts = [*self.pointers.arrays(), *self.successors.arrays(), self.p, self.p_book, self.b, self.b_book]
        head = np.array([self.width, len(parts), *(x.nbytes for x in parts)], np.int64)
        return head.tobytes() + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in parts)

    def in_mapped_memory(self) -> NgramTrie:
        """The same trie in one anonymous mapping, which goes as a whole when the trie does."""
        raw = self.to_bytes()
        room = mmap.mmap(-1, len(raw))
        room[:] = raw
        return NgramTrie.of_buffer(room)

    @staticmethod
    def of_buffer(buffer) -> NgramTrie:
        width, k = np.frombuffer(buffer, np.int64, 2)
        sizes = np.frombuffer(buffer, np.int64, k, 16)
        at, raw = 16 + 8 * int(k), []
        for size in map(int, sizes):
            raw.append(np.frombuffer(buffer, np.uint8, size, at))
            at += size + -size % 8

        def coded(meta, low, high):
            n, bits = map(int, meta.view(np.int64))
            return EliasFano(n, bits, low.view(np.uint64), high)

        return NgramTrie(int(width), coded(*raw[:3]), coded(*raw[3:6]), raw[6], raw[7].view(np.float32), raw[8], raw[9].view(np.float32))

    @staticmethod
    def mapped(path: str) -> NgramTrie:
        """The trie in a file, mapped: pages are read as searches touch them."""
        with open(path, "rb") as f:
            return NgramTrie.of_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
