"""Elias-Fano sequences and an n-gram trie of them, in one flat buffer.

The buffer can be a bytes object or a memory-mapped file; all parts are read in
place. Lookups select ones and zeros in the packed bit vector with a small
directory (a count for every 512 bits); nothing is unpacked as a whole.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import read_file, write_file

#: 64-bit words in a block of the directory.
BLOCK = 8
#: _SELECT[b, k]: place of the k-th one in the byte b.
_SELECT = np.zeros((256, 8), np.int64)
for _b in range(256):
    _ones = [k for k in range(8) if _b >> k & 1]
    _SELECT[_b, : len(_ones)] = _ones


def _pick(counts: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row of counts: the column in which the k-th thing lies, and its number there."""
    sums = np.cumsum(counts, axis=1)
    at = (sums <= k[:, None]).sum(1)
    before = np.where(at > 0, np.take_along_axis(sums, np.maximum(at - 1, 0)[:, None], 1)[:, 0], 0)
    return at, k - before


class EliasFano:
    """A non-decreasing sequence of n integers: l low bits each, packed, and the high
    parts in unary in a bit vector of at most 3 n bits (value i sets bit high + i)."""

    def __init__(self, n: int, l: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.l, self.low, self.high, self.ones = n, l, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        l = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        words = np.zeros(n * l // 64 + 2, np.uint64)
        if l:
            parts = v & np.uint64((1 << l) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            first = parts << shift
            over = np.where(shift > 0, parts >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[start]] |= np.bitwise_or.reduceat(first, start)
            spill = (shift + np.uint64(l) > 64).nonzero()[0]
            words[word[spill] + 1] |= over[spill]  # one value at most crosses into a word
        size = (int(v[-1]) >> l) + n + 1 if n else 1
        bits = np.zeros(-(-size // (64 * BLOCK)) * 64 * BLOCK, np.uint8)
        bits[(v >> np.uint64(l)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        per_block = np.bitwise_count(high).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        return cls(n, l, words, high, np.r_[0, np.cumsum(per_block)])

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Places of the k-th ones or zeros of the bit vector (each must exist)."""
        ahead = np.arange(len(self.ones)) * (64 * BLOCK) - self.ones if zero else self.ones
        block = np.searchsorted(ahead, k, "right") - 1
        words = self.high.reshape(-1, BLOCK)[block]
        if zero:
            words = ~words
        at, k = _pick(np.bitwise_count(words).astype(np.int64), k - ahead[block])
        octets = np.ascontiguousarray(words[np.arange(len(k)), at]).view(np.uint8).reshape(-1, 8)
        octet, k = _pick(np.bitwise_count(octets).astype(np.int64), k)
        return ((block * BLOCK + at) * 8 + octet) * 8 + _SELECT[octets[np.arange(len(k)), octet], k]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        x |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return x & np.uint64((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        top = self._select(i, False) - i
        return (top.astype(np.uint64) << np.uint64(self.l)) | self.lows(i)

    def _runs(self, start: np.ndarray, zeros_before: np.ndarray) -> np.ndarray:
        """Number of ones from each place of the bit vector up to the next zero."""
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        more = self.high[np.minimum(word + 1, len(self.high) - 1)]
        window = (self.high[word] >> shift) | np.where(shift > 0, more << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        zeros = ~window
        out = np.bitwise_count((zeros & (~zeros + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        long = np.flatnonzero(zeros == 0)
        out[long] = self._select(zeros_before[long], True) - start[long]
        return out

    def _bucket(self, x: np.ndarray):
        """For each x with a top in reach: its place in x, first and end index of the
        values with its top, and its low part; the first value >= it by bisection."""
        zeros = len(self.high) * 64 - self.n  # the padding ends with zeros
        top = (x >> np.uint64(self.l)).astype(np.int64)
        at = np.flatnonzero(top < zeros) if self.n else np.zeros(0, np.int64)
        top = top[at]
        start = np.zeros(len(at), np.int64)
        later = np.flatnonzero(top > 0)
        start[later] = self._select(top[later] - 1, True) + 1
        low = start - top
        end = low + self._runs(start, top)
        part = x[at] & np.uint64((1 << self.l) - 1) if self.l else np.zeros(len(at), np.uint64)
        high = end.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            less = self.lows(mid) < part[live]
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
            live = live[low[live] < high[live]]
        return at, low, end, part

    def next_geq(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x (n if none), for each x."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), self.n, np.int64)
        at, low, _, _ = self._bucket(x)
        out[at] = low
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value equal to x (-1 if none), for each x."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        at, low, end, part = self._bucket(x)
        some = np.flatnonzero(low < end)
        some = some[self.lows(low[some]) == part[some]]
        out[at[some]] = low[some]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<4q", self.n, self.l, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.ones.astype(np.int64).tobytes()

    @classmethod
    def from_buffer(cls, raw, at: int) -> tuple["EliasFano", int]:
        n, l, a, b = struct.unpack_from("<4q", raw, at)
        at += 32
        low = np.frombuffer(raw, np.uint64, a, at)
        high = np.frombuffer(raw, np.uint64, b, at + 8 * a)
        at += 8 * (a + b)
        ones = np.frombuffer(raw, np.int64, b // BLOCK + 1, at)
        return cls(n, l, low, high, ones), at + 8 * len(ones)


#: Quantised log10 probabilities in a byte: code 0 is "not there", code k is -(k - 1) * STEP.
LOWEST, CODES = 10.0, 255
STEP = LOWEST / (CODES - 1)


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down, so that parts of a whole stay within it; those
    under 10 ** -LOWEST, 0 among them, get the last code."""
    log10p = np.log10(np.maximum(p, 10.0**-LOWEST))
    return (1 + np.clip(np.ceil(-log10p / STEP - 1e-9), 0, CODES - 1)).astype(np.uint8)


def dequantised(codes: np.ndarray) -> np.ndarray:
    """Probabilities; 0 where there is none."""
    return np.where(codes > 0, 10.0 ** (-(codes.astype(np.float64) - 1) * STEP), 0.0)


class NgramTrie:
    """N-grams of order 3 in levels of Elias-Fano sequences.

    Level 1 holds the words x that begin an n-gram, level 2 the pairs (x, y), level 3
    the triples (x, y, z). Within a level the last word stands relative to its
    context, as rank of the context * universe + word, which is monotone; monotone
    pointers give where the successors of a context begin in the next level. Level 2
    has for each pair the quantised probability of y after x and the quantised mass
    that the pair, as a context, leaves to lower orders; level 3 has the quantised
    probability of z after (x, y).
    """

    def __init__(self, universe: int, words: EliasFano, pointers: list[EliasFano], successors: list[EliasFano], codes: list[np.ndarray]):
        self.universe, self.words, self.pointers, self.successors, self.codes = universe, words, pointers, successors, codes

    @classmethod
    def build(cls, x: np.ndarray, y: np.ndarray, p2: np.ndarray, left: np.ndarray, of_pair: np.ndarray, z: np.ndarray, p3: np.ndarray) -> "NgramTrie":
        """From distinct pairs (x, y) sorted, and triples as (place of the pair, z), sorted."""
        start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(x)]))
        universe = 1 + max(int(y.max(initial=0)), int(z.max(initial=0)))
        if universe * (len(x) + 1) >= 1 << 63:
            raise OverflowError("too many n-grams for one trie")
        relative = lambda r, w: EliasFano.build(r.astype(np.uint64) * np.uint64(universe) + w.astype(np.uint64))
        bounds = np.searchsorted(of_pair, np.arange(len(x) + 1))
        return cls(universe, EliasFano.build(x[start]), [EliasFano.build(np.r_[start, len(x)]), EliasFano.build(bounds)], [relative(rank, y), relative(of_pair, z)], [quantised(p2), quantised(left), quantised(p3)])

    def _below(self, level: int, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places in the next level of the successors word of the contexts rank; -1 if
        the context (rank -1) or the successor is not there."""
        out = np.full(len(rank), -1, np.int64)
        word = np.asarray(word)
        at = np.flatnonzero((rank >= 0) & (word < self.universe))
        out[at] = self.successors[level].find(rank[at].astype(np.uint64) * np.uint64(self.universe) + word[at].astype(np.uint64))
        return out

    def pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of pairs in level 2, -1 for those that the trie lacks."""
        x = np.asarray(x, np.uint64)
        new = np.r_[True, x[1:] != x[:-1]][: len(x)]  # equal neighbours are looked up once
        return self._below(0, self.words.find(x[new])[np.cumsum(new) - 1], y)

    def triple(self, at: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Places in level 3 of the successors z of pairs at."""
        return self._below(1, at, z)

    def codes_at(self, which: int, at: np.ndarray) -> np.ndarray:
        """Codes of p2 (0), the mass left (1) or p3 (2) at places; 0 where the place is -1."""
        out = np.zeros(len(at), np.uint8)
        has = at >= 0
        out[has] = self.codes[which][at[has]]
        return out

    def successors_of(self, level: int, rank: int) -> np.ndarray:
        """Words that follow a context (its rank in level 1 or 2), ascending."""
        s, e = (int(v) for v in self.pointers[level].get(np.array([rank, rank + 1])))
        return (self.successors[level].get(np.arange(s, e)) - np.uint64(rank * self.universe)).astype(np.int64)

    def to_bytes(self) -> bytes:
        parts = [x.to_bytes() for x in (self.words, *self.pointers, *self.successors)]
        parts += [c.tobytes() + b"\0" * (-c.nbytes % 8) for c in self.codes]
        return struct.pack("<3q", self.universe, len(self.codes[0]), len(self.codes[2])) + b"".join(parts)

    @classmethod
    def from_buffer(cls, raw) -> "NgramTrie":
        universe, pairs, triples = struct.unpack_from("<3q", raw, 0)
        at, parts, codes = 24, [], []
        for _ in range(5):
            x, at = EliasFano.from_buffer(raw, at)
            parts.append(x)
        for n in (pairs, pairs, triples):
            codes.append(np.frombuffer(raw, np.uint8, n, at))
            at += n + -n % 8
        return cls(universe, parts[0], parts[1:3], parts[3:], codes)

    def save(self, url: str) -> None:
        write_file(url, self.to_bytes())

    @classmethod
    def open(cls, url: str) -> "NgramTrie":
        """A trie in a file, memory-mapped where the file system can do it."""
        return cls.from_buffer(read_file(url))
