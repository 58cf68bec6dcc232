"""Elias-Fano coding of increasing integers in memory-mapped arrays.

The low bits of every value are kept as whole bytes, the high parts in unary in
a bit vector: value i sets bit (high + i).  Zeros end the buckets of equal high
parts, so a successor search selects two zeros and bisects between them.
"""

from __future__ import annotations

import numpy as np

BLOCK = 8  # 64-bit words between two samples of the zero count


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays for values (sorted uint64, below universe)."""
    n = len(values)
    bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    planes = -(-bits // 8)
    low = np.empty((planes, n), np.uint8)
    for k in range(planes):
        low[k] = (values >> np.uint64(8 * k)).astype(np.uint8)
    high = values >> np.uint64(8 * planes) if planes < 8 else np.zeros(n, np.uint64)
    buckets = (max(0, universe - 1) >> (8 * planes)) + 1
    at = high.astype(np.int64) + np.arange(n)
    words = -(-(n + buckets + 1) // 64)
    words += -words % BLOCK
    ones = np.zeros(words * 64, np.uint8)
    ones[at] = 1
    packed = np.packbits(ones, bitorder="little").view(np.uint64)
    zeros = 64 - np.bitwise_count(packed).astype(np.int64)
    by_block = np.cumsum(zeros.reshape(-1, BLOCK), axis=1)
    sample = np.r_[0, np.cumsum(by_block[:, -1])[:-1]].astype(np.int64)
    return {"low": low, "high": packed, "sample": sample, "inner": by_block.astype(np.uint16), "meta": np.array([n, planes, buckets], np.int64)}


_U = np.uint64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the k-th set bit of a byte.
_PLACE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [i for i in range(8) if _byte >> i & 1]
    _PLACE[_byte, : len(_set)] = _set


def select_bit(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of every word."""
    s = x - ((x >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    cum = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # set bits up to each byte
    byte = np.minimum(np.bitwise_count((((k.astype(_U) * _ONES) | _TOPS) - cum) & _TOPS), 7).astype(_U)
    shift = byte << _U(3)
    rest = k - (((cum << _U(8)) >> shift) & _U(255)).astype(np.int64)
    return shift.astype(np.int64) + _PLACE[((x >> shift) & _U(255)).astype(np.int64), rest & 7]


class EliasFano:
    def __init__(self, part: dict[str, np.ndarray]) -> None:
        # plain views of the mapped arrays: their look-ups cost less
        self.low, self.words, self.sample, self.inner = (np.asarray(part[k]).view(np.ndarray) for k in ("low", "high", "sample", "inner"))
        self.n, self.planes, self.buckets = (int(x) for x in part["meta"])
        self.upto = self.inner.reshape(-1)
        self.kind = np.uint8 if self.planes <= 1 else np.uint32 if self.planes <= 4 else np.uint64

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero."""
        block = np.searchsorted(self.sample, k, "right") - 1
        rest = k - self.sample[block]
        # the eight comparisons of a block are eight bytes, counted as one word
        upto = np.ascontiguousarray(self.inner.take(block, axis=0) <= rest.astype(np.uint16)[:, None])
        which = np.bitwise_count(upto.view(np.uint64)[:, 0]).astype(np.int64)
        at = block * BLOCK + which
        rest -= np.where(which > 0, self.upto.take(np.maximum(at - 1, 0)), 0)
        return at * 64 + select_bit(~self.words[at], rest)

    def _low(self, i: np.ndarray) -> np.ndarray:
        """Low bytes of values i, in the least type that holds them."""
        if not self.planes:
            return np.zeros(len(i), self.kind)
        out = self.low[0].take(i).astype(self.kind, copy=False)
        for k in range(1, self.planes):
            out |= self.low[k].take(i).astype(self.kind) << self.kind(8 * k)
        return out

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where the buckets of the high parts begin and end."""
        pos = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)
        lo = pos - high
        # the bucket is the run of ones at pos; most end in the same word
        word = self.words[pos >> 6] >> (pos & 63).astype(np.uint64)
        rest = ~word
        run = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero(run >= 64 - (pos & 63))
        if len(far):
            run[far] = self._zero(high[far]) - pos[far]
        return lo, lo + run

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value >= x, and whether it is x."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> np.uint64(8 * self.planes)).astype(np.int64) if self.planes < 8 else np.zeros(len(x), np.int64)
        inside = high < self.buckets
        low = (x & np.uint64((1 << (8 * self.planes)) - 1)).astype(self.kind)
        lo, end = self._bucket(np.minimum(high, self.buckets - 1))
        lo, end = np.where(inside, lo, self.n), np.where(inside, end, self.n)
        some = live = np.flatnonzero(lo < end)
        a, b, want = lo[live], end[live], low[live]
        while len(live):
            mid = (a + b) >> 1
            less = self._low(mid) < want
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            open_ = a < b
            more = np.count_nonzero(open_)
            if more < len(live):
                done = np.flatnonzero(~open_)
                lo[live[done]] = a[done]
                if not more:
                    break
                left = np.flatnonzero(open_)
                live, a, b, want = live[left], a[left], b[left], want[left]
        hit = np.zeros(len(x), bool)
        some = some[lo[some] < end[some]]
        hit[some] = self._low(lo[some]) == low[some]
        return lo, hit

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Number of values below x, that is, the place of the first value >= x."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x, -1 where it is absent."""
        at, hit = self._search(x)
        return np.where(hit, at, -1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i (for pointers): the i-th set bit tells the high part."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        full = BLOCK * 64
        before = np.arange(len(self.sample)) * full - self.sample  # ones before each block
        block = np.searchsorted(before, i, "right") - 1
        rest = i - before[block]
        ones = np.arange(64, full + 1, 64) - self.inner[block].astype(np.int64)
        which = (ones <= rest[:, None]).sum(axis=1)
        rest -= np.where(which > 0, ones[np.arange(len(i)), np.maximum(which, 1) - 1], 0)
        at = block * BLOCK + which
        high = at * 64 + select_bit(self.words[at], rest) - i
        return (high.astype(np.uint64) << np.uint64(8 * self.planes)) | self._low(i).astype(np.uint64)
