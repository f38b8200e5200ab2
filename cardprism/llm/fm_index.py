"""A bidirectional FM-index of one shard's symbol sequence, for phrases of a
limited length, with interval extension for many phrases at once.

Suffixes are sorted by their first ``depth`` symbols only.  That is enough for
phrases of up to ``depth`` symbols: the interval of cP begins at the number of
symbols below c plus the number of c's in the BWT before P's interval, and
both depend on the order by those symbols alone."""

from __future__ import annotations

import numpy as np


def order_of(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys up to ``most``, and the sorted keys.  Key and place
    are sorted as one number where they fit (several times as fast)."""
    place = np.arange(len(key))
    bits = max(1, len(key)).bit_length()
    if most.bit_length() + bits < 64:
        both = np.sort((key.astype(np.int64) << bits) | place)
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(key, kind="stable")
    return order, key[order]


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols; symbols behind the end
    count as 0."""
    symbols = int(seq.max()) + 1
    rank, ranks, order = seq.astype(np.int64), symbols, None
    for d in range(1, depth):
        key = rank * symbols
        key[:len(seq) - d] += seq[d:]
        order, key = order_of(key, ranks * symbols)
        if d < depth - 1:
            turn = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            rank, ranks = np.empty_like(rank), int(turn[-1]) + 1
            rank[order] = turn
    return order if depth > 1 else order_of(rank, symbols)[0]


class Half:
    """BWT of one direction and the step from a symbol to its place among the
    sorted symbols (LF)."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.bwt = seq[suffix_order(seq, depth) - 1]   # before the first symbol: the last one, a separator
        self.symbols = int(seq.max()) + 1
        self.step = np.empty(len(seq), np.int32)
        self.step[order_of(self.bwt, self.symbols)[0]] = np.arange(len(seq), dtype=np.int32)

    def extend(self, lo: np.ndarray, other: np.ndarray, n: np.ndarray):
        """All one-symbol extensions of the intervals ``lo, n`` (``other``:
        where they begin in the other half): parent, symbol, lo, other, n."""
        parent = np.repeat(np.arange(len(lo)), n)
        begin = np.cumsum(n) - n
        at = np.arange(len(parent)) + (lo - begin)[parent]
        order, key = order_of(parent * self.symbols + self.bwt[at], max(1, len(lo)) * self.symbols)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(key)])
        up, sym = key[first] // self.symbols, key[first] % self.symbols
        ext = (up, sym, self.step[at[order[first]]].astype(np.int64), other[up] + first - begin[up], count)
        real = sym > 0
        return tuple(x[real] for x in ext)


class BiIndex:
    """``seq``: symbols from 1 on; 0 separates and ends it."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq = seq
        self.forward, self.backward = Half(seq, depth), Half(seq[::-1], depth)

    def symbols(self):
        """Intervals of the single symbols: symbol, lo, lo backward, n."""
        n = np.bincount(self.seq)
        lo = np.cumsum(n) - n
        sym = np.flatnonzero(n)
        sym = sym[sym > 0]
        return sym, lo[sym], lo[sym], n[sym]

    def left(self, lo, rlo, n):
        """Extensions to the left: parent, symbol, lo, rlo, n."""
        return self.forward.extend(lo, rlo, n)

    def right(self, lo, rlo, n):
        """Extensions to the right: parent, symbol, lo, rlo, n."""
        parent, sym, rlo, lo, n = self.backward.extend(rlo, lo, n)
        return parent, sym, lo, rlo, n
