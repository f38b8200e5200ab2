"""64-bit hashes of all words of a text at once.

A word's hash is a polynomial over its bytes, each byte standing for a random
64-bit number; running sums give all words' values without a loop, and a
final mix spreads them.  It depends on the word only, so equal words have
equal hashes everywhere."""

from __future__ import annotations

import numpy as np
import xxhash

PIECE = 1 << 20   # bytes hashed at once; longer words are hashed by xxhash


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordHasher:
    """``blank``: which byte values separate words."""

    def __init__(self, blank: np.ndarray, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.blank, self.of = blank, rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**63, dtype=np.int64)) * 2 + 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.powers) <= n:
            size = min(PIECE, max(n + 1, 2 * len(self.powers))) + 1
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(self.base, -1, 2**64)
            self.inverses = np.cumprod(steps, dtype=np.uint64)

    def __call__(self, data: bytes) -> np.ndarray:
        a = np.frombuffer(data, np.uint8)
        return self._words(data, a, *self._bounds(a))

    def several(self, parts: list[bytes]) -> list[np.ndarray]:
        """The hashes of each of some texts, computed together.  Byte 32 must
        be among the separators."""
        data = b" ".join(parts)
        a = np.frombuffer(data, np.uint8)
        starts, ends = self._bounds(a)
        firsts = np.cumsum([0, *(len(p) + 1 for p in parts)])[1:-1]   # where all parts but the first begin
        return np.split(self._words(data, a, starts, ends), np.searchsorted(starts, firsts)) if parts else []

    def _bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = np.ones(len(a) + 2, np.int8)
        space[1:-1] = self.blank[a]
        turn = np.diff(space)
        return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)

    def _words(self, data: bytes, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.uint64)
        if len(a) <= PIECE:
            return self._piece(a, starts, ends)
        out, i = [], 0
        while i < len(starts):
            j = int(np.searchsorted(ends, starts[i] + PIECE, side="right"))
            if j > i:
                lo, hi = starts[i], ends[j - 1]
                out.append(self._piece(a[lo:hi], starts[i:j] - lo, ends[i:j] - lo))
                i = j
            else:   # one word that fills a piece
                out.append(np.array([xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]])], np.uint64))
                i += 1
        return np.concatenate(out)

    def _piece(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._tables(len(a))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.of[a] * self.powers[:len(a)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mix(h + (ends - starts).astype(np.uint64))
