"""Elias-Fano coded n-gram levels that are searched in a memory-mapped file."""

from __future__ import annotations

import io

import numpy as np

BLOCK = 64  # bits per block of the upper bit vector


class EliasFano:
    """A monotone sequence of integers below 2**64.

    The `width` low bits of every value are packed; the high parts stand in unary in a bit vector
    (a one per value, a zero per step of the high part).  A count of the zeros before each 64-bit
    block finds a high part's run of values; the run is searched by its low bits.
    """

    def __init__(self, size: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.size, self.width, self.low, self.high, self.zeros = size, width, low, high, zeros

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * width >> 6) + 2, np.uint64)
        if width:
            part = values & np.uint64((1 << width) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        upper = (values >> np.uint64(width)).astype(np.int64)
        bits = n + (int(upper[-1]) if n else 0) + 1
        marks = np.zeros(-(-bits // BLOCK) * BLOCK, np.uint8)
        marks[upper + np.arange(n)] = 1
        free = BLOCK - marks.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        return cls(n, width, low, np.packbits(marks), np.concatenate([[0], np.cumsum(free)]))

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> shift | upper) & np.uint64((1 << self.width) - 1)

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the one or zero of each rank; behind the end for ranks that do not exist."""
        before = np.arange(len(self.zeros)) * BLOCK - self.zeros if ones else self.zeros
        block = np.searchsorted(before, rank, side="right") - 1
        inside = block < len(before) - 1
        found = np.full(len(rank), len(self.high) * 8, np.int64)
        marks = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[block[inside]], axis=1).astype(np.int8)
        order = np.cumsum(marks if ones else 1 - marks, axis=1, dtype=np.int8)
        want = (rank[inside] - before[block[inside]] + 1).astype(np.int8)
        found[inside] = block[inside] * BLOCK + (order >= want[:, None]).argmax(axis=1)
        return found

    def runs(self, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last position (exclusive) of the values with each high part."""
        first = np.where(upper > 0, self._select(np.maximum(upper - 1, 0), ones=False) + 1 - upper, 0)
        last = self._select(upper, ones=False) - upper
        return np.minimum(first, self.size), np.minimum(last, self.size)

    def successor(self, values: np.ndarray, start: np.ndarray | int = 0, stop: np.ndarray | None = None) -> np.ndarray:
        """Position of the first value that is not below each of `values`; start and stop tell where it must lie."""
        values = values.astype(np.uint64)
        upper = (values >> np.uint64(self.width)).astype(np.int64)
        want = values & np.uint64((1 << self.width) - 1)
        low, high = self.runs(upper)
        low, high = np.maximum(low, start), np.minimum(high, self.size if stop is None else stop)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high) // 2
            less = open_ & (self._lows(np.where(open_, middle, 0)) < want)
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at positions."""
        return (self._select(at, ones=True) - at).astype(np.uint64) << np.uint64(self.width) | self._lows(at)

    def find(self, values: np.ndarray, start: np.ndarray | int = 0, stop: np.ndarray | None = None) -> np.ndarray:
        """Position of each value, -1 where it is not in the sequence between start and stop."""
        at = self.successor(values, start, stop)
        same = at < (self.size if stop is None else stop)
        same[same] = self.get(at[same]) == values.astype(np.uint64)[same]
        return np.where(same, at, -1)


def quantised(values: np.ndarray, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes of equally wide bins, and the mean of the values in each bin."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float64)
    low, width = values.min(), max(float(np.ptp(values)), 1e-12) / ((1 << bits) - 1)
    codes = np.floor((values - low) / width).astype(np.uint8)
    return codes, np.bincount(codes, values) / np.maximum(np.bincount(codes), 1)


class NgramTrie:
    """Two levels in reverse order: words, and below each word the words seen before it.

    The second level holds, word by word, the identifiers of predecessors counted from the base of
    their word, so that its values are monotone over the whole level; `pointers` delimit a word's
    range.  Probabilities are codes of a small table.
    """

    PARTS = ("low", "high", "zeros")

    def __init__(self, words: EliasFano, pointers: EliasFano, below: EliasFano, arrays: dict[str, np.ndarray]):
        self.words, self.pointers, self.below, self.arrays = words, pointers, below, arrays

    @classmethod
    def build(cls, words: np.ndarray, alone: np.ndarray, owner: np.ndarray, before: np.ndarray, value: np.ndarray) -> NgramTrie:
        """words: sorted 64-bit identifiers with the value `alone` of an unseen predecessor; owner (row of
        the word), before (32-bit identifier): sorted pairs with their value."""
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        codes, table = quantised(value)
        alone_codes, alone_table = quantised(alone)
        levels = EliasFano.encode(words), EliasFano.encode(ends), EliasFano.encode(owner.astype(np.uint64) << np.uint64(32) | before.astype(np.uint64))
        return cls(*levels, {"codes": codes, "table": table, "alone_codes": alone_codes, "alone_table": alone_table})

    def write(self, file: io.BufferedIOBase) -> dict:
        """Append all arrays to a file; the result tells `mapped` where they are."""
        places = {}
        named = {f"{name}.{part}": getattr(level, part) for name, level in self._levels().items() for part in self.PARTS} | self.arrays
        for name, array in named.items():
            places[name] = (file.tell(), array.dtype.str, len(array))
            file.write(array.tobytes())
            file.write(b"\0" * (-file.tell() % 8))
        places["levels"] = {name: (level.size, level.width) for name, level in self._levels().items()}
        return places

    def _levels(self) -> dict[str, EliasFano]:
        return {"words": self.words, "pointers": self.pointers, "below": self.below}

    @classmethod
    def mapped(cls, path: str, places: dict) -> NgramTrie:
        def view(name: str) -> np.ndarray:
            offset, kind, length = places[name]
            return np.memmap(path, kind, "r", offset, (length,)) if length else np.zeros(0, kind)

        levels = [EliasFano(*places["levels"][n], *(view(f"{n}.{part}") for part in cls.PARTS)) for n in ("words", "pointers", "below")]
        return cls(*levels, {n: view(n) for n in ("codes", "table", "alone_codes", "alone_table")})

    def score(self, word: np.ndarray, before: np.ndarray, otherwise: float, at_once: int = 1 << 16) -> np.ndarray:
        """Value of each (word, word before): that of the pair, else the word's value alone, else `otherwise`."""
        out = np.full(len(word), otherwise)
        for start in range(0, len(word), at_once):
            part = slice(start, start + at_once)
            self._score(word[part], before[part], out[part])
        return out

    def _score(self, word: np.ndarray, before: np.ndarray, out: np.ndarray) -> None:
        row = self.words.find(word)
        known = np.flatnonzero(row >= 0)
        context = row[known]
        out[known] = self.arrays["alone_table"][self.arrays["alone_codes"][context]]
        stop = self.pointers.get(context).astype(np.int64)
        start = np.where(context > 0, self.pointers.get(np.maximum(context - 1, 0)).astype(np.int64), 0)
        pair = self.below.find(context.astype(np.uint64) << np.uint64(32) | before[known].astype(np.uint64), start, stop)
        seen = pair >= 0
        out[known[seen]] = self.arrays["table"][self.arrays["codes"][pair[seen]]]
