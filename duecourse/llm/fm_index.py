"""A compressed full-text index of one shard in numpy: wavelet matrix over the Burrows-Wheeler transform, vectorised backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; text holds small non-negative ints."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank * np.int64(max(n, int(text.max()) + 1) + 2) + second
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = changed
        if changed[-1] == n - 1:
            return order
        step *= 2


#: Masks of the bits below each bit.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A packed bit vector with counts per 64 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bool)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _BELOW[at & 63])


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64)).astype(np.int32)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for (shift, bits), zeros in zip(self.levels, self.zeros, strict=True):
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    @property
    def nbytes(self) -> int:
        return self.base.nbytes + sum(b.words.nbytes + b.before.nbytes for _, b in self.levels)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(symbol, at) - self.base[symbol]


class RangeMin:
    """Least value of any range: the values in as few bytes as they take, and a sparse table of the least of each block."""

    BLOCK = 32

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
        whole = len(values) // self.BLOCK
        table = [self.values[: whole * self.BLOCK].reshape(whole, self.BLOCK).min(1)] if whole else [self.values[:0]]
        step = 1
        while 2 * step <= whole:
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        self.flat = np.concatenate(table)
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in table])[:-1]])

    def _run(self, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
        """Least value of ranges of at most `width`, one at least."""
        return self.values[np.minimum(start[:, None] + np.arange(width), (end - 1)[:, None])].min(1)

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """low < high."""
        size = high - low
        out = self.values[low]
        few = np.flatnonzero((size > 1) & (size <= 8))
        if len(few):
            out[few] = self._run(low[few], high[few], 8)
        many = np.flatnonzero(size > 8)
        if len(many):
            a, b = low[many], high[many]
            held = np.minimum(self._run(a, np.minimum(a + self.BLOCK, b), self.BLOCK), self._run(np.maximum(b - self.BLOCK, a), b, self.BLOCK))
            first, last = -(-a // self.BLOCK), b // self.BLOCK  # whole blocks between
            wide = np.flatnonzero(first < last)
            level = np.frexp((last[wide] - first[wide]).astype(np.float64))[1] - 1
            at = self.start[level]
            held[wide] = np.minimum(held[wide], np.minimum(self.flat[at + first[wide]], self.flat[at + last[wide] - (1 << level)]))
            out[many] = held
        return out

    @property
    def nbytes(self) -> int:
        return self.values.nbytes + self.flat.nbytes


class FMIndex:
    """Index of several sequences, each with an owner (a small int); finds where a query occurs with an owner below a bound.

    It keeps the wavelet matrix, counts and owners, not the sequences.
    """

    #: From so few stretches on, the ends of matches are tried all at once.
    FEW = 400

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray):
        flat = np.concatenate(sequences)
        self.alphabet, inverse = np.unique(flat, return_inverse=True)
        sizes = np.array([len(s) for s in sequences])
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]), np.int64)  # 0 ends each sequence
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = inverse + 1
        order = suffix_array(text)
        self.size = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        counts = np.bincount(text, minlength=len(self.alphabet) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        self.owner = RangeMin(np.repeat(owners, sizes + 1)[order])

    @property
    def nbytes(self) -> int:
        return self.alphabet.nbytes + self.before.nbytes + self.wavelet.nbytes + self.owner.nbytes

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """A query's words as symbols of the index, 0 for those it doesn't have."""
        at = np.searchsorted(self.alphabet, words)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def reach(self, text: np.ndarray, end: np.ndarray, left: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Backward search in a query text of symbols from each `end` (inclusive) to the left, to `left` at most.

        Returns the first position of the longest match that ends there and occurs with an owner below `bound`;
        end + 1 if there is none. That is the matching statistic of `end`.
        """
        at = end + 1
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.size, np.int64)
        live = np.flatnonzero(end >= left)
        live = live[text[end[live]] > 0]
        while len(live):
            symbol = text[at[live] - 1]
            n = len(live)
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            new_low, new_high = self.before[symbol] + both[:n], self.before[symbol] + both[n:]
            good = new_low < new_high
            good[good] = self.owner.least(new_low[good], new_high[good]) < bound[live[good]]
            live = live[good]
            low[live], high[live] = new_low[good], new_high[good]
            at[live] -= 1
            live = live[at[live] > left[live]]
            live = live[text[at[live] - 1] > 0]
        return at

    def _zones(self, text: np.ndarray, first: np.ndarray, size: np.ndarray, bound: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, start, end) of the stretches that may hold a match of `threshold` words, in the text.

        Every such match holds one whole of the blocks of half as many words that a query is cut into; one backward search
        tries all blocks together, and each that matches opens a stretch around it.
        """
        half = max(1, threshold // 2)
        blocks = np.where(size >= threshold, size // half, 0)
        query = np.repeat(np.arange(len(size)), blocks)
        start = first[query] + half * (np.arange(len(query)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        hit = self.reach(text, start + half - 1, start, bound[query]) == start
        query, start = query[hit], start[hit]
        low = np.maximum(first[query], start - (threshold - half))
        high = np.minimum(first[query] + size[query], start + threshold)
        # overlapping stretches of a query are one
        new = np.flatnonzero(np.concatenate([[True], (query[1:] != query[:-1]) | (low[1:] > high[:-1])])) if len(query) else np.empty(0, np.int64)
        return query[new], low[new], high[np.append(new[1:] - 1, len(high) - 1)] if len(new) else high

    def repeats(self, queries: list[np.ndarray], bound: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of at least `threshold` words of the queries with an owner below each bound, which together cover all words that such matches cover.

        Returns (query number, start, end) with end exclusive, within the query.
        """
        size = np.array([len(q) for q in queries], np.int64)
        text = self.symbols(np.concatenate([*queries, np.empty(0, self.alphabet.dtype)]))
        first = np.cumsum(size) - size
        query, left, end = self._zones(text, first, size, bound, threshold)
        end, limit = end - 1, bound[query]
        live = np.flatnonzero(end - left + 1 >= threshold)
        out = []
        while len(live) > self.FEW:
            reached = self.reach(text, end[live], left[live], limit[live])
            hit = end[live] - reached + 1 >= threshold
            of = query[live[hit]]
            out.append((of, reached[hit] - first[of], end[live[hit]] + 1 - first[of]))
            # what stands before the match is `missed`; a further match takes it in and ends earlier, at missed + width - 1 at most
            missed = reached - 1
            go = missed >= left[live]
            live, missed = live[go], missed[go]
            most = np.minimum(end[live] - missed, threshold)  # widths that end before the last end
            least, failed = np.zeros(len(live), np.int64), np.zeros(len(live), bool)
            while len(open_ := np.flatnonzero(least < most)):  # the widest match that starts at missed, by doubling and then halving
                width = np.where(failed[open_], (least[open_] + most[open_] + 1) // 2, np.minimum(np.maximum(2 * least[open_], 1), most[open_]))
                got = self.reach(text, missed[open_] + width - 1, missed[open_], limit[live[open_]]) == missed[open_]
                least[open_[got]] = width[got]
                most[open_[~got]] = width[~got] - 1
                failed[open_[~got]] = True
            end[live] = missed + least - 1
            live = live[end[live] - left[live] + 1 >= threshold]
        # of the last few stretches all ends are tried together, not one after the other
        ends = end[live] - left[live] - threshold + 2
        at = np.repeat(live, ends)
        last = end[at] - (np.arange(len(at)) - np.repeat(np.cumsum(ends) - ends, ends))
        hit = self.reach(text, last, last - threshold + 1, limit[at]) == last - threshold + 1
        of, last = query[at[hit]], last[hit]
        out.append((of, last - threshold + 1 - first[of], last + 1 - first[of]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
