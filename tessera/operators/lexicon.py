"""Words of a dictionary at all places of many stretches, and the best paths through them, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers of up to so many values are kept in 64 bits.
ROOM = 1 << 62
#: Characters times lengths of words that are held as one table of weights.
CELLS = 8_000_000
#: A weight that no path takes.
NONE = -(1 << 60)


def codes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings one after the other, and how many each has."""
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), "")[0].as_py()
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)


class Numbers:
    """Different numbers, each found by a hash; their order is the index's own."""

    def __init__(self, numbers: np.ndarray):
        self.bits = max(1, int(2 * len(numbers)).bit_length())
        bucket = self._bucket(numbers)
        self.order = np.argsort(bucket, kind="stable")
        self.numbers = numbers[self.order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << self.bits))]).astype(np.int32)

    def _bucket(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted numbers are there, and as which ones."""
        bucket = self._bucket(wanted)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        which = np.flatnonzero(at < end)
        at, end, out = at[which], end[which], []
        while len(which):
            hit = self.numbers[at] == wanted[which]
            out.append((which[hit], at[hit]))
            more = ~hit & (at + 1 < end)
            which, at, end = which[more], at[more] + 1, end[more]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none)


class Words:
    """Words by length. A word is one number, made of the ranks of its characters; where more don't fit, the number of its beginning gives way to that beginning's rank."""

    def __init__(self, words: pa.Array, weights: np.ndarray):
        points, size = codes(words)
        there = np.zeros(0x110000, np.int32)
        there[points] = 1
        self.rank = np.cumsum(there, dtype=np.int32) * there
        self.base = int(self.rank.max()) + 1
        begin, number, room = np.cumsum(size) - size, np.zeros(len(size), np.int64), 1
        self.lengths: dict[int, tuple[Numbers, np.ndarray]] = {}
        self.beginnings: dict[int, Numbers] = {}
        live = np.arange(len(size))
        for d in range(int(size.max(initial=0))):
            live = live[size[live] > d]
            if room * self.base > ROOM:
                before = self.beginnings[d] = Numbers(np.unique(number[live]))
                which, rank = before.find(number[live])
                number[live[which]] = rank
                room = len(before.numbers)
            number[live] = number[live] * self.base + self.rank[points[begin[live] + d]]
            room *= self.base
            done = live[size[live] == d + 1]
            if len(done):
                found = Numbers(number[done])
                self.lengths[d + 1] = found, weights[done[found.order]]
                found.order = None  # needed no more


class Paths:
    """Stretches, the longest first, as characters by their distance from the end: those at one distance lie together, in the order of the stretches."""

    def __init__(self, size: np.ndarray, lengths: list[int]):
        self.size, self.begin = size, np.cumsum(size) - size
        self.count = len(size) - np.concatenate([[0], np.cumsum(np.bincount(size))[:-1]])
        self.at = np.concatenate([[0], np.cumsum(self.count)])
        self.lengths = [k for k in lengths if k <= size[0]]
        #: An option is its weight times scale, plus its number; the longer ones have the higher numbers.
        self.scale = 1 << (len(self.lengths) + 1).bit_length()
        self.options = np.full((len(self.lengths), self.at[-1]), NONE, np.int64)

    def put(self, length: int, place: np.ndarray, weight: np.ndarray) -> None:
        no = self.lengths.index(length)
        self.options[no, place] = weight.astype(np.int64) * self.scale + no + 1

    def search(self, points: np.ndarray, words: Words) -> None:
        """Puts all words that the stretches, given as their code points, hold."""
        stretch = np.repeat(np.arange(len(self.size)), self.size)
        far = np.repeat(self.size + self.begin, self.size) - np.arange(len(points))
        home = self.at[far] + stretch
        char = np.zeros(self.at[-1], np.int32)  # at distance 0 is none
        char[home] = words.rank[points]
        number = np.zeros(len(home), np.int64)
        for d in range(self.lengths[-1] if self.lengths else 0):
            here = char[self.at[far - d] + stretch]
            live = here > 0
            stretch, far, home, number, here = stretch[live], far[live], home[live], number[live], here[live]
            if d in words.beginnings:
                which, number = words.beginnings[d].find(number)
                stretch, far, home, here = stretch[which], far[which], home[which], here[which]
            number = number.astype(np.int64) * words.base + here
            if d + 1 in words.lengths:
                found, weight = words.lengths[d + 1]
                which, no = found.find(number)
                self.put(d + 1, home[which], weight[no])

    def found(self) -> tuple[np.ndarray, ...]:
        """stretch, begin, length and weight of each word that was put, by stretch."""
        no, place = np.nonzero(self.options != NONE)
        far = np.searchsorted(self.at, place, "right") - 1
        stretch = place - self.at[far]
        order = np.argsort(stretch, kind="stable")
        out = stretch, self.size[stretch] - far, np.array(self.lengths, np.int64)[no], (self.options[no, place] - no - 1) // self.scale
        return tuple(x[order] for x in out)

    def best(self, single: int) -> tuple[np.ndarray, np.ndarray]:
        """The last characters of the words of each stretch's best path, as best_path has them, and how many there are of each stretch."""
        score, step = np.zeros(self.at[-1], np.int64), np.zeros(self.at[-1], np.int64)
        for far in range(1, len(self.count)):
            n, at = self.count[far], self.at
            best = score[at[far - 1] : at[far - 1] + n] + single * self.scale
            for no, k in enumerate(self.lengths):
                if k > far:
                    break
                np.maximum(best, score[at[far - k] : at[far - k] + n] + self.options[no, at[far] : at[far] + n], out=best)
            here = slice(at[far], at[far] + n)
            step[here] = best & (self.scale - 1)
            score[here] = best - step[here]
        width, last = np.array([1, *self.lengths], np.int64), np.zeros(int(self.size.sum()), bool)
        stretch, far = np.arange(len(self.size)), self.size
        while len(stretch):
            far = far - width[step[self.at[far] + stretch]]
            last[self.begin[stretch] + self.size[stretch] - far - 1] = True
            stretch, far = stretch[far > 0], far[far > 0]
        ends = np.flatnonzero(last)
        count = np.add.reduceat(last, self.begin, dtype=np.int64)
        return ends - np.repeat(self.begin, count), count


def few_at_a_time(size: np.ndarray, lengths: int) -> Iterator[np.ndarray]:
    """Which stretches to hold as one table: the longest first, those of like size together, of CELLS cells or else a single one."""
    order = np.argsort(-size, kind="stable")
    upto = np.cumsum(size[order] + 1) * max(1, lengths)
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right")))
        yield order[at:end]
        at = end


def lists(flat: np.ndarray, count: np.ndarray) -> pa.Array:
    """Lists of so many 32-bit numbers each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat.astype(np.int32)))
