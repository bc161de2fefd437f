"""Minimal acyclic automata of word lists with perfect-hash word numbers, as numpy arrays, and searches with one error.

An automaton holds sorted distinct words. Its states are the distinct right languages of the words' trie; every
transition knows how many words sort before those that go through it, so that the sum along a word's path is the
word's place in the sorted list. All steps work on arrays over all words or all searches at once.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xD1B54A32D192ED03)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words as one array of code points, and where each begins."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.concatenate([[0], np.cumsum(self.length)])[:-1].astype(np.int64)
        self.code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)

    def same_prefix(self, i: np.ndarray, other: Words, j: np.ndarray, chars: np.ndarray, backward: bool = False) -> np.ndarray:
        """Whether word i and the other list's word j share their first (or last) so many code points."""
        same = (self.length[i] >= chars) & (other.length[j] >= chars)
        for k in range(int(chars.max(initial=0))):
            at = np.flatnonzero(same & (chars > k))
            if not len(at):
                break
            mine, its = self.begin[i[at]], other.begin[j[at]]
            here, there = (mine + self.length[i[at]] - 1 - k, its + other.length[j[at]] - 1 - k) if backward else (mine + k, its + k)
            same[at] &= self.code[here] == other.code[there]
        return same


class Automaton:
    """The minimal automaton of sorted distinct words."""

    def __init__(self, words: list[str]):
        w = Words(words)
        parents, codes, children, depth_of, finals = [], [], [], [0, 1], [np.zeros(1, bool)]
        node = np.zeros(len(words), np.int64)  # of each word's prefix so far
        if len(words) and w.length[0] == 0:
            finals[0][0] = True
        live, n = np.flatnonzero(w.length > 0), 1
        d = 0
        while len(live):
            at, c = node[live], w.code[w.begin[live] + d]
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (c[1:] != c[:-1])])
            own = n + np.cumsum(new) - 1
            parents.append(at[new])
            codes.append(c[new])
            children.append(own[new])
            node[live] = own
            d += 1
            done = w.length[live] == d
            final = np.zeros(int(new.sum()), bool)
            final[own[done] - n] = True
            finals.append(final)
            n += len(final)
            depth_of.append(n)
            live = live[~done]
        final = np.concatenate(finals)
        count, language = final.astype(np.int64), np.zeros(n, np.uint64)
        language[final] = _FINAL
        language[depth_of[d] : depth_of[d + 1]] = _scramble(language[depth_of[d] : depth_of[d + 1]] + _MIX)
        base = [np.zeros(0, np.int64)] * d
        for k in range(d - 1, -1, -1):  # a level's states have all their children on the next
            p, own = parents[k], children[k]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            below = np.cumsum(count[own])
            before = below - count[own]
            base[k] = before - np.repeat(before[first], np.diff(np.concatenate([first, [len(p)]]))) + final[p]
            language[p[first]] += np.add.reduceat(_scramble(_scramble(codes[k].astype(np.uint64) * _MIX) ^ language[own]), first)
            count[p[first]] += np.add.reduceat(count[own], first)
            done = slice(depth_of[k], depth_of[k + 1])
            language[done] = _scramble(language[done] + _MIX)
        _, first, state = np.unique(language, return_index=True, return_inverse=True)
        stands = np.zeros(n, bool)
        stands[first] = True
        if d:
            p, c, own, b = (np.concatenate(x) for x in (parents, codes, children, base))
            keep = stands[p]
            p, c, own, b = state[p[keep]], c[keep], state[own[keep]], b[keep]
            order = np.lexsort((c, p))
            self.source, self.code, self.target, self.base = p[order], c[order], own[order], b[order]
        else:
            self.source = self.code = np.zeros(0, np.int64)
            self.target = self.base = np.zeros(1, np.int64)  # what -1, no transition, looks up
        self.width = int(self.code.max(initial=0)) + 1
        self.key = self.source * self.width + self.code
        self.out = np.searchsorted(self.source, np.arange(len(first) + 1))
        self.final, self.start, self.states = final[first], int(state[0]), len(first)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The transition from each state by each code point, or -1."""
        if not len(self.key):
            return np.full(len(state), -1)
        wanted = state * self.width + code
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where((code < self.width) & (self.key[at] == wanted), at, -1)

    def number(self, words: list[str]) -> np.ndarray:
        """Each word's place in the sorted list, or -1."""
        w = Words(words)
        state, number = np.full(len(words), self.start), np.zeros(len(words), np.int64)
        live, d = np.arange(len(words)), 0
        while len(live := live[(number[live] >= 0) & (w.length[live] > d)]):
            t = self.step(state[live], w.code[w.begin[live] + d])
            number[live] = np.where(t >= 0, number[live] + self.base[t], -1)
            state[live] = np.where(t >= 0, self.target[t], state[live])
            d += 1
        return np.where((number >= 0) & self.final[state], number, -1)

    def within_one(self, w: Words, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (search, word number) of words that differ by one inserted, deleted or replaced code point behind the first ``exact`` ones, each pair once."""
        n = len(w.length)
        state, number, alive = np.full(n, self.start), np.zeros(n, np.int64), w.length >= exact
        last = int(exact.max(initial=0))
        for d in range(last):
            at = np.flatnonzero(alive & (exact > d))
            t = self.step(state[at], w.code[w.begin[at] + d])
            alive[at] = t >= 0
            number[at] = np.where(t >= 0, number[at] + self.base[t], 0)
            state[at] = np.where(t >= 0, self.target[t], self.start)
        clean = np.flatnonzero(alive)
        place = exact[clean].astype(np.int64)  # of the code point that each clean search is to match next
        empty = np.zeros(0, np.int64)
        wrong = (empty, empty, empty, empty)  # search, state, place, number: with the error behind it
        found: list[tuple[np.ndarray, np.ndarray]] = []
        most = 4 * n + 1024
        while len(clean) or len(wrong[0]):
            s, k = state[clean], number[clean]
            within = place < w.length[clean]
            c = np.where(within, w.code[np.minimum(w.begin[clean] + place, max(len(w.code) - 1, 0))] if len(w.code) else 0, -1)
            fan = self.out[s + 1] - self.out[s]
            by = np.repeat(np.arange(len(clean)), fan)
            t = np.arange(len(by)) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(self.out[s], fan)
            other = within[by] & (self.code[t] != c[by]) if len(t) else np.zeros(0, bool)
            begun = [
                (clean[by], self.target[t], place[by], k[by] + self.base[t]),  # inserted
                (clean[by[other]], self.target[t[other]], place[by[other]] + 1, k[by[other]] + self.base[t[other]]),  # replaced
                (clean[within], s[within], place[within] + 1, k[within]),  # deleted
            ]
            wrong = tuple(np.concatenate(x) for x in zip(wrong, *begun, strict=True))
            t = self.step(s[within], c[within])
            on = np.flatnonzero(within)[t >= 0]
            t = t[t >= 0]
            clean, place = clean[on], place[on] + 1
            state[clean], number[clean] = self.target[t], k[on] + self.base[t]
            q, s, at, k = wrong
            over = at >= w.length[q]
            hit = over & self.final[s]
            if hit.any():
                found.append((q[hit], k[hit]))
            q, s, at, k = (x[~over] for x in wrong)
            t = self.step(s, w.code[w.begin[q] + at])
            on = t >= 0
            t = t[on]
            wrong = (q[on], self.target[t], at[on] + 1, k[on] + self.base[t])
            if len(wrong[0]) > most:  # runs of one letter: many places of the error lead to the same
                wrong = tuple(np.unique(np.stack(wrong), axis=1))
                most = max(4 * n + 1024, 2 * len(wrong[0]))
        if not found:
            return empty, empty
        q, k = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(np.stack([q, k]), axis=1) if len(q) else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]
