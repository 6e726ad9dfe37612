"""A bidirectional FM-index over a delimited vocabulary, searched for many patterns at once.

The text is ``$w1$w2$...$wn$`` with the words in order, so the suffixes that start with the
delimiter are ranked as the words are: the rank of a match of ``$w$`` is the word.  The index keeps
the transform of the text and that of the reversed text.  A state is an interval of suffix ranks in each of the
two for one and the same string; it can be extended by a symbol on either side, and all states of a step are extended
together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_STEP = 64  # places between stored counts


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Ranks by doubling; words are short, so few rounds are needed."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    fresh = np.append(True, text[order[1:]] != text[order[:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = np.cumsum(fresh), 0
    reach = 1
    while not fresh.all():
        key = rank[:n] * (n + 2) + rank[np.minimum(np.arange(n) + reach, n)]
        order = np.argsort(key, kind="stable")
        fresh = np.append(True, key[order[1:]] != key[order[:-1]])
        rank[order] = np.cumsum(fresh)
        reach *= 2
    return order


class _Transform:
    """The transform of a text, with the number of each symbol before each place."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = _suffix_array(text)
        bwt = text[order - 1]  # before the first symbol stands the last one
        n = len(bwt)
        padded = np.full(-(-(n + 1) // _STEP) * _STEP, symbols, dtype=np.int32)
        padded[:n] = bwt
        self.flat, self.rows = padded, padded.reshape(-1, _STEP)
        row = np.repeat(np.arange(len(self.rows)), _STEP)[:n]
        held = np.bincount(row * symbols + bwt, minlength=len(self.rows) * symbols)
        held = held.reshape(-1, symbols)
        self.before = np.cumsum(held, axis=0) - held
        self.symbols = symbols

    def all_counts(self, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each of ``places``: a row a place."""
        row, left = places // _STEP, places % _STEP
        at = np.repeat(np.arange(len(places)), left)
        inside = np.arange(len(at)) - np.repeat(np.cumsum(left) - left, left)
        symbol = self.rows[row[at], inside]
        more = np.bincount(at * self.symbols + symbol, minlength=len(places) * self.symbols)
        return self.before[row] + more.reshape(-1, self.symbols)

    def counts(self, places: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        row, left = places // _STEP, places % _STEP
        inside = (self.rows[row] == symbol[:, None]) & (np.arange(_STEP) < left[:, None])
        return self.before[row, symbol] + inside.sum(axis=1)


@dataclass
class States:
    """Rows: the pattern, the first rank in the text and in the reversed text, the size of both."""

    pattern: np.ndarray
    low: np.ndarray
    reverse: np.ndarray
    size: np.ndarray

    def __len__(self) -> int:
        return len(self.pattern)

    def take(self, which: np.ndarray) -> States:
        return States(self.pattern[which], self.low[which], self.reverse[which], self.size[which])


def joined(parts: list[States]) -> States:
    names = ("pattern", "low", "reverse", "size")
    return States(*(np.concatenate([getattr(p, n) for p in parts]) for n in names))


class Index:
    """The index of ``words``, distinct and in order, as arrays of symbols from 1 on; 0 delimits."""

    def __init__(self, words: list[np.ndarray], symbols: int) -> None:
        delimiter = np.zeros(1, dtype=np.int64)
        parts = [x for w in words for x in (delimiter, w)] + [delimiter]
        text = np.concatenate(parts).astype(np.int64)
        self.forward = _Transform(text, symbols)
        self.backward = _Transform(text[::-1], symbols)
        totals = np.bincount(text, minlength=symbols)
        self.first = np.cumsum(totals) - totals
        self.delimiters, self.length = int(totals[0]), len(text)

    def start(self, patterns: np.ndarray) -> States:
        """The delimiter, once for each pattern."""
        zeros = np.zeros(len(patterns), dtype=np.int64)
        return States(patterns, zeros, zeros.copy(), np.full(len(patterns), self.delimiters))

    def _sides(self, states: States, left: bool):
        return (self.forward, states.low, states.reverse) if left else (self.backward, states.reverse, states.low)

    def _counted(self, states: States, left: bool):
        transform, low, _ = self._sides(states, left)
        before = transform.all_counts(low)
        held = transform.all_counts(low + states.size) - before
        return before, held, np.cumsum(held, axis=1) - held

    def _grown(self, states: States, left: bool, rank, smaller, size, symbol) -> States:
        _, _, other = self._sides(states, left)
        low, other = self.first[symbol] + rank, other + smaller
        return States(states.pattern, *((low, other) if left else (other, low)), size)

    def _single(self, states: States, left: bool, which: np.ndarray, symbol: np.ndarray) -> States:
        """States of one match, by the only symbol beside it."""
        kept = states.take(which)
        transform, low, _ = self._sides(kept, left)
        return self._grown(kept, left, transform.counts(low, symbol), 0, kept.size, symbol)

    def extend(self, states: States, symbol: np.ndarray, left: bool) -> tuple[States, np.ndarray]:
        """Each state by its symbol; and which states had a match."""
        transform, low, _ = self._sides(states, left)
        one = states.size == 1
        alone = np.flatnonzero(one & (transform.flat[low] == symbol))
        several = np.flatnonzero(~one)
        made = self._single(states, left, alone, symbol[alone])
        if not len(several):
            return made, alone
        more, its = states.take(several), symbol[several]
        before, held, smaller = self._counted(more, left)
        row = np.arange(len(several))
        grown = self._grown(more, left, before[row, its], smaller[row, its], held[row, its], its)
        found = np.flatnonzero(grown.size > 0)
        return joined([made, grown.take(found)]), np.concatenate((alone, several[found]))

    def branch(self, states: States, left: bool) -> tuple[States, np.ndarray]:
        """Each state by every symbol but the delimiter; and the symbol."""
        transform, low, _ = self._sides(states, left)
        one, beside = states.size == 1, transform.flat[low]
        alone = np.flatnonzero(one & (beside > 0))
        several = states.take(~one)
        made = self._single(states, left, alone, beside[alone])
        before, held, smaller = self._counted(several, left)
        row, symbol = np.nonzero(held[:, 1:])
        symbol = symbol + 1
        grown = self._grown(
            several.take(row), left, before[row, symbol], smaller[row, symbol], held[row, symbol], symbol
        )
        return joined([made, grown]), np.concatenate((beside[alone].astype(np.int64), symbol))


def near(index: Index, patterns: np.ndarray, sizes: np.ndarray, exact_left: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(pattern, word)`` of words that differ from a pattern by one insertion, deletion or
    replacement in its right half (``exact_left``) or left half, the other half being as it is.

    ``patterns`` has a row of symbols each, filled up.  The left half of ``n`` symbols has ``n // 2``.
    """
    n, last = len(patterns), patterns.shape[1] - 1
    half = sizes // 2 if exact_left else sizes - sizes // 2
    left = not exact_left

    def symbol(which: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = place if exact_left else sizes[which] - 1 - place
        return patterns[which, np.clip(at, 0, last)]

    def distinct(parts: list[tuple[States, int]]) -> tuple[States, np.ndarray]:
        """States with one error and its kind; those that came to one string only once."""
        states = joined([s for s, _ in parts])
        kind = np.concatenate([np.full(len(s), k) for s, k in parts])
        key = (states.pattern * 3 + kind + 1) * index.length + states.low
        _, first = np.unique(key, return_index=True)
        return states.take(first), kind[first]

    # ``exact`` states have no error yet.  ``wrong`` ones have one: a symbol more (-1, which puts them
    # one place behind the exact ones), another one (0), or one left out (1).
    exact, wrong = index.start(np.arange(n)), []
    found_pattern, found_word = [], []
    place = 0
    while len(exact) or wrong:
        if wrong:
            states, kind = distinct(wrong)
            at = place + np.minimum(kind, 0)
            done = at >= sizes[states.pattern]
            closed, _ = index.extend(states.take(done), np.zeros(int(done.sum()), dtype=np.int64), left)
            # The suffixes that start with the delimiter come first: the one at the end, then the
            # words in order.
            found_pattern.append(closed.pattern)
            found_word.append(closed.low - 1)
            states, at, kind = states.take(~done), at[~done], kind[~done]
            moved, which = index.extend(states, symbol(states.pattern, at), left)
            wrong = [(moved.take(kind[which] == k), k) for k in (-1, 0, 1)] if len(moved) else []
        free = exact.take(place >= half[exact.pattern])
        if len(free):
            here = lambda states: np.full(len(states), place)
            # One more symbol in the word.
            made, extra = index.branch(free, left)
            wrong.append((made, -1))
            # Another symbol in place of this one.
            other = (place < sizes[made.pattern]) & (extra != symbol(made.pattern, here(made)))
            wrong.append((made.take(other), 0))
            # This symbol left out.
            wrong.append((free.take(place < sizes[free.pattern]), 1))
        exact = exact.take(place < sizes[exact.pattern])
        exact, _ = index.extend(exact, symbol(exact.pattern, np.full(len(exact), place)), left)
        place += 1
    if not found_pattern:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = np.unique(np.concatenate(found_pattern) * (index.delimiters + 1) + np.concatenate(found_word))
    return code // (index.delimiters + 1), code % (index.delimiters + 1)
