"""FM-index of a delimited vocabulary, searched for words that differ by one error, in numpy.

The text of the index is every word in code-point order, each followed by a delimiter. Suffixes are sorted up to their
delimiter and then by word, so the delimiters of the suffix order are the words in order, and a step to the left from
an interval of suffixes is two binary searches in the table of (letter before, rank) pairs. ``near`` takes many
patterns at once: each matches its right part exactly, from its delimiter on, and goes on over its left part allowing
one letter replaced, inserted or left out. The same on reversed words takes the other half; together they are the two
searches of the scheme for one error in two parts.
"""

from __future__ import annotations

import numpy as np


def delimited(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The letters of words laid end to end, with a 0 after each word."""
    out = np.zeros(len(letters) + len(sizes), dtype=np.int64)
    out[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = letters
    return out


def backwards(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The letters of words laid end to end, every word read from its end."""
    ends = np.cumsum(sizes)
    return letters[np.repeat(ends - 1 + (ends - sizes), sizes) - np.arange(len(letters))]


def suffix_order(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffixes of delimited words in order, ties up to the delimiter by word. By doubling, until all ranks differ."""
    n, words = len(text), len(sizes)
    rank = text + words
    rank[text == 0] = np.arange(words)  # each delimiter has a rank of its own, so what follows it decides nothing
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Index:
    """The index of distinct words in code-point order, given as letters (from 1) end to end and sizes."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray, top: int):
        text = delimited(letters, sizes)
        self.words, self.n, self.top = len(sizes), len(text), top
        before = np.concatenate([[0], text[:-1]])  # what stands before a word is a delimiter
        self.before = before[suffix_order(text, sizes)] if len(text) else before[:0]
        self.table = np.sort(self.before * (self.n + 1) + np.arange(self.n))

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more letter on the left."""
        base = letter * (self.n + 1)
        return np.searchsorted(self.table, base + low), np.searchsorted(self.table, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state, letter, low, high) for every letter that some word has before the interval."""
        size = high - low
        few = np.flatnonzero(size <= self.top)
        many = np.flatnonzero(size > self.top)
        of = np.repeat(few, size[few])
        spots = np.arange(len(of)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + low[of]
        pairs = np.unique(of * (self.top + 1) + self.before[spots])
        every = (many[:, None] * (self.top + 1) + np.arange(1, self.top + 1)[None, :]).ravel()
        pairs = np.concatenate([pairs[pairs % (self.top + 1) > 0], every])
        state, letter = pairs // (self.top + 1), pairs % (self.top + 1)
        a, b = self.step(letter, low[state], high[state])
        real = b > a
        return state[real], letter[real], a[real], b[real]

    def near(self, letters: np.ndarray, sizes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word): the words that differ from a pattern by one error among its ``left`` first letters.

        ``left`` is how many letters lie on the left of the part that has to match exactly. An inserted letter may
        also stand on the border of the two parts.
        """
        starts = np.cumsum(sizes) - sizes
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for part in np.unique(left):  # patterns of one length of the left part go together
            found.append(self._near(letters, starts, sizes, np.flatnonzero(left == part), int(part)))
        both = np.unique(np.concatenate([p for p, _ in found]) * max(1, self.words) + np.concatenate([w for _, w in found]))
        return both // max(1, self.words), both % max(1, self.words)

    def _near(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, who: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(who), dtype=np.int64), np.full(len(who), self.words, dtype=np.int64)
        for back in range(1, int((sizes[who] - part).max(initial=0)) + 1):
            on = np.flatnonzero(sizes[who] - part >= back)
            low[on], high[on] = self.step(letters[starts[who[on]] + sizes[who[on]] - back], low[on], high[on])
            alive = high > low
            who, low, high = who[alive], low[alive], high[alive]
        none = np.zeros(0, dtype=np.int64)
        late = (none, none, none)  # states with their error behind them
        for rest in range(part, -1, -1):
            state, letter, a, b = self.branches(low, high)
            late = _both(late, (who[state], a, b))  # a letter more than the pattern has
            if rest == 0:
                break
            due = letters[starts[who] + rest - 1]
            moved = self.step(letters[starts[late[0]] + rest - 1], late[1], late[2])
            other, same = letter != due[state], letter == due[state]
            late = _both((late[0], *moved), (who[state[other]], a[other], b[other]))
            late = _both(late, (who, low, high))  # a letter less
            who, low, high = who[state[same]], a[same], b[same]
            alive = late[2] > late[1]
            late = tuple(x[alive] for x in late)
        a, b = self.step(np.zeros(len(late[0]), dtype=np.int64), late[1], late[2])
        whole = b > a
        return late[0][whole], a[whole]


def _both(x: tuple, y: tuple) -> tuple:
    return tuple(np.concatenate([a, b]) for a, b in zip(x, y, strict=True))
