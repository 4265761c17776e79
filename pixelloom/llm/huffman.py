"""Canonical length-limited Huffman codes over integer symbols, in numpy.

``Code`` holds one length per symbol. Codes are canonical: ordered by length and then by symbol, so the
lengths alone are stored. Every text is coded from a byte boundary, with the bit offset of every
``CHECK``-th symbol as a checkpoint; from the checkpoints all stretches are decoded side by side with
one table look-up per symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols between two checkpoints.
CHECK = 128


def limited_lengths(weights: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive weights, by package-merge."""
    n = len(weights)
    if n < 2:
        return np.ones(n, dtype=np.uint8)
    if n > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.float64)
    row, flags = leaves, []
    for _ in range(limit - 1):
        packages = row[0:len(row) - 1:2] + row[1::2]
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        row = both[at]
        flags.append(at < n)
    lengths, take = np.zeros(n, dtype=np.uint8), 2 * n - 2
    for leaf in reversed(flags):
        picked = int(leaf[:take].sum())
        lengths[:picked] += 1
        take = 2 * (take - picked)
    lengths[:take] += 1
    out = np.zeros(n, dtype=np.uint8)
    out[order] = lengths
    return out


@dataclass(frozen=True)
class Code:
    """Lengths by symbol, 0 for symbols that do not occur."""

    lengths: np.ndarray
    limit: int

    @staticmethod
    def of_counts(counts: np.ndarray) -> Code:
        used = np.flatnonzero(counts)
        limit = max(1, int(np.ceil(np.log2(max(2, len(used))))) + 2)
        if limit > 25:
            raise ValueError("too many symbols for codes in four bytes")
        lengths = np.zeros(len(counts), dtype=np.uint8)
        lengths[used] = limited_lengths(counts[used], limit)
        return Code(lengths, limit)

    def _order(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        return used[np.lexsort((used, self.lengths[used]))]

    def codes(self) -> np.ndarray:
        """The code word of each symbol, right-aligned."""
        order = self._order()
        spans = np.uint64(1) << (self.limit - self.lengths[order].astype(np.uint64))
        starts = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.uint64) if len(order) else spans
        out = np.zeros(len(self.lengths), dtype=np.uint32)
        out[order] = starts >> (self.limit - self.lengths[order].astype(np.uint64))
        return out

    def table(self) -> np.ndarray:
        """The symbol for each value of the next ``limit`` bits."""
        order = self._order()
        spans = 1 << (self.limit - self.lengths[order].astype(np.int64))
        table = np.zeros(1 << self.limit, dtype=np.uint32)
        filled = np.repeat(order.astype(np.uint32), spans)
        table[:len(filled)] = filled
        return table


def encode(code_words: np.ndarray, code: Code, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code texts of the given ``sizes``, laid end to end in ``symbols``.

    Returns all bytes, the number of bytes of each text, and the bit offset within its text of every CHECK-th symbol.
    """
    if not len(symbols):
        return np.zeros(0, np.uint8), np.zeros(len(sizes), np.int64), np.zeros(0, np.uint32)
    length = code.lengths[symbols]
    ends = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.cumsum(length, out=ends[1:])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    n_bytes = (ends[firsts[1:]] - ends[firsts[:-1]] + 7) >> 3
    byte_starts = np.concatenate([[0], np.cumsum(n_bytes)])
    at = ends[:-1] + np.repeat(byte_starts[:-1] * 8 - ends[firsts[:-1]], sizes)
    where = at >> 3
    # a code starts in the first of four bytes, and codes of one starting byte do not overlap
    shifted = code_words[symbols] << ((32 - (at & 7)).astype(np.uint32) - length)
    groups = np.flatnonzero(np.diff(where, prepend=-1))
    merged, spots = np.add.reduceat(shifted, groups), where[groups]
    out = np.zeros(int(byte_starts[-1]) + 4, dtype=np.uint8)
    for k in range(4):
        out[spots + k] |= (merged >> np.uint32(24 - 8 * k)).astype(np.uint8)
    stretches = -(-sizes // CHECK)
    nth = np.arange(stretches.sum()) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    checks = at[np.repeat(firsts[:-1], stretches) + nth * CHECK] - np.repeat(byte_starts[:-1] * 8, stretches)
    return out[:-4], n_bytes, checks.astype(np.uint32)


def decode(table: np.ndarray, code: Code, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Decode stretches of ``counts`` symbols from the absolute bit offsets ``starts``, end to end."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(first[-1]), dtype=np.uint32)
    order = np.argsort(-counts, kind="stable")
    at, put, left = starts[order].astype(np.int64), first[:-1][order], counts[order]
    mask = np.uint32((1 << code.limit) - 1)
    for step in range(int(left[0])):
        live = int(np.searchsorted(-left, -step, side="left"))  # stretches with more than ``step`` symbols
        p = at[:live]
        found = table[(window[p >> 3] >> (32 - code.limit - (p & 7)).astype(np.uint32)) & mask]
        out[put[:live] + step] = found
        at[:live] = p + code.lengths[found]
    return out
