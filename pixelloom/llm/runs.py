"""Runs of word bytes in the texts of an Arrow column, for Arrow batches inside tasks.

All works on the UTF-8 bytes of the column, in slices of about ``SLICE`` bytes that end where a text or a
run ends, so a very long text needs memory for its slice and not for its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Slice(NamedTuple):
    """Runs of one slice: the text of each, its number in ``distinct``, its bytes; and the distinct runs, as binary."""

    text: np.ndarray
    code: np.ndarray
    size: np.ndarray
    distinct: pa.Array


def _sliced(data: np.ndarray, offsets: np.ndarray, member: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that end where a text ends, or else, within a longer text, at a byte outside runs."""
    at, total = int(offsets[0]), int(offsets[-1])
    while at < total:
        end = min(at + SLICE, total)
        whole = int(offsets[np.searchsorted(offsets, end, "right") - 1])
        if whole > at:
            end = whole
        else:
            stop = int(offsets[np.searchsorted(offsets, at, "right")])
            while end < stop:
                free = np.flatnonzero(~member(data[at:end]))
                if len(free):
                    end = at + int(free[-1]) + 1
                    break
                end = min(end + SLICE, stop)
        yield at, end
        at = end


def runs(texts: pa.Array, member: Callable[[np.ndarray], np.ndarray]) -> Iterator[Slice]:
    """The maximal runs of bytes for which ``member`` is true, lower-cased (A-Z only), slice by slice.

    A slice never begins or ends within a run. NULL texts have no runs.
    """
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    _, marks, raw = filled.buffers()
    offsets = np.frombuffer(marks, np.int64)[filled.offset:filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    for at, end in _sliced(data, offsets, member):
        part = data[at:end]
        inside = member(part)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        breaks = offsets[(offsets > at) & (offsets < end)] - at
        first[breaks] |= inside[breaks]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[breaks - 1] |= inside[breaks - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        size = ends - starts
        kept = LOWER[part[inside]]
        cuts = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=cuts[1:])
        found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(cuts), pa.py_buffer(kept)]).dictionary_encode()
        yield Slice(np.searchsorted(offsets, starts + at, "right") - 1, found.indices.to_numpy().astype(np.int64), size, found.dictionary)


class Counter:
    """Counts of binary keys, added up in Arrow."""

    def __init__(self, limit: int):
        self.limit, self.parts, self.rows = limit, [], 0

    def add(self, keys: pa.Array, n: np.ndarray) -> None:
        self.parts.append(pa.table({"key": keys, "n": pa.array(n, pa.int64())}))
        self.rows += len(keys)

    @property
    def full(self) -> bool:
        """Whether more than ``limit`` keys are held; looked at when twice as many rows have come in."""
        if self.rows <= 2 * self.limit:
            return False
        table = self.table()
        self.parts, self.rows = [table], table.num_rows
        return self.rows > self.limit

    def table(self) -> pa.Table:
        """(key, n) of all that was added, one row a key."""
        if not self.parts:
            return pa.table({"key": pa.array([], pa.large_binary()), "n": pa.array([], pa.int64())})
        return pa.concat_tables(self.parts).group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])

    def largest(self, many: int) -> None:
        """Keep only the keys of largest count."""
        table = self.table()
        if table.num_rows > many:
            table = table.take(pc.select_k_unstable(table, many, [("n", "descending"), ("key", "ascending")]))
        self.parts, self.rows = [table], table.num_rows

    def drain(self) -> pa.Table:
        table = self.table()
        self.parts, self.rows = [], 0
        return table
