"""Shingle sets and MinHash values of whole texts in numpy, for Arrow batches inside tasks.

Words are those of ``text.WORD`` with A-Z lower-cased. A text's set holds 64-bit hashes of its distinct
five-word windows; fewer words make one window, the whole sequence; no words make an empty set. All
passes run over pieces of bounded size, so a very long text needs memory for its word hashes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

PIECE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and of its inverse, for positions of a piece."""
    def table(base: int) -> np.ndarray:
        factors = np.full(PIECE + 1, base & (2**64 - 1), dtype=np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    return table(_BASE), table(pow(_BASE, -1, 2**64))


def _piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in at most PIECE bytes."""
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers()
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * down[starts])


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space into pieces of at most PIECE bytes; a longer word is a piece alone."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(bytes([c]), at, at + PIECE) for c in (9, 10, 11, 12, 13, 32))
        if cut < at:
            later = [x for x in (text.find(bytes([c]), at) for c in (9, 10, 11, 12, 13, 32)) if x >= 0]
            cut = min(later, default=len(text))
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _long_words(text: bytes) -> np.ndarray:
    parts = []
    for piece in _pieces(text):
        if len(piece) > PIECE:
            digest = hashlib.blake2b(piece.strip(b" \t\n\v\f\r").lower(), digest_size=8).digest()
            parts.append(np.frombuffer(digest, dtype=np.uint64))
        else:
            parts.append(_piece_words(np.frombuffer(piece, dtype=np.uint8))[1])
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    group, size = [], 0

    def flush() -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n".join(group), dtype=np.uint8)
        starts, hashes = _piece_words(data)
        begins = np.cumsum([0] + [len(g) + 1 for g in group])
        cuts = np.searchsorted(starts, begins)
        for i in range(len(group)):
            yield hashes[cuts[i]:cuts[i + 1]]

    for text in texts:
        raw = text.encode() if text else b""
        if group and size + len(raw) + 1 > PIECE:
            yield from flush()
            group, size = [], 0
        if len(raw) >= PIECE:
            yield _long_words(raw)
        else:
            group.append(raw)
            size += len(raw) + 1
    if group:
        yield from flush()


_WINDOW = np.array([pow(0xD6E8FEB86659FD93, j + 1, 2**64) for j in range(5)], dtype=np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's word hashes."""
    n = len(words)
    if n == 0:
        return words
    if n < 5:
        return mixed(np.array([np.sum(words * _WINDOW[:n]) + np.uint64(n)], dtype=np.uint64))
    total = words[:n - 4] * _WINDOW[0]
    for j in range(1, 5):
        total = total + words[j:n - 4 + j] * _WINDOW[j]
    return np.unique(mixed(total))


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    for words in word_hashes(texts):
        yield shingle_set(words)


def multipliers(k: int, seed: int) -> np.ndarray:
    """``k`` odd 64-bit factors, one per MinHash function."""
    return mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed)) | np.uint64(1)


def minhash(shingles: np.ndarray, factors: np.ndarray, rows: int = 512) -> np.ndarray:
    """The least value of a non-empty set under each function."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), rows):
        np.minimum(best, (shingles[at:at + rows, None] * factors[None, :]).min(axis=0), out=best)
    return best
