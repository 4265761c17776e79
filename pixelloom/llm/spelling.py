"""Spelling variants: words of the corpus one letter away from a much more frequent word.

Runs of letters are counted over all documents. A run whose hash with its document's id is divisible by ``EVERY``
loses one code point first, which plants misspellings at known places. Words of the vocabulary are searched in
bidirectional FM-indexes of it (``fmindex``): a word differs from a near one in its left or in its right half, so one half
is matched exactly and the search goes on over the other allowing one error.

The vocabulary is dealt so that no index holds all of it. What matches a word's right half ends in the same
``ANCHOR`` code points, what matches its left half begins with the same ones, as no half is shorter. So every word goes to
the index of its ending and to that of its beginning, rare endings sharing an index. A key with more than ``LETTERS``
letters is cut into blocks, and all pairs of a block that asks and a block that is searched are tasks of their own. A near
word found over both halves counts where its beginning matches.

Defined cases: NULL and empty texts have no runs; a NULL id counts as the empty text in the hash; rows of equal
id and text lose the same code points; words without a near word have ``n_near`` 0 and themselves as root; an empty
table gives no rows. Words may have any length. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import fmindex
from pixelloom.llm.runs import Counter, runs
from pixelloom.llm.store import narrow_batches, small, written

LEAST_SIZE, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
#: Code points that near words share at one end: the shorter half of the shortest word.
ANCHOR = LEAST_SIZE // 2
#: Letters of an index, and of the words that ask in one task.
LETTERS = 1 << 20
_BATCH, _HELD, _SHORT = 8 << 20, 300_000, 64

_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x41:0x5B] = _LATIN[0x61:0x7B] = _LATIN[0xC3] = True


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF: the latter are 0xC3 and a byte after it."""
    out = _LATIN[data]
    out[1:] |= data[:-1] == 0xC3
    return out


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _hashes(prefixes: list[bytes], of: np.ndarray, code: np.ndarray, size: np.ndarray, distinct: list[bytes]) -> np.ndarray:
    """CRC-32 of each run after its text's prefix.

    CRC-32 of a text in two parts is that of the first, moved on by as many zero bytes as the second has, xor that of the
    second. So each distinct run is hashed once, and each prefix is moved on step by step for all lengths.
    """
    crcs = np.array([zlib.crc32(w) for w in distinct], dtype=np.uint32)
    out = np.empty(len(of), dtype=np.uint32)
    state = np.array([zlib.crc32(p) for p in prefixes], dtype=np.uint32)
    order = np.argsort(size, kind="stable")
    cuts = np.searchsorted(size[order], np.arange(_SHORT + 2))
    for n in range(1, _SHORT + 1):
        state = (state >> np.uint32(8)) ^ _CRC[state & np.uint32(255)]
        here = order[cuts[n]:cuts[n + 1]]
        out[here] = state[of[here]] ^ crcs[code[here]]
    for i in order[cuts[_SHORT + 1]:].tolist():
        out[i] = zlib.crc32(distinct[code[i]], zlib.crc32(prefixes[of[i]]))
    return out


def _counted(least_size: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter(_HELD)

        def out() -> pa.RecordBatch:
            table = total.drain()
            return pa.RecordBatch.from_arrays([table["key"].combine_chunks().cast(pa.string()), table["n"].combine_chunks()], names=["word", "n"])

        for batch in batches:
            prefixes = [f"{'' if i is None else i}:".encode() for i in batch.column(0).to_pylist()]
            for part in runs(batch.column(1), letter_bytes):
                if not len(part.code):
                    continue
                first, last = int(part.text[0]), int(part.text[-1])
                names = part.distinct.to_pylist()
                h = _hashes(prefixes[first:last + 1], part.text - first, part.code, part.size, names)
                hit = np.flatnonzero(h % np.uint32(every) == 0)
                n = np.bincount(part.code, minlength=len(names)) - np.bincount(part.code[hit], minlength=len(names))
                points = np.fromiter((len(w) - w.count(b"\xc3") for w in names), np.int64, len(names))
                keep = (points >= least_size) & (n > 0)
                total.add(part.distinct.filter(pa.array(keep)), n[keep])
                cut = []
                for i in hit.tolist():
                    word = names[part.code[i]].decode()
                    at = int(h[i]) % len(word)
                    if len(word) > least_size:
                        cut.append((word[:at] + word[at + 1:]).encode())
                if cut:
                    total.add(pa.array(cut, pa.large_binary()), np.ones(len(cut), dtype=np.int64))
            if total.full:
                yield out()
        yield out()
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_size: int = LEAST_SIZE, every: int = EVERY) -> DataFrame:
    """(word, n) of all words of ``least_size`` code points; tasks add up what they have read before the shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counted(least_size, every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dealt(vocabulary: DataFrame, anchor: int = ANCHOR, letters: int = LETTERS) -> DataFrame:
    """(pool, asks, holds, forward, role, word, n): what each index holds (role 2), who asks it (1), or both (3)."""
    ends = F.explode(F.array(
        F.struct(F.lit(True).alias("forward"), F.substring("word", -anchor, anchor).alias("key")),
        F.struct(F.lit(False).alias("forward"), F.substring("word", 1, anchor).alias("key"))))
    rows = vocabulary.select("word", "n", ends.alias("e")).select("word", "n", "e.forward", "e.key")
    sizes = written(rows.groupBy("forward", "key").agg(F.sum(F.length("word") + 1).alias("letters")), "spelling-keys")
    pools = max(1, -(-2 * (sizes.agg(F.sum("letters")).first()[0] or 0) // letters))
    blocks = F.ceil(F.col("letters") / F.lit(letters)).cast("int")
    plan = sizes.select("forward", "key", blocks.alias("blocks"), F.when(blocks > 1, F.concat(F.lit("="), F.col("key"))).otherwise(
        F.pmod(F.xxhash64("key"), F.lit(pools)).cast("string")).alias("pool"))
    placed = rows.join(small(plan), ["forward", "key"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    task = lambda a, h, role: F.struct(a.cast("int").alias("asks"), h.cast("int").alias("holds"), F.lit(role).alias("role"))
    own, others = F.col("own"), F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))
    tasks = F.when(F.col("blocks") == 1, F.array(task(own, own, 3))).otherwise(F.concat(
        F.array(task(own, own, 3)), F.transform(others, lambda b: task(own, b, 1)), F.transform(others, lambda b: task(b, own, 2))))
    return placed.select("pool", "forward", "word", "n", F.explode(tasks).alias("t")).select("pool", "t.asks", "t.holds", "forward", "t.role", "word", "n")


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words end to end, and their number in each."""
    names = words.to_pylist()
    return np.frombuffer("".join(names).encode("utf-32-le"), "<u4").astype(np.int64), np.fromiter(map(len, names), np.int64, len(names))


def _taken(letters: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words numbered ``rows``, end to end."""
    starts, size = (np.cumsum(sizes) - sizes)[rows], sizes[rows]
    spots = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    return letters[spots], size


def _begin_alike(letters: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Whether words ``a`` and ``b`` agree in their first ``upto`` letters."""
    starts = np.cumsum(sizes) - sizes
    alike = sizes[b] >= upto
    for at in range(int(upto.max(initial=0))):
        open_ = np.flatnonzero(alike & (upto > at))
        if not len(open_):
            break
        alike[open_] = letters[starts[a[open_]] + at] == letters[starts[b[open_]] + at]
    return alike


def _searched(table: pa.Table) -> pa.Table:
    """(word, n_near, near_n, near): for each word that asks, its near words in this index and the best of them."""
    names = table["word"].combine_chunks()
    letters, sizes = _letters(names)
    _, letters = np.unique(letters, return_inverse=True)  # dense, in code-point order
    letters = letters.astype(np.int64) + 1
    role, n = table["role"].to_numpy(), table["n"].to_numpy()
    order = pc.sort_indices(pc.cast(names, pa.binary())).to_numpy().astype(np.int64)  # UTF-8 bytes sort as code points do
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    forward = table["forward"][0].as_py()
    asking, held = np.flatnonzero(role & 1), order[(role[order] & 2) > 0]
    if forward:
        index = fmindex.Index(*_taken(letters, sizes, held), int(letters.max()))
        who, what = index.near(*_taken(letters, sizes, asking), sizes[asking] // 2)
    else:
        turned = fmindex.backwards(letters, sizes)
        held = held[_word_order(*_taken(turned, sizes, held))]
        index = fmindex.Index(*_taken(turned, sizes, held), int(letters.max()))
        who, what = index.near(*_taken(turned, sizes, asking), sizes[asking] - sizes[asking] // 2)
    who, what = asking[who], held[what]
    if forward:  # the other search finds what begins like the word
        alone = ~_begin_alike(letters, sizes, who, what, sizes[who] // 2)
        who, what = who[alone], what[alone]
    best = np.lexsort((rank[what], -n[what], who))
    who, what = who[best], what[best]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    many = np.diff(np.append(first, len(who)))
    return pa.table({"word": names.take(pa.array(who[first])), "n_near": pa.array(many, pa.int64()),
                     "near_n": pa.array(n[what[first]], pa.int64()), "near": names.take(pa.array(what[first]))})


def _word_order(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of words given by their letters."""
    points = letters.astype("<u4").tobytes()
    ends = np.cumsum(sizes)
    text = [points[4 * (e - s):4 * e].decode("utf-32-le", "surrogatepass") for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return np.array(sorted(range(len(text)), key=text.__getitem__), dtype=np.int64)


def near_words(vocabulary: DataFrame, least_size: int = LEAST_SIZE, letters: int = LETTERS) -> DataFrame:
    """(word, n_near, near_n, near) of the words of ``vocabulary`` (word, n) that have near words: how many, and the most
    frequent one, of equal ones the first. No word may be shorter than ``least_size``."""
    if least_size < 2:
        raise ValueError("words need two letters at least")
    found = dealt(vocabulary, least_size // 2, letters).groupBy("pool", "forward", "asks", "holds").applyInArrow(
        _searched, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that the forms (word, form) of a word lead to, by doubling the step every round."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(on, "root", "left_semi").limit(1).count() == 0:
            return now
        now = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_size: int = LEAST_SIZE, least_count: int = LEAST_COUNT,
             ratio: int = RATIO, every: int = EVERY, letters: int = LETTERS) -> DataFrame:
    """One row per word with at least ``least_size`` code points and ``least_count`` occurrences: word, form, root, n, n_near, form_n.

    The form of a word is its most frequent near word, if that occurs ``ratio`` times as often.
    """
    with narrow_batches(docs.sparkSession, _BATCH):
        vocabulary = written(word_counts(docs, id_col, text_col, least_size, every).where(F.col("n") >= least_count), "spelling-words")
    near = near_words(vocabulary, least_size, letters)
    able = F.col("near_n") >= F.lit(ratio) * F.col("n")
    rows = written(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(able, F.col("near")).alias("form"),
        F.when(able, F.col("near_n")).alias("form_n")), "spelling-forms")
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
