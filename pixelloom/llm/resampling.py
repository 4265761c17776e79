"""Importance resampling of documents towards a target by hashed n-gram features.

A feature is a run of one to ``longest`` consecutive words, hashed by CRC-32 into ``buckets``. Few words make
up most of a text, so there is a head and a tail. The head holds the most frequent words with the states that
CRC-32 has after them, and, where pairs are asked for, the most frequent pairs with their buckets; it is bounded
and goes to all tasks. A word of the head costs one look-up; a pair of it the same, or goes on from the state of
its first word; what the head does not know takes CRC-32 of its bytes. The head only saves work: totals are exact
whatever it holds, and cover all documents.

From bucket totals of the documents and of the target follows a gain per bucket; a document's weight is the
floored mean of its features' gains. Gumbel noise from a hash of the id makes the largest scores a draw without
replacement in proportion to exp(weight / 1000).

Defined cases: NULL and empty texts have no features and weight 0; a NULL id counts as the empty text in the
noise and comes last in ties; rows of equal id have equal noise, and of equal rows any comes first; an empty
table gives no rows, an empty target has totals 0. Words of any length count whole. Other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.runs import Counter, runs
from pixelloom.llm.store import narrow_batches, positions, written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Words and pairs of the head, bytes of a word in it, and how many times as many candidates a task keeps.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES, SPARE = 1 << 14, 1 << 16, 64, 8
_BATCH = 8 << 20


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Digits, Latin letters and everything beyond ASCII; upper case counts as it is lower-cased afterwards."""
    return _MEMBER[data]


_MEMBER = np.zeros(256, dtype=bool)
_MEMBER[0x30:0x3A] = _MEMBER[0x41:0x5B] = _MEMBER[0x61:0x7B] = _MEMBER[0x80:] = True


@dataclass(frozen=True)
class Head:
    """Frequent words in byte order with their CRC-32 states, and frequent pairs of them with their CRC-32."""

    words: pa.Array
    states: np.ndarray
    pairs: np.ndarray
    pair_crcs: np.ndarray

    @staticmethod
    def of(words: list[bytes], pairs: list[tuple[bytes, bytes]] = ()) -> Head:
        words = sorted(words)
        spot = {w: i for i, w in enumerate(words)}
        keys = sorted((spot[a] << 32 | spot[b], zlib.crc32(a + b" " + b)) for a, b in pairs)
        return Head(pa.array(words, pa.large_binary()), np.array([zlib.crc32(w) for w in words], dtype=np.uint32),
                    np.array([k for k, _ in keys], dtype=np.int64), np.array([c for _, c in keys], dtype=np.uint32))

    def spots(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the head, -1 outside it."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def crcs(self, words: pa.Array, spots: np.ndarray) -> np.ndarray:
        """CRC-32 of distinct words: looked up, or worked out for the tail."""
        out = np.empty(len(words), dtype=np.uint32)
        known = spots >= 0
        out[known] = self.states[spots[known]]
        out[~known] = [zlib.crc32(w) for w in words.filter(pa.array(~known)).to_pylist()]
        return out

    def pair_crc(self, words: pa.Array, spots: np.ndarray, crcs: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """CRC-32 of distinct pairs of ``words``, named by number."""
        out = np.empty(len(first), dtype=np.uint32)
        key = np.where((spots[first] >= 0) & (spots[second] >= 0), spots[first] << 32 | spots[second], -1)
        at = np.searchsorted(self.pairs, key)
        known = (at < len(self.pairs)) & (key >= 0)
        known[known] = self.pairs[at[known]] == key[known]
        out[known] = self.pair_crcs[at[known]]
        rest = np.flatnonzero(~known)
        tails = words.take(pa.array(second[rest])).to_pylist()
        out[rest] = [zlib.crc32(b" " + w, int(s)) for w, s in zip(tails, crcs[first[rest]], strict=True)]
        return out


def _word_counts(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter(most)
        for batch in batches:
            for part in runs(batch.column(0), word_bytes):
                short = pc.less_equal(pc.binary_length(part.distinct), HEAD_BYTES)
                n = np.bincount(part.code, minlength=len(part.distinct))
                total.add(part.distinct.filter(short), n[short.to_numpy(zero_copy_only=False)])
                if total.full:
                    total.largest(most)
        total.largest(most)
        table = total.drain()
        yield pa.RecordBatch.from_arrays([table["key"].combine_chunks().cast(pa.binary()), table["n"].combine_chunks()], names=["key", "n"])
    return run


def _pair_counts(head: Head, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter(most)
        for batch in batches:
            for part in runs(batch.column(0), word_bytes):
                spots = head.spots(part.distinct)[part.code]
                both = (part.text[1:] == part.text[:-1]) & (spots[1:] >= 0) & (spots[:-1] >= 0)
                keys, n = np.unique((spots[:-1] << 32 | spots[1:])[both], return_counts=True)
                total.add(pa.array([k.tobytes() for k in keys], pa.large_binary()), n)
                if total.full:
                    total.largest(most)
        total.largest(most)
        table = total.drain()
        yield pa.RecordBatch.from_arrays([table["key"].combine_chunks().cast(pa.binary()), table["n"].combine_chunks()], names=["key", "n"])
    return run


def _frequent(texts: DataFrame, counted, most: int) -> list[bytes]:
    """The ``most`` keys of largest count among the tasks' candidates."""
    rows = texts.mapInArrow(counted, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return [bytes(r["key"]) for r in rows.orderBy(F.desc("n"), "key").limit(most).collect()]


def head_of(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """The head of a table: at most ``words`` words and ``pairs`` pairs reach the driver.

    Each task keeps ``SPARE`` times as many candidates with their counts, so memory is bounded; a word it
    drops too early is a word of the tail, which costs time and changes no result.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    with narrow_batches(docs.sparkSession, _BATCH):
        head = Head.of(_frequent(texts, _word_counts(SPARE * words), words))
        if longest == 1 or not pairs:
            return head
        names = head.words.to_pylist()
        found = [int(np.frombuffer(k, np.int64)[0]) for k in _frequent(texts, _pair_counts(head, SPARE * pairs), pairs)]
    return Head.of(names, [(names[k >> 32], names[k & 0xFFFFFFFF]) for k in found])


def _features(texts: pa.Array, head: Head, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text, CRC-32, words in the feature) of all features, slice by slice."""
    open_text, open_word = -1, b""
    for part in runs(texts, word_bytes):
        if not len(part.code):
            continue
        spots = head.spots(part.distinct)
        crcs = head.crcs(part.distinct, spots)
        yield part.text, crcs[part.code], 1
        if longest > 1:
            if part.text[0] == open_text:  # a pair over the border of two slices of one text
                word = part.distinct[int(part.code[0])].as_py()
                yield part.text[:1], np.array([zlib.crc32(open_word + b" " + word)], dtype=np.uint32), 2
            here = np.flatnonzero(part.text[1:] == part.text[:-1])
            many = len(part.distinct)
            pairs, at = np.unique(part.code[here] * many + part.code[here + 1], return_inverse=True)
            yield part.text[here], head.pair_crc(part.distinct, spots, crcs, pairs // many, pairs % many)[at], 2
            open_text, open_word = int(part.text[-1]), part.distinct[int(part.code[-1])].as_py()


def _bucketed(head: Head, longest: int, buckets: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, values, words = [np.zeros(0, np.int64)], [np.zeros(0, dtype)], np.zeros(batch.num_rows, dtype=np.int64)
            for text, crc, size in _features(batch.column(1), head, longest):
                texts.append(text)
                values.append((crc % np.uint32(buckets)).astype(dtype))
                if size == 1:
                    words += np.bincount(text, minlength=batch.num_rows)
            text, value = np.concatenate(texts), np.concatenate(values)
            if longest > 1:
                value = value[np.argsort(text, kind="stable")]
            n = np.bincount(text, minlength=batch.num_rows)
            cuts = np.concatenate([[0], np.cumsum(n)]) * np.dtype(dtype).itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(value)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n.astype(np.int64)), packed.cast(pa.binary())],
                                             names=["id", "n_words", "n_features", "buckets"])
    return run


def _dtype(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _unpacked(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows end to end, and where each row's begin and end."""
    wide = column.cast(pa.large_binary())
    _, marks, raw = wide.buffers()
    cuts = np.frombuffer(marks, np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[cuts[0]:cuts[-1]].view(dtype), (cuts - cuts[0]) // np.dtype(dtype).itemsize


def bucketed(docs: DataFrame, head: Head, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets): the bucket of every feature of a text, packed, written to the shared folder."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    with narrow_batches(docs.sparkSession, _BATCH):
        return written(rows.mapInArrow(_bucketed(head, longest, buckets, _dtype(buckets)),
                                       f"id {kind}, n_words bigint, n_features bigint, buckets binary"), "feature-buckets", "zstd")


def bucket_totals(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket of a ``bucketed`` table; at most ``buckets`` rows reach the driver."""
    dtype = _dtype(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_unpacked(batch.column(0), dtype)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in table.select("buckets").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the source."""
    many = len(source)
    all_source, all_target = float(source.sum()) + many, float(target.sum()) + many
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
                    dtype=np.int64)


def _weighed(gain: np.ndarray, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found, cuts = _unpacked(batch.column(3), dtype)
            sums = np.concatenate([[0], np.cumsum(gain[found])])[cuts]
            weight = (sums[1:] - sums[:-1]) // np.maximum(1, np.diff(cuts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weight)],
                                             names=["id", "n_words", "n_features", "weight"])
    return run


def weighed(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of a ``bucketed`` table."""
    kind = table.schema["id"].dataType.simpleString()
    return table.mapInArrow(_weighed(gain, _dtype(len(gain))), f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, head: Head | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank (NULL where not drawn).

    Drawn are floor(``percent`` * N / 100) of the N rows with ``least_words`` words at least. Texts are read once for the
    head and once for the buckets. Scores are whole numbers, so their counts give the score at which the draw
    ends, and only the rows from there on are put in order, by range.
    """
    if longest not in (1, 2):
        raise ValueError("features are words, or words and pairs")
    head = head or head_of(docs, text_col, longest)
    table = bucketed(docs, head, id_col, text_col, longest, buckets)
    aim = bucketed(target.select(F.lit(0).alias("__id"), F.col(target_text)), head, "__id", target_text, longest, buckets)
    rows = weighed(table, gains(bucket_totals(table, buckets), bucket_totals(aim, buckets)))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    scored = written(rows.withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))  # one row a score: whole numbers of a bounded range
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = counts.select("score", F.sum("n").over(upto).alias("upto"))
    many = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    last = ahead.where(F.col("upto") >= many).agg(F.max("score")).first()[0] if many else None
    if last is None:
        return _named(scored.withColumn("rank", F.lit(None).cast("long")), id_col)
    front = positions(scored.where(able & (F.col("score") >= last)), [F.desc("score"), F.col("id").asc_nulls_last()], "place")
    ranked = front.select(*scored.columns, F.when(F.col("place") < many, F.col("place") + 1).alias("rank"))
    rest = scored.where(~(able & (F.col("score") >= last))).withColumn("rank", F.lit(None).cast("long"))
    return _named(ranked.unionByName(rest), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
