"""Benchmark decontamination: which test items are contained in which documents.

A short item inside a long document has a tiny Jaccard similarity, so equal-length sketches of both
sides would miss it. Here items are partitioned by size. In the partition of items with up to u
shingles, the MinHash sketch of an item is its floor((1 - t) * u) + 1 shingles of least hash. A document
that holds the fraction t of the item misses at most (1 - t) * u shingles, so at least one sketch value
is among the document's own hashes: every pair over the threshold is found, however long the document.
Candidates are then verified by exact shingle containment.

An item of fewer words than a shingle is one shingle of its own length, which is looked for among the windows
of that length in the documents; only lengths that occur are asked for.

Defined cases: a NULL or empty text or item matches nothing. Equal items are all
reported. Items are known by id and text (``row_key``): a NULL id is an id, and different texts under one
id are items of their own. Repeated document rows share one result row. Other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.containment import contained, row_key
from pixelloom.llm.store import small, written
from pixelloom.llm.text import SHINGLE, fresh, let, window_hashes, window_strings, words

THRESHOLD = 0.75


def sketch_length(n: Column, threshold: float) -> Column:
    """Sketch values of an item of ``n`` shingles: enough for the largest item of its size partition [2^p, 2^(p+1))."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1
    return (upper - F.ceil(F.lit(threshold) * upper - F.lit(1e-9)) + 1).cast("int")


def _of_own_length(text: Column, k: int, windows) -> Column:
    """The distinct windows of an item: of ``k`` words, or the whole sequence of fewer."""
    def cut(word: Column) -> Column:
        found = windows(word, k)
        for n in range(1, k):
            found = F.when(F.size(word) == n, windows(word, n)).otherwise(found)
        return F.array_distinct(found)
    return let(words(F.lower(text)), cut)


def _of_lengths(text: Column, lengths: list[int], windows) -> Column:
    """All windows of a text of the given numbers of words."""
    return let(words(F.lower(text)), lambda word: F.concat(*[windows(word, n) for n in lengths]))


def window_lengths(items: DataFrame, k: int = SHINGLE, text_col: str = "text") -> list[int]:
    """The window lengths that items ask for: at most ``k`` values."""
    found = items.select(F.least(F.size(words(F.col(text_col))), F.lit(k)).alias("n")).distinct().collect()
    return sorted(r["n"] for r in found if r["n"]) or [k]


def item_sketches(items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE,
                  id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, partition, h): the sketch of every item; ``item`` is its row key."""
    hashed = (items.select(row_key(id_col, text_col).alias("item"), F.array_sort(_of_own_length(F.col(text_col), k, window_hashes)).alias("hs"))
              .where(F.size("hs") > 0))
    return hashed.select(
        "item", F.floor(F.log2(F.size("hs"))).cast("int").alias("partition"),
        F.explode(F.slice("hs", F.lit(1), sketch_length(F.size("hs"), threshold))).alias("h"))


def candidates(docs: DataFrame, sketches: DataFrame, lengths: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, item) of the rows of ``docs`` that share a sketch value with an item."""
    hashes = docs.select(row_key(id_col, text_col).alias("key"), F.explode(_of_lengths(F.col(text_col), lengths, window_hashes)).alias("h"))
    return hashes.join(small(sketches.select("item", "h")), "h").select("key", "item").distinct()


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) with the item's containment of at least ``threshold``.

    Returns ``key``, the id column, the item column, n_item_shingles, n_shared, containment.
    """
    least, lengths = math.nextafter(threshold, 0), window_lengths(items, k, item_text)
    sketches = written(item_sketches(items, threshold, k, item_col, item_text), "item-sketches")
    pairs = written(candidates(docs, sketches, lengths, id_col, text_col), "item-candidates")
    known = items.select(row_key(item_col, item_text).alias("item"), F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    strings = known.select("item", _of_own_length(F.col("text"), k, window_strings).alias("s")).select(
        "item", F.explode("s").alias("shingle"), F.size("s").alias("n_shingles")).distinct()
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = contained(texts, pairs, strings, F.array_distinct(_of_lengths(F.col("text"), lengths, window_strings)), least).join(
        known.select("item", "item_id").dropDuplicates(["item"]), "item")
    return met.select(
        "key", F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.col("n_shingles").cast("long").alias("n_item_shingles"),
        "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that contain no item, with the columns of ``docs``."""
    key, = fresh(docs, "__key")
    found = written(contaminations(docs, items, id_col=id_col, text_col=text_col, **how)
                    .select(F.col("key").alias(key)).distinct(), "contaminated")
    return docs.withColumn(key, row_key(id_col, text_col)).join(small(found), key, "left_anti").drop(key)
