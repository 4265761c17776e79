"""Exact shingle containment of short items in documents, the last step of two searches.

Rows of the documents are known by ``row_key``: the id and 64 bits of id and text. Repeated rows have
one key, so they share one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.store import small


def row_key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("h"))


def contained(texts: DataFrame, pairs: DataFrame, item_shingles: DataFrame, shingles: Column, least: float) -> DataFrame:
    """The candidate ``pairs`` (key, item) whose item has at least ``least`` of its shingles in the text.

    ``texts`` has (key, id, text); ``item_shingles`` (item, shingle, n_shingles) has one row per distinct
    shingle. ``shingles`` gives the distinct shingles of ``text``. Only texts of candidates are cut up.
    Returns key, id, item, n_shingles, n_shared. The count is of strings, so hashes decide nothing here.
    """
    chosen = texts.join(small(pairs.select("key").distinct()), "key", "left_semi")
    pieces = chosen.dropDuplicates(["key"]).select("key", "id", F.explode(shingles).alias("shingle"))
    met = pieces.join(small(item_shingles, 100_000), "shingle").groupBy("key", "item").agg(
        F.first("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n_shared"))
    enough = met.where(F.col("n_shared") >= F.lit(least) * F.col("n_shingles"))
    return enough.join(small(pairs.select("key", "item").distinct()), ["key", "item"], "left_semi")
