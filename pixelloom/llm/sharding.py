"""Sharding by extendible hashing.

A shard is a prefix of the bits of a document's hash. All documents start in the empty prefix; a bucket
over the byte limit splits on its next bit, and only it, until every shard fits. The directory is built
from byte sums per hash cell: cells are a little finer than the expected shards, and only cells that
are still too large are cut again from the rows. Texts are read once, for their length.

Defined cases: NULL text has 0 bytes; NULL id is an id of its own. Rows of equal id have equal hashes and
stay together; such a group, or one document, over the limit is a shard of its own with ``oversized``. An
empty table has no shards. Other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.store import small, written
from pixelloom.llm.text import digest_bits, fresh

BITS = 60
LIMIT = 1 << 20
SEED = "shard"


def prefix(h: Column | str, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def leaves(cells: DataFrame, top: int, deep: int, limit: int) -> DataFrame:
    """Cells of ``deep`` bits (cell, bytes, n) with the shard of each: the shortest prefix of at least ``top`` bits that fits.

    A cell that does not fit even at its full length has no shard (NULL depth).
    """
    steps = F.explode(F.sequence(F.lit(top), F.lit(deep))).alias("depth")
    each = cells.select("cell", "bytes", "n", steps).withColumn("p", F.expr(f"shiftright(cell, {deep} - depth)"))
    sums = each.groupBy("depth", "p").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = each.join(sums.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)), ["depth", "p"])
    best = fits.groupBy("cell").agg(F.min(F.struct("depth", "p", "shard_bytes", "shard_docs")).alias("s"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "s.*")


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", slack: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, doc_bytes, depth, shard (its bits), shard_bytes, shard_docs, oversized.

    ``slack`` is by how many bits cells are finer than shards of the limit would be on average.
    """
    rows = written(docs.select(
        F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("doc_bytes"),
        digest_bits(F.col(id_col), seed=SEED).alias("__h")), "shard-rows")
    total = rows.agg(F.sum("doc_bytes")).first()[0] or 0
    top, deep = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + slack)
    pending, done = rows, []
    while True:
        cells = pending.groupBy(prefix("__h", deep).alias("cell")).agg(F.sum("doc_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        found = written(leaves(cells, top, deep, limit), "shard-directory")
        placed = pending.withColumn("cell", prefix("__h", deep)).join(small(found), "cell")
        done.append(placed.where("depth is not null").drop("cell"))
        if deep == BITS or found.where("depth is null").limit(1).count() == 0:
            break
        pending = written(placed.where("depth is null").select(*rows.columns), "shard-pending")
        top, deep = deep + 1, min(BITS, deep + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        id_col, "doc_bytes", F.col("depth").cast("long").alias("depth"),
        F.expr("lpad(bin(p), depth, '0')").alias("shard"), "shard_bytes", "shard_docs",
        (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write ``docs`` with all its columns as one folder per shard; returns the name of the folders' column.

    That is ``shard``, or with underscores before it if ``docs`` has such a column. Rows of equal id, NULL being an id,
    are in one shard. A task holds whole shards, each within the limit unless a single id is over it.
    """
    name, known = fresh(docs, "shard", "__known")
    placed = shard(docs, limit, id_col, text_col).select(F.col(id_col).alias(known), F.concat(F.lit("s"), "shard").alias(name)).distinct()
    (docs.join(placed, docs[id_col].eqNullSafe(placed[known])).drop(known).repartition(name).write.partitionBy(name).parquet(path))
    return name
