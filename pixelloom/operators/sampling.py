"""Group-capped sampling of row blocks, and statistics over a sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.ordered import magnitude_bin, running_totals


def row_blocks(rows: DataFrame, country: str, size: str, block_rows: int = 100) -> DataFrame:
    """One row per (file, block of rows): rows, bytes and the country, or "mixed".

    ``rows`` must come straight from a file scan, as file and row number are its ``_metadata``.
    """
    return (rows.select(F.col("_metadata.file_path").alias("file"),
                        F.floor(F.col("_metadata.row_index") / block_rows).cast("long").alias("row_group"),
                        F.col(country).alias("__country"), F.expr(size).alias("__bytes"))
            .groupBy("file", "row_group")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("__bytes").alias("bytes"),
                 F.when(F.min("__country") == F.max("__country"), F.min("__country")).otherwise("mixed").alias("country")))


def group_quotas(blocks: DataFrame, target_rows: int, max_share: float) -> DataFrame:
    """Rows to take per country: proportional, at most ``max_share`` of the target, what the cap removes going
    to the other countries in proportion.

    Handing the spare rows out again and again ends at ``min(cap, factor * rows)``. With the countries from
    largest to smallest, a country is capped if, with all larger ones capped, its share would still
    reach the cap. So the number of capped countries, and with it the factor, come from running totals.
    """
    cap = max_share * target_rows
    totals = blocks.groupBy("country").agg(F.sum("rows").alias("w")).withColumns(
        {"__bin": -magnitude_bin(F.col("w")), "__one": F.lit(1)})
    placed = running_totals(totals, [], "__bin", [F.desc("w"), F.col("country")], {"k": "__one", "upto": "w"})
    tested = placed.withColumn("__w", totals.agg(F.sum("w")).scalar()).withColumn("capped", F.expr(
        f"w * try_divide({target_rows}D - (k - 1) * {cap!r}D, __w - (upto - w)) >= {cap!r}D"))
    factor = tested.agg(F.expr(
        f"try_divide(greatest(0D, {target_rows}D - count_if(capped) * {cap!r}D), max(__w) - sum(if(capped, w, 0)))")).scalar()
    return tested.select("country", "w", "capped", factor.alias("factor")).selectExpr(
        "country", "w rows", f"if(capped, {cap!r}D, least({cap!r}D, w * factor)) quota")


def capped_sample(blocks: DataFrame, target_rows: int, max_share: float, seed: int = 0) -> DataFrame:
    """Blocks of ``(file, row_group, rows, bytes, country)`` picked so that no country exceeds its quota by more
    than its last block.

    Within a country blocks come in the order of a digest of file, block and seed, and are taken while the
    rows taken before are below the quota. The running total goes by leading digits of the digest, so
    a country with a third of all blocks is spread over 4,096 pieces.
    """
    mixed = blocks.withColumn("__digest", F.md5(F.concat_ws("|", "file", F.col("row_group").cast("string"), F.lit(str(seed))))
                              ).withColumn("__bucket", F.substring("__digest", 1, 3))
    taken = running_totals(mixed, ["country"], "__bucket", [F.col("__digest"), F.col("file"), F.col("row_group")],
                           {"__upto": "rows"})
    quotas = group_quotas(blocks, target_rows, max_share).select("country", "quota")
    return taken.join(quotas, "country").where(F.col("__upto") - F.col("rows") < F.col("quota")).select(*blocks.columns)


def sample_summary(sample: DataFrame) -> DataFrame:
    """Rows, bytes, blocks and shards per country of a sample."""
    per_file = sample.groupBy("country", "file").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
                                                     F.count(F.lit(1)).alias("blocks"))
    return per_file.groupBy("country").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
                                           F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("shards"))


def sample_patches(patch_ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` patches by smallest digest; the number is the feature."""
    return patch_ids.withColumn("__digest", F.md5(F.concat_ws("|", F.col("image_id").cast("string"), F.lit(str(seed))))
                                ).orderBy("__digest").limit(n).drop("__digest")


def band_stats(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per band."""
    out = []
    for b in bands:
        out += [F.avg(b).alias(f"mean_{b}"), F.stddev_pop(b).alias(f"std_{b}")]
    return pixels.agg(*out)
