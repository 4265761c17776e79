"""Earth-observation inputs derived from the given tables by key arithmetic, as Spark plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.ordered import medians


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bands(df: DataFrame) -> DataFrame:
    """Band values from the surface class ``lc`` and a jitter ``j`` of 1..50."""
    def pick(*values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("lc") + 1)

    j = F.col("j")
    return (df.withColumn("blue", 500 + j)
              .withColumn("green", pick(1000, 600, 800, 800) + j)
              .withColumn("red", pick(300, 400, 900, 900) + j)
              .withColumn("nir", pick(200, 3000, 1000, 1500) + 2 * j)
              .withColumn("swir1", pick(100, 1500, 1400, 1450) + 3 * j)
              .withColumn("vv_db", pick(-23.0, -13.0, -3.0, -10.0) + (j - 25) / 10.0))


def observations(spark: SparkSession, sf: str, flooded: bool = False) -> DataFrame:
    """Scene stack of four areas of 16 x 16 pixels; every line item is one observation."""
    base = table(spark, sf, "lineitem").selectExpr(
        "cast(l_suppkey % 4 as int) aoi", "cast(l_orderkey % 16 as int) row",
        "cast((l_orderkey div 16) % 16 as int) col", "l_shipdate ts",
        "cast(year(l_shipdate) * 100 + month(l_shipdate) as int) scene_id",
        "cast(round(100 * (1 - 10 * l_discount)) as int) / 100D cs_cdf", "cast(l_quantity as int) j")
    base = base.withColumn("base", F.expr("cast((row div 4 + col div 4 + aoi) % 4 as int)"))
    lc = F.when((F.col("base") == 1) & (F.year("ts") >= 1996) & ((F.col("row") + F.col("col")) % 3 == 0), 2)
    if flooded:
        lc = lc.when((F.col("base") == 3) & (F.col("ts") >= "2001-07-01")
                     & ((F.col("row") + F.col("col")) % 3 == 0), 0)
    return _bands(base.withColumn("lc", lc.otherwise(F.col("base"))))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """Height and width of each area."""
    return observations(spark, sf).groupBy("aoi").agg(
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def cover_map(spark: SparkSession, sf: str) -> DataFrame:
    """A cover-map code per observed pixel; it depends on the largest jitter seen there."""
    pixels = observations(spark, sf).groupBy("aoi", "row", "col").agg(F.max("j").alias("m"), F.max("base").alias("base"))
    return pixels.withColumn("code", F.expr(
        "case base when 0 then if(m % 2 = 0, 80, 90) when 1 then if(m % 3 = 0, 10, 40) when 2 then 50 else if(m % 4 = 0, 70, 60) end"))


def wide_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Scene stack whose number of pixels grows with the orders: every order is one pixel.

    Images are 64 pixels wide. ``late`` tells the second date from the first.
    """
    base = table(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey % 4 as int) pair_id", "cast(l_orderkey div 256 as int) row",
        "cast((l_orderkey div 4) % 64 as int) col", "l_shipdate ts",
        "year(l_shipdate) >= 1998 late", "cast(l_quantity as int) j")
    base = base.withColumn("base", F.expr("cast((row div 4 + col div 4 + pair_id) % 4 as int)"))
    # Pair 2 darkens its plants on the second date, as in a dry season.
    lc = F.when((F.col("base") == 1) & F.col("late") & ((F.col("row") + F.col("col")) % 3 == 0), 2)
    lc = lc.when((F.col("base") == 3) & F.col("late") & ((F.col("row") * 2 + F.col("col")) % 5 == 0), 1)
    df = _bands(base.withColumn("lc", lc.otherwise(F.col("base"))))
    dry = (F.col("pair_id") == 2) & F.col("late") & (F.col("lc") == 1)
    return df.withColumn("nir", F.when(dry, F.expr("nir div 2").cast("int")).otherwise(F.col("nir")))


#: Keys of a pixel. A sort compares the first key first, so the one with the most values leads.
PIXEL = ("row", "col", "pair_id")
BANDS = ("blue", "green", "red", "nir", "swir1")


def dated_pixels(spark: SparkSession, sf: str, late: bool) -> DataFrame:
    """One date of each pair: median bands per pixel. Pair 3 has no SWIR band on the second date."""
    df = medians(wide_observations(spark, sf).where(F.col("late") == late), PIXEL, BANDS).select("pair_id", "row", "col", *BANDS)
    return df.withColumn("swir1", F.when(F.col("pair_id") != 3, F.col("swir1"))) if late else df


def pixels_of_dates(spark: SparkSession, sf: str) -> DataFrame:
    """``dated_pixels`` of both dates in one pass, told by ``late``; both dates of a pixel are in one partition."""
    df = medians(wide_observations(spark, sf).where("late is not null"), [*PIXEL, "late"], BANDS, near=PIXEL)
    return df.select("pair_id", "row", "col", "late", *BANDS).withColumn(
        "swir1", F.when((F.col("pair_id") != 3) | ~F.col("late"), F.col("swir1")))


def one_date(pixels: DataFrame, late: bool) -> DataFrame:
    """One date of ``pixels_of_dates``."""
    return pixels.where(F.col("late") == late).drop("late")


def radar_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Radar image of each pair. Odd pairs hold linear power, pair 2 has only HH; speckle moves some pixels."""
    df = wide_observations(spark, sf).groupBy("pair_id", "row", "col").agg(F.median("vv_db").alias("db"))
    off = F.when((F.col("row") * 7 + F.col("col") * 3) % 11 == 0, F.lit(9.0)).when(
        (F.col("row") * 5 + F.col("col")) % 13 == 0, F.lit(-9.0)).otherwise(0.0)
    value = F.col("db") + off
    value = F.when(F.col("pair_id") % 2 == 1, F.pow(F.lit(10.0), value / 10.0)).otherwise(value)
    return df.select("pair_id", "row", "col",
                     F.when(F.col("pair_id") != 2, value).alias("vv"),
                     F.when(F.col("pair_id") == 2, value).alias("hh"))


def pair_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Band roles and grid of each pair, one row per pair found in the orders."""
    # The maximum keeps conditions on the roles, which depend on the pair alone, from being worked out for every order.
    ids = table(spark, sf, "orders").selectExpr("cast(o_orderkey % 4 as int) id").groupBy("id").agg(F.max("id").alias("pair_id"))
    optical = ["blue", "green", "red", "nir"]
    full = F.array(*[F.lit(r) for r in optical + ["swir1"]])
    short = F.array(*[F.lit(r) for r in optical])
    return ids.select(
        "pair_id", full.alias("roles_before"),
        F.when(F.col("pair_id") == 3, short).otherwise(full).alias("roles_after"),
        F.when(F.col("pair_id") == 3, short).otherwise(full).alias("roles_optical"),
        F.when(F.col("pair_id") == 2, F.array(F.lit("hh"))).otherwise(F.array(F.lit("vv"))).alias("roles_radar"),
        F.lit("2019-02-15").alias("date_before"), F.lit("2025-02-15").alias("date_after"),
        F.when(F.col("pair_id") == 1, "degrees").when(F.col("pair_id") == 2, "pixels").otherwise("metres").alias("units"),
        F.when(F.col("pair_id") == 1, 0.0001).otherwise(10.0).alias("a"),
        F.when(F.col("pair_id") == 1, -0.0001).otherwise(-10.0).alias("e"),
        F.when(F.col("pair_id") == 1, 12.9).otherwise(1440000.0).alias("f"))
