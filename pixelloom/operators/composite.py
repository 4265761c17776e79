"""Scene selection, cloud masking and per-pixel median composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


PIXEL = ("aoi", "row", "col")
CLEAR_MIN = 0.6  # fixed value: cloud score from which a pixel counts as clear


def in_period(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows of ``[start, end)``. On the raw timestamp column, so the filter reaches the scan."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def touching(scenes: DataFrame, aois: DataFrame, cell: float = 1.0) -> DataFrame:
    """Scene/area pairs whose boxes overlap (touching edges do not count).

    Both sides carry ``box STRUCT<w, s, e, n>``. Boxes are cut into ``cell``-degree cells, the cells
    are the join key, and a pair is kept only in the cell of its lower left common corner, so no
    de-duplication is needed afterwards.
    """
    def cells(df, prefix):
        box = F.col(f"{prefix}_box")
        return (df.withColumn("__x", F.explode(F.sequence(F.floor(box.w / cell), F.floor(box.e / cell))))
                  .withColumn("__y", F.explode(F.sequence(F.floor(box.s / cell), F.floor(box.n / cell)))))

    a = cells(scenes.withColumnRenamed("box", "scene_box"), "scene")
    b = cells(aois.withColumnRenamed("box", "aoi_box"), "aoi")
    w = F.greatest(F.col("scene_box.w"), F.col("aoi_box.w"))
    s = F.greatest(F.col("scene_box.s"), F.col("aoi_box.s"))
    e = F.least(F.col("scene_box.e"), F.col("aoi_box.e"))
    n = F.least(F.col("scene_box.n"), F.col("aoi_box.n"))
    return (a.join(b, ["__x", "__y"])
             .where((w < e) & (s < n) & (F.floor(w / cell) == F.col("__x")) & (F.floor(s / cell) == F.col("__y")))
             .drop("__x", "__y"))


def with_cloud_scene(scenes: DataFrame, cloud_scenes: DataFrame, keys: Sequence[str] = ("aoi", "scene_id")) -> DataFrame:
    """Scenes that already have a cloud-score scene."""
    return scenes.join(cloud_scenes.select(*keys), list(keys), "left_semi")


def clear_observations(obs: DataFrame, cloud: DataFrame, keys: Sequence[str] = ("aoi", "scene_id", "row", "col"),
                       clear_min: float = CLEAR_MIN) -> DataFrame:
    """Observations whose cloud score for the same scene and pixel is at least ``clear_min``.

    The score filter runs on the cloud side before the join, so cloudy pixels are never shuffled
    there, and the inner join drops scenes without a cloud-score scene as well.
    """
    clear = cloud.where(F.col("cs_cdf") >= clear_min).select(*keys)
    return obs.join(clear, list(keys), "left_semi")


def mask_cloudy(obs: DataFrame, clear_min: float = CLEAR_MIN) -> DataFrame:
    """Clear observations of a table that already carries its cloud score."""
    return obs.where(F.col("cs_cdf") >= clear_min)


def radar_scenes(scenes: DataFrame, mode: str = "IW", polarisations: Sequence[str] = ("VV", "VH")) -> DataFrame:
    keep: Column = F.col("instrument_mode") == mode
    for p in polarisations:
        keep = keep & F.array_contains("polarisations", p)
    return scenes.where(keep)


def cloudiness_below(scenes: DataFrame, limit: float = 10.0) -> DataFrame:
    return scenes.where(F.col("cloudy_pct") < limit)


def median_composite(obs: DataFrame, bands: Sequence[str], keys: Sequence[str] = PIXEL) -> DataFrame:
    """Median of each band per pixel, in one pass; a pixel without any value in a band is NULL there.

    ``median`` keeps one count per distinct value of a pixel and is merged from partial maps, so its state is
    bounded by the number of scenes that show the pixel, however the rows are spread.
    """
    return obs.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands])


def as_stored(composite: DataFrame, bands: Sequence[str], kind: str = "uint16") -> DataFrame:
    """Composite as it is exported: half-even whole numbers for optical, float for radar."""
    for b in bands:
        value = F.col(b)
        composite = composite.withColumn(
            b, value.cast("float") if kind == "float32"
            else F.when(value.isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(value, F.lit(65535.0))), 0).cast("int")))
    return composite


def scene_counts(obs: DataFrame, keys: Sequence[str] = ("aoi",)) -> DataFrame:
    """Number of scenes per area. The pairs are made distinct on the map side before they are counted."""
    return obs.select(*keys, "scene_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("scenes"))


def lookback(obs: DataFrame, today: str, on_empty: str = "year") -> DataFrame:
    """Per area, the observations of the last 90 days of the last 365, or of the year if there are none.

    ``on_empty`` is "year" (fall back to the year) or "reject" (drop the area). ``today`` is an
    argument, so a job that is run again gives the same rows.
    """
    day = F.to_date(F.lit(today))
    year = in_period(obs, F.date_sub(day, 365), day)
    recent_from = F.date_sub(day, 90)
    if on_empty == "reject":
        return year.where(F.col("ts") >= recent_from).withColumn("period", F.lit("90 days"))
    has_recent = year.groupBy("aoi").agg(F.max("ts").alias("__last"))
    tagged = year.join(has_recent, "aoi").withColumn(
        "period", F.when(F.col("__last") >= recent_from, "90 days").otherwise("365 days"))
    return tagged.where((F.col("ts") >= recent_from) | (F.col("period") == "365 days")).drop("__last")
