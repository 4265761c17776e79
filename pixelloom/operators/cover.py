"""Cover statistics per area: vegetation, water, potential flood and land-cover composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import indices as ix
from pixelloom.functions.semantics import holds, round_binary, share_percent
from pixelloom.operators.composite import PIXEL

WATER_CODE = 80  # fixed value: permanent water in the cover map


PIXEL_M2 = 100.0


def _inside(pixels: DataFrame, areas: DataFrame) -> DataFrame:
    """Pixels that lie in the grid of their area, given as ``(aoi, height, width)``."""
    return pixels.join(areas.select("aoi", "height", "width"), "aoi").where(
        "row >= 0 and row < height and col >= 0 and col < width").drop("height", "width")


def _with_total(areas: DataFrame, sums: DataFrame, pixel_m2: float) -> DataFrame:
    """``sums`` of every area, also of those without a pixel, with ``total_m2`` worked out from the size of the grid."""
    return areas.select("aoi", (F.col("height") * F.col("width") * F.lit(pixel_m2)).alias("total_m2")).join(sums, "aoi", "left")


def _index_cover(composite: DataFrame, areas: DataFrame, index: Column, above: float, name: str, pixel_m2: float) -> DataFrame:
    """Pixels go straight into partial sums per area; only the small tables of areas and sums are joined."""
    values = _inside(composite.select(*PIXEL, index.alias("__index")), areas)
    flagged = holds(F.col("__index") > above)
    sums = _with_total(areas, values.groupBy("aoi").agg(
        F.count("__index").alias("__pixels"), F.sum(F.when(flagged, pixel_m2).otherwise(0.0)).alias("__cover"),
        F.avg("__index").alias("__mean"), F.min("__index").alias("__min"), F.max("__index").alias("__max")), pixel_m2).withColumns({
            "pixels": F.coalesce("__pixels", F.lit(0)), "cover_m2": F.coalesce("__cover", F.lit(0.0))})
    area, unit, total = ix.area_display("cover_m2", "total_m2")
    zero = F.lit(0.0)
    return sums.select(
        "aoi", "pixels", "cover_m2", "total_m2", area.alias("area"), unit.alias("area_unit"),
        total.alias("total_aoi"), share_percent("cover_m2", "total_m2").alias("percentage_coverage"),
        *[round_binary(f"coalesce(__{s}, 0D)", 3).alias(f"{s}_{name}") for s in ("mean", "min", "max")],
        *[F.round(F.coalesce(F.col(f"__{s}"), zero), 6).alias(f"{s}_{name}_exact") for s in ("mean", "min", "max")])


def vegetation_cover(composite: DataFrame, areas: DataFrame, ndvi_min: float = 0.2, pixel_m2: float = PIXEL_M2) -> DataFrame:
    return _index_cover(composite, areas, ix.ndvi(F.col("nir"), F.col("red")), ndvi_min, "ndvi", pixel_m2)


def water_cover(composite: DataFrame, areas: DataFrame, ndwi_min: float = 0.0, pixel_m2: float = PIXEL_M2) -> DataFrame:
    return _index_cover(composite, areas, ix.ndwi(F.col("green"), F.col("nir")), ndwi_min, "ndwi", pixel_m2)


def flood_pixels(current: DataFrame, baseline: DataFrame, class_map: DataFrame) -> DataFrame:
    """Pixels with water now that had no water in the baseline and are not permanent water.

    A pixel missing on any side is left out. All three inputs share the pixel key, so one
    partitioning serves both joins.
    """
    now = current.select(*PIXEL, holds(ix.ndwi(F.col("green"), F.col("nir")) > 0).alias("__now"))
    was = baseline.select(*PIXEL, holds(ix.ndwi(F.col("green"), F.col("nir")) > 0).alias("__was"))
    fixed = class_map.select(*PIXEL, (F.col("code") == WATER_CODE).alias("__fixed"))
    return (now.join(was, list(PIXEL)).join(fixed, list(PIXEL))
               .select(*PIXEL, (F.col("__now") & ~(F.col("__was") | F.col("__fixed"))).alias("flood")))


def flood_potential(current: DataFrame, baseline: DataFrame, class_map: DataFrame, areas: DataFrame, pixel_m2: float = PIXEL_M2) -> DataFrame:
    flood = _inside(flood_pixels(current, baseline, class_map), areas)
    sums = _with_total(areas, flood.groupBy("aoi").agg(
        F.sum(F.when(holds(F.col("flood")), pixel_m2).otherwise(0.0)).alias("__flood")), pixel_m2).withColumn(
        "flood_m2", F.coalesce("__flood", F.lit(0.0)))
    area, unit, total = ix.area_display("flood_m2", "total_m2")
    return sums.select("aoi", "flood_m2", "total_m2", area.alias("area"), unit.alias("area_unit"),
                       total.alias("total_aoi"),
                       share_percent("flood_m2", "total_m2").alias("percentage_coverage"))


def landcover_composition(class_map: DataFrame, areas: DataFrame, classes: dict[int, str] | None = None,
                          pixel_m2: float = PIXEL_M2) -> DataFrame:
    """Share of each listed class of the area covered by the listed classes; absent classes show as 0."""
    classes = classes or ix.COVER_MAP_CLASSES
    sums = _inside(class_map.select(*PIXEL, "code"), areas).groupBy("aoi").agg(*[
        F.sum(F.when(F.col("code") == code, pixel_m2).otherwise(0.0)).alias(f"__{code}") for code in classes])
    total = None
    for code in classes:
        total = F.col(f"__{code}") if total is None else total + F.col(f"__{code}")
    built = next((c for c, label in classes.items() if label == "Built-up"), None)
    mostly_built = F.lit(False) if built is None else holds(share_percent(f"__{built}", "__total") > 50)
    return (sums.withColumn("__total", total).where(F.col("__total") > 0)
            .withColumn("mostly_built", mostly_built)
            .select("aoi", "mostly_built", F.explode(F.array(*[
                F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"),
                         F.col(f"__{code}").alias("class_m2"),
                         share_percent(f"__{code}", "__total").alias("percent"))
                for code, label in classes.items()])).alias("__c"))
            .select("aoi", "__c.code", "__c.label", "__c.class_m2", "__c.percent", "mostly_built"))


def layer_mask(index_pixels: DataFrame, index: str, above: float = 0.0) -> DataFrame:
    """Pixels shown in an index layer."""
    return index_pixels.where(F.col(index) > above)


def clip_to_polygon(pixels: DataFrame, edges: DataFrame, keys: Sequence[str] = ("aoi",), band: float = 8.0) -> DataFrame:
    """Pixels whose centre ``(x, y)`` lies inside the area's polygon (even-odd rule, holes work too).

    ``edges`` is ``(aoi, x1, y1, x2, y2)``. Only distinct (area, y) lines meet edges, and only edges in
    the same horizontal band of height ``band``. A pixel then counts the crossings to its right, so
    pixels are never multiplied by edges.
    """
    keys = list(keys)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.where(F.col("y1") != F.col("y2")).withColumn(
        "__band", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    lines = pixels.select(*keys, "y").distinct().withColumn("__band", F.floor(F.col("y") / band))
    crossing = (lines.join(banded, keys + ["__band"])
                .where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
                .select(*keys, "y", (F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1"))
                                     / (F.col("y2") - F.col("y1"))).alias("__cross"))
                .groupBy(*keys, "y").agg(F.collect_list("__cross").alias("__crosses")))
    right = F.size(F.filter("__crosses", lambda c: c > F.col("x")))
    return pixels.join(crossing, keys + ["y"]).where(right % 2 == 1).drop("__crosses")
