"""Queries on scene selection, display choices, shapes and menus."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import geodesy as geo
from pixelloom.functions import indices as ix
from pixelloom.operators import areas as ar
from pixelloom.operators import catalogue as cat
from pixelloom.operators import composite as cp
from pixelloom.operators import cover as cv
from pixelloom.operators import display as dp
from pixelloom.operators import evaluation as ev
from pixelloom.operators import fusion as fu
from pixelloom.operators import regrid as rg
from workload import derived as d
from workload import grids as gr
from workload import language as lg
from workload import quality as ql
from workload.catalogue_queries import catalogue


def scene_area_join(spark, sf):
    """Scenes (one per order) whose box overlaps an area's box (one area per nation)."""
    scenes = gr._boxes(spark, sf).select(F.col("box_id").alias("scene_id"), "box")
    aois = d.table(spark, sf, "nation").selectExpr(
        "n_nationkey aoi", "named_struct('w', n_nationkey * 13D - 170, 's', n_nationkey * 5D - 70, 'e', n_nationkey * 13D - 155.5D, 'n', n_nationkey * 5D - 57.25D) box")
    return cp.touching(scenes, aois).groupBy("aoi").agg(F.count(F.lit(1)).alias("scenes"), F.max("scene_id").alias("last_scene"))


def cloudy_scenes(spark, sf):
    scenes = d.table(spark, sf, "orders").selectExpr("o_orderstatus kind", "(o_custkey % 400) / 10D cloudy_pct")
    return cp.cloudiness_below(scenes).groupBy("kind").agg(F.count(F.lit(1)).alias("scenes"))


def ndvi_layer(spark, sf):
    """Pixels shown in the NDVI layer."""
    pixels = d.dated_pixels(spark, sf, False).withColumn("ndvi", ix.ndvi(F.col("nir"), F.col("red")))
    return cv.layer_mask(pixels, "ndvi").groupBy("pair_id").agg(F.count(F.lit(1)).alias("shown"))


def pair_confidence(spark, sf):
    stats = fu.map_water_builtup(d.dated_pixels(spark, sf, True), d.radar_pixels(spark, sf), d.pair_catalogue(spark, sf))
    return fu.mean_agreement(stats)


def unusable_pairs(spark, sf):
    pairs = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 5 = 0, 'PNG', 'GTiff') sar", "if(o_orderkey % 3 = 0, 'JPEG', 'GTiff') opt", "o_custkey % 4 <> 0 calibrated",
        "if(o_custkey % 2 = 0, null, 'NDWI (green, NIR)') water", "cast(null as string) built")
    reasons = fu.unusable_reasons(*[F.col(c) for c in ("sar", "opt", "calibrated", "water", "built")])
    return pairs.select("o_orderkey", F.concat_ws(",", reasons).alias("reasons"))


def display_choice(spark, sf):
    df = cat.resolve_bands(catalogue(spark, sf)).where("bands is not null")
    return df.withColumn("d", dp.display_bands(F.col("bands.kind"), F.col("bands.roles"))).select(
        "upload_id", "slot", F.concat_ws(",", F.col("d.bands").cast("array<string>")).alias("shown"), "d.rendering")


def metadata_answers(spark, sf):
    df = cat.resolve_bands(catalogue(spark, sf)).where("bands is not null").withColumn(
        "fields", F.array(*[F.lit(f) for f in ("crs", "size", "resolution", "bounds", "date", "dtype", "bands", "sensor")]))
    return cat.metadata_answer(df).select("upload_id", "slot", "line")


def ten_metre_shape(spark, sf):
    df = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "cast(100 + o_custkey % 300 as int) w", "cast(80 + o_custkey % 170 as int) h",
        "case o_orderkey % 3 when 0 then 'metres' when 1 then 'degrees' else 'pixels' end units",
        "if(o_orderkey % 3 = 1, 0.00007D, 5.8D) res", "(o_orderkey % 120) - 60D lat")
    return df.select("o_orderkey", geo.ten_metre_side("w", "res", "units", "lat", True).alias("width"),
                     geo.ten_metre_side("h", "res", "units", "lat", False).alias("height"))


def grid_area(spark, sf):
    """Area of each image on its downsampled grid, by the row for degrees."""
    pairs = d.pair_catalogue(spark, sf).select(F.col("pair_id").alias("image_id"), "units", "a", "e", "f")
    images = rg.grid_for(gr._images(spark, sf), 40).join(pairs, "image_id").selectExpr("*", "a / sx a2", "e / sy e2")
    rows = images.withColumn("row", F.explode(F.expr("sequence(0, out_height - 1)")))
    area = geo.pixel_area(F.col("units"), F.col("a2"), F.col("e2"), F.col("f"), F.col("row"))
    return rows.groupBy("image_id").agg(F.sum(area * F.col("out_width")).cast("float").cast("double").alias("area_m2"), F.count(F.lit(1)).alias("rows"))


def reflect_padded(spark, sf):
    return rg.reflect_pad(gr._image(spark, sf).select("image_id", "row", "col", "nir"), gr._images(spark, sf), 150)


def augmented_tiles(spark, sf):
    """Flipped and turned 64 x 64 tiles, pixel by pixel."""
    tiles = gr._image(spark, sf).selectExpr("image_id * 1000000L + row div 64 image_id", "row % 64 row", "col", "nir")
    return rg.augment(tiles, 64, choice="(image_id * 7 + image_id div 1000000) % 16").select("image_id", "row", "col", "nir")


def menu_order(spark, sf):
    named = lg._named(spark, sf)
    majors = d.table(spark, sf, "supplier").where("s_nationkey < 9").selectExpr(
        "s_nationkey % 5 state_id", "s_name district", "cast(s_suppkey as int) position")
    return ar.menu_order(named, majors)


def duplicate_districts(spark, sf):
    named = d.table(spark, sf, "supplier").selectExpr("s_nationkey % 5 state_id", "concat('Area ', s_suppkey % 60) district")
    return ar.duplicates(named)


def model_comparison(spark, sf):
    scored = ql._scored(spark, sf)
    better = scored.withColumn("p", F.when(F.col("y"), F.least(F.lit(1.0), F.col("p") + 0.25)).otherwise(F.col("p")))
    return ev.compare_models(scored, better, ql.CLASSES)


QUERIES = {f.__name__: f for f in (
    scene_area_join, cloudy_scenes, ndvi_layer, pair_confidence, unusable_pairs, display_choice, metadata_answers, ten_metre_shape,
    grid_area, reflect_padded, augmented_tiles, menu_order, duplicate_districts, model_comparison)}
