"""Queries on grids, windows, boxes and tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelloom.functions import geodesy as geo
from pixelloom.functions import indices as ix
from pixelloom.functions.semantics import iso_date
from pixelloom.operators import change as ch
from pixelloom.operators import display as dp
from pixelloom.operators import fusion as fu
from pixelloom.operators import regrid as rg
from pixelloom.operators import windows as wn
from workload import derived as d

SIZE, STRIDE = 16, 8


def _image(spark, sf, late=False):
    return d.dated_pixels(spark, sf, late).withColumnRenamed("pair_id", "image_id")


def _images(spark, sf):
    return d.wide_observations(spark, sf).groupBy(F.col("pair_id").alias("image_id")).agg(
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def _rounded(df, *columns):
    """Single precision: hides differences in the order of additions without creating rounding ties."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


def downsample_avg(spark, sf):
    df = rg.regrid(_image(spark, sf), rg.grid_for(_images(spark, sf), 40), ["red", "nir"])
    return _rounded(df, "red", "nir")


def upsample_bilinear(spark, sf):
    images = _images(spark, sf).selectExpr("*", "1.5D sx", "0D ox", "1.5D sy", "0D oy",
                                           "cast(width * 1.5 as int) out_width", "cast(height * 1.5 as int) out_height")
    return _rounded(rg.regrid(_image(spark, sf), images, ["nir"], "bilinear"), "nir")


def ten_metre_pixels(spark, sf):
    """Images of four ground scales at 10 m: halved, unchanged without a scale, enlarged, and in degrees."""
    images = _images(spark, sf).selectExpr(
        "*", "element_at(array('metres', 'pixels', 'metres', 'degrees'), cast(image_id as int) + 1) units",
        "element_at(array(5D, 1D, 15D, 0.00007D), cast(image_id as int) + 1) res_x", "element_at(array(5D, 1D, 15D, 0.00007D), cast(image_id as int) + 1) res_y", "12.9D mid_lat")
    return _rounded(rg.to_ten_metres(_image(spark, sf), images, ["red", "nir"]), "red", "nir")


def regrid_offset(spark, sf):
    images = _images(spark, sf).selectExpr("*", "0.75D sx", "2.25D ox", "0.75D sy", "-1.5D oy",
                                           "width out_width", "height out_height")
    return _rounded(rg.align(_image(spark, sf, True), _image(spark, sf), images, ["green"]), "green")


def nearest_resize(spark, sf):
    images = _images(spark, sf).selectExpr("*", "cast(width * 5 div 3 as int) out_width", "cast(height * 3 div 4 as int) out_height")
    return rg.resize_nearest(_image(spark, sf), images, ["nir"])


def _window_scores(spark, sf):
    """Two class probabilities per window: shares of built-up-like and of bright pixels."""
    pixels = _image(spark, sf)
    gathered = wn.window_pixels(pixels, _images(spark, sf), SIZE, STRIDE)
    return gathered.groupBy("image_id", "win_row", "win_col").agg(
        F.avg(ix.holds(ix.ndbi(F.col("swir1"), F.col("nir")) > 0).cast("double")).alias("urban_fabric"),
        F.avg((F.col("red") > 925).cast("double")).alias("industrial_commercial_units"))


def window_list(spark, sf):
    return wn.windows(_images(spark, sf), SIZE, STRIDE)


def scene_score(spark, sf):
    return _rounded(wn.scene_score(_window_scores(spark, sf)), "score")


def score_map(spark, sf):
    return _rounded(wn.score_map(_window_scores(spark, sf), _images(spark, sf), size=SIZE, stride=STRIDE), "score")


def patch_scores(spark, sf):
    def scorer(batch: np.ndarray) -> np.ndarray:
        means = batch.astype("float64").mean(axis=(2, 3))
        return 1 / (1 + np.exp(-means[:, [0, 3]]))

    df = wn.score_windows(_image(spark, sf), _images(spark, sf), scorer, class_names=["low", "high"],
                          mean=[500, 700, 600, 1500], std=[50, 100, 200, 800], size=SIZE, stride=STRIDE)
    return _rounded(df, "low", "high")


def stretch_2_98(spark, sf):
    return dp.stretch(_image(spark, sf), ["red", "green", "blue"])


def reflectance_scale(spark, sf):
    from pixelloom.operators.ordered import exact_percentiles

    bands = ["blue", "green", "red", "nir"]
    values = _image(spark, sf).selectExpr("image_id", f"explode(array({', '.join(bands)})) v").withColumn(
        "v", F.when(F.col("image_id") == 1, F.col("v") / 10000.0).when(F.col("image_id") == 2, F.col("v") * 5.0).otherwise(F.col("v")))
    p = exact_percentiles(values, ["image_id"], ["v"], {"p99": 0.99})
    scale = ix.reflectance_scale(F.col("v_p99"))
    return p.select("image_id", F.col("v_p99").cast("float").cast("double").alias("p99"), scale.alias("input_scale"),
                    ix.reflectance_factor(scale).alias("factor"))


def overlay_change(spark, sf):
    pixels = ch.compared_pixels(d.dated_pixels(spark, sf, False), d.dated_pixels(spark, sf, True), d.pair_catalogue(spark, sf))
    return dp.overlay(ch.class_map(pixels).drop("before_code"), dp.change_layers("after_code"))


def overlay_fusion(spark, sf):
    pixels = fu.fused_pixels(d.dated_pixels(spark, sf, True), d.radar_pixels(spark, sf), d.pair_catalogue(spark, sf))
    return dp.overlay(pixels, dp.fusion_layers("water")).select("pair_id", "row", "col", "r", "g", "b", "a")


def _boxes(spark, sf):
    return d.table(spark, sf, "orders").selectExpr(
        "o_orderkey box_id",
        "named_struct('w', (o_orderkey * 37 % 35800) / 100D - 179, 's', (o_orderkey * 53 % 16000) / 100D - 80, "
        "'e', (o_orderkey * 37 % 35800) / 100D - 179 + (1 + o_custkey % 12) / 100D, "
        "'n', (o_orderkey * 53 % 16000) / 100D - 80 + (1 + o_custkey % 7) / 100D) box",
        "named_struct('w', (o_orderkey * 37 % 35800) / 100D - 179 + (o_custkey % 15 - 7) / 100D, "
        "'s', (o_orderkey * 53 % 16000) / 100D - 80 + (o_custkey % 11 - 5) / 100D, "
        "'e', (o_orderkey * 37 % 35800) / 100D - 179 + (o_custkey % 15 - 1) / 100D, "
        "'n', (o_orderkey * 53 % 16000) / 100D - 80 + (o_custkey % 11 + 1) / 100D) other")


def box_overlap(spark, sf):
    df = _boxes(spark, sf).withColumn("common", geo.intersection(F.col("box"), F.col("other")))
    return df.select("box_id", F.col("common").isNotNull().alias("overlaps"),
                     geo.overlap_share("common", "box", "other").alias("overlap_fraction"))


def box_check(spark, sf):
    w, h = geo.box_size_km(F.col("box"))
    return _boxes(spark, sf).select("box_id", w.cast("float").cast("double").alias("width_km"), h.cast("float").cast("double").alias("height_km"),
                                    F.concat_ws(",", geo.box_problems(F.col("box"))).alias("problems"),
                                    geo.zoom_for(F.col("box")).alias("zoom"))


def utm_grid(spark, sf):
    return geo.export_grid(_boxes(spark, sf)).selectExpr(
        "box_id", "grid.epsg", "grid.width > 0 and grid.height > 0 has_pixels", "grid.xmin % 10 = 0 and grid.ymax % 10 = 0 on_grid")


def utm_extent(spark, sf):
    return geo.export_grid(_boxes(spark, sf)).selectExpr(
        "box_id", "grid.epsg", "grid.xmin", "grid.ymax", "grid.width", "grid.height")


def tile_xy(spark, sf):
    x, y = geo.tile_xy(F.col("lat"), F.col("lon"), F.col("z"))
    points = d.table(spark, sf, "customer").selectExpr(
        "c_custkey", "(c_custkey * 71 % 18000) / 100D - 90 lat", "(c_custkey * 131 % 36000) / 100D - 180 lon",
        "cast(3 + c_custkey % 16 as int) z")
    return points.select("c_custkey", "z", x.alias("x"), y.alias("y"))


def tile_block(spark, sf):
    df = _boxes(spark, sf).withColumn("z", F.expr("cast(8 + box_id % 10 as int)"))
    return df.withColumn("t", geo.tile_block(F.col("box"), F.col("z"))).selectExpr("box_id", "z", "t.x", "t.y", "t.w", "t.h")


def deepest_level(spark, sf):
    """Deepest level whose tiles are all available, else the level that always is."""
    tiles = d.table(spark, sf, "events").selectExpr(
        "cast(event_id div 6 as bigint) view_id", "cast(17 + event_id % 3 as int) z", "event_type <> 'error' available")
    full = tiles.groupBy("view_id", "z").agg(F.bool_and("available").alias("full"))
    return full.groupBy("view_id").agg(F.coalesce(F.max(F.when(F.col("full"), F.col("z"))),
                                                  F.lit(geo.ALWAYS_AVAILABLE_LEVEL)).alias("level"))


def box_around(spark, sf):
    df = d.table(spark, sf, "customer").selectExpr(
        "c_custkey", "(c_custkey * 71 % 16000) / 100D - 80 lat", "(c_custkey * 131 % 36000) / 100D - 180 lon",
        "cast(1 + c_custkey % 10 as double) km")
    return df.withColumn("b", geo.box_around(F.col("lat"), F.col("lon"), F.col("km"))).selectExpr(
        "c_custkey", "b.w", "b.s", "b.e", "b.n")


def date_ranges(spark, sf):
    """Start and end given as text: parse, order, future check and middle date."""
    texts = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "if(o_orderkey % 11 = 0, cast(year(o_orderdate) as string), date_format(o_orderdate, if(o_orderkey % 13 = 0, 'yyyy-M-d', 'yyyy-MM-dd'))) a",
        "date_format(date_add(o_orderdate, cast(o_custkey % 90 - 10 as int)), 'yyyy-MM-dd') b")
    start, end = iso_date(F.col("a")), iso_date(F.col("b"))
    df = texts.select("o_orderkey", start.alias("s"), end.alias("e"))
    return df.selectExpr(
        "o_orderkey", "case when s is null or e is null then 'unreadable' when s >= e then 'order' "
        "when s > date'2001-06-01' then 'future' else 'ok' end status",
        "if(s < e, cast(date_add(s, cast(floor(datediff(e, s) / 2) as int)) as string), null) mid_date")


QUERIES = {f.__name__: f for f in (
    downsample_avg, upsample_bilinear, ten_metre_pixels, regrid_offset, nearest_resize, window_list, scene_score, score_map, patch_scores,
    stretch_2_98, reflectance_scale, overlay_change, overlay_fusion, box_overlap, box_check, utm_grid, utm_extent, tile_xy,
    tile_block, deepest_level, box_around, date_ranges)}
