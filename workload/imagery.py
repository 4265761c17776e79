"""Queries on scene stacks: composites, cover, fusion and change."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import change as ch
from pixelloom.operators import composite as cp
from pixelloom.operators import cover as cv
from pixelloom.operators import fusion as fu
from workload import derived as d


def _clear_composite(spark, sf, bands):
    return cp.median_composite(cp.mask_cloudy(d.observations(spark, sf)), bands)


def veg_cover(spark, sf):
    return cv.vegetation_cover(_clear_composite(spark, sf, ["red", "nir"]), d.areas(spark, sf))


def water_cover(spark, sf):
    return cv.water_cover(_clear_composite(spark, sf, ["green", "nir"]), d.areas(spark, sf))


def flood_potential(spark, sf):
    clear = cp.mask_cloudy(d.observations(spark, sf, flooded=True))
    current = cp.median_composite(cp.in_period(clear, "2001-07-15", "2001-10-13"), ["green", "nir"])
    baseline = cp.median_composite(cp.in_period(clear, "2000-10-13", "2001-10-13"), ["green", "nir"])
    return cv.flood_potential(current, baseline, d.cover_map(spark, sf), d.areas(spark, sf))


def landcover_composition(spark, sf):
    return cv.landcover_composition(d.cover_map(spark, sf), d.areas(spark, sf))


def s2_median(spark, sf):
    bands = ["blue", "green", "red", "nir", "swir1"]
    return cp.as_stored(_clear_composite(spark, sf, bands), bands)


def s1_median(spark, sf):
    df = cp.median_composite(d.observations(spark, sf), ["vv_db"])
    return df.withColumn("vv_db", F.round("vv_db", 6))


def scene_counts(spark, sf):
    return cp.scene_counts(cp.mask_cloudy(d.observations(spark, sf)))


def _scenes(spark, sf):
    return d.observations(spark, sf).select("aoi", "scene_id").distinct()


def _cloud_pixels(spark, sf):
    """Cloud-score scenes: they lag, so the newest scenes have none yet."""
    return (d.observations(spark, sf).where(F.col("ts") < "2001-08-01")
            .groupBy("aoi", "scene_id", "row", "col").agg(F.max("cs_cdf").alias("cs_cdf")))


def cloud_semi_join(spark, sf):
    kept = cp.with_cloud_scene(_scenes(spark, sf), _cloud_pixels(spark, sf).select("aoi", "scene_id").distinct())
    return kept.groupBy("aoi").agg(F.count(F.lit(1)).alias("scenes"), F.max("scene_id").alias("newest"))


def cloud_mask_join(spark, sf):
    per_scene = d.observations(spark, sf).groupBy("aoi", "scene_id", "row", "col").agg(
        F.avg("red").alias("red"), F.avg("nir").alias("nir"))
    clear = cp.clear_observations(per_scene, _cloud_pixels(spark, sf))
    return clear.groupBy("aoi", "scene_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.max("nir").alias("max_nir"))


def radar_scene_filter(spark, sf):
    scenes = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey scene_id", "if(o_orderstatus = 'F', 'EW', 'IW') instrument_mode",
        "case when o_orderpriority like '1%' then array('VV') when o_orderpriority like '2%' then array('HH', 'HV') "
        "else array('VV', 'VH') end polarisations", "o_orderdate ts")
    kept = cp.radar_scenes(cp.in_period(scenes, "1996-01-01", "1999-01-01"))
    return kept.groupBy(F.expr("cast(year(ts) as int)").alias("year")).agg(
        F.count(F.lit(1)).alias("scenes"), F.max("scene_id").alias("last_scene"))


def lookback_counts(spark, sf):
    clear = cp.mask_cloudy(d.observations(spark, sf))
    recent = cp.lookback(clear.where((F.col("aoi") != 3) | (F.col("ts") < "2001-06-01")),
                         "2001-11-01")
    return recent.groupBy("aoi", "period").agg(F.count(F.lit(1)).alias("observations"), F.to_date(F.min("ts")).alias("first_day"))


QUERIES = {f.__name__: f for f in (
    veg_cover, water_cover, flood_potential, landcover_composition, s2_median, s1_median, scene_counts,
    cloud_semi_join, cloud_mask_join, radar_scene_filter, lookback_counts)}


def _round6(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _fusion(spark, sf, rule):
    return fu.map_water_builtup(d.dated_pixels(spark, sf, True), d.radar_pixels(spark, sf), d.pair_catalogue(spark, sf),
                                fu.FusionParams(fusion=rule))


def fusion_and(spark, sf):
    return _fusion(spark, sf, "and")


def fusion_or(spark, sf):
    return _fusion(spark, sf, "or")


def sar_db(spark, sf):
    profile = fu.radar_profile(d.radar_pixels(spark, sf), d.pair_catalogue(spark, sf))
    return _round6(profile, "median_db")


def _change(spark, sf):
    return ch.analyse_change(d.dated_pixels(spark, sf, False), d.dated_pixels(spark, sf, True), d.pair_catalogue(spark, sf))


def change_classes(spark, sf):
    return _change(spark, sf).classes


def change_transitions(spark, sf):
    return _change(spark, sf).transitions


def change_robustness(spark, sf):
    return _change(spark, sf).robustness


def change_summary(spark, sf):
    return _change(spark, sf).summary


def season_gap(spark, sf):
    return _change(spark, sf).season


def change_confidence(spark, sf):
    return _change(spark, sf).confidence.select("pair_id", "class", "confidence")


QUERIES |= {f.__name__: f for f in (
    fusion_and, fusion_or, sar_db, change_classes, change_transitions, change_robustness, change_summary, season_gap,
    change_confidence)}
