"""Queries on the raster catalogue, fetch plans and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import catalogue as cat
from workload import derived as d

DESCRIPTIONS = (["Blue", "Green", "Red", "Near-Infrared", "SWIR_1"], ["B02", "B3", "b04", "B08", "B8A", "B11"], ["VV", "vh"])
COUNTS = (1, 2, 3, 4, 5, 10, 12, 13)


def catalogue(spark, sf):
    """Two files per upload from consecutive orders."""
    return d.table(spark, sf, "orders").selectExpr(
        "o_orderkey div 2 upload_id", "cast(o_orderkey % 2 + 1 as int) slot",
        "case when o_orderkey div 2 % 23 = 0 then 'weird' when o_orderkey div 2 % 5 = 0 then 'single' when o_orderkey div 2 % 2 = 0 then 'optical_sar' else 'bi_temporal' end mode",
        "concat('scene_', o_orderkey, case when o_orderkey % 41 = 0 then '' when o_orderkey % 19 = 0 then '.gif' when o_orderkey % 9 = 0 then '.PNG' else '.tif' end) filename",
        "case when o_orderkey % 31 = 0 then null when o_orderkey % 9 = 0 then 'PNG' when o_orderkey % 29 = 0 then 'JPEG' else 'GTiff' end driver",
        "cast(400 + o_orderkey div 2 % 3 + if(o_orderkey % 37 = 0, 5, 0) as int) width", "cast(300 as int) height",
        f"case o_orderkey % 6 when 1 then 5 when 2 then 6 when 3 then 2 else element_at(array({', '.join(map(str, COUNTS))}), cast(o_custkey % 8 + 1 as int)) end band_count",
        "array('uint16', 'uint16') dtypes",
        "case o_orderkey % 6 " + " ".join(f"when {i + 1} then array({', '.join(repr(x) for x in v)})" for i, v in enumerate(DESCRIPTIONS)) + " end band_descriptions",
        "if(o_orderkey % 17 = 0, null, if(o_orderkey % 43 = 0, 'EPSG:32644', 'EPSG:32643')) crs",
        "named_struct('left', 780000D + o_custkey % 40 * 100, 'bottom', 1430000D, 'right', 784000D + o_custkey % 40 * 100, 'top', 1440000D) bounds",
        "named_struct('x', if(o_orderkey % 7 = 0, 20D, 10D), 'y', 10D, 'units', 'metres') resolution", "o_orderkey % 17 <> 0 georeferenced",
        "case when o_custkey % 10 = 0 then null when o_custkey % 11 = 0 then '2021-2-5' else date_format(o_orderdate, 'yyyy-MM-dd') end date",
        "case o_orderkey % 13 when 7 then 'sentinel2' when 8 then 'rgb' when 9 then 'cartosat2s' when 10 then 'sar' else 'auto' end sensor",
        "case when o_orderkey % 16 = 5 then 'blue, Green,red,nir,-' when o_orderkey % 16 = 9 then 'vv,vh' when o_orderkey % 16 = 11 then 'blue,vv' end band_roles",
        "o_orderkey div 2 % 3 = 0 benchmark_mode")


def band_roles(spark, sf):
    df = cat.resolve_bands(catalogue(spark, sf))
    return df.select("upload_id", "slot", "band_error", "bands.sensor", "bands.kind", "bands.source",
                     F.expr("concat_ws(',', transform(map_entries(bands.roles), e -> concat(e.key, '=', e.value)))").alias("roles"),
                     F.concat_ws(",", "bands.band_names").alias("band_names"), F.size("bands.warnings").alias("warnings"))


def validate_pairs(spark, sf):
    df = cat.validate_pairs(catalogue(spark, sf), "2001-06-01")
    return df.select("upload_id", "mode", "ok", F.expr("concat_ws(',', transform(reasons, r -> concat(r.code, coalesce(concat(':', r.file), ''))))").alias("reasons"),
                     F.size("warnings").alias("warnings"), "same_crs", "overlap_fraction", "same_resolution")


def reason_counts(spark, sf):
    df = cat.validate_pairs(catalogue(spark, sf), "2001-06-01")
    return df.select(F.explode("reasons").alias("r")).groupBy("r.code").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (band_roles, validate_pairs, reason_counts)}
