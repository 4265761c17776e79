import json

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import catalogue as cat
from pixelloom.plans import fetch as ft
from pixelloom.sources import readers as rd
from pixelloom.sources import writers as wr

BASE = {"upload_id": "u", "slot": 1, "mode": "single", "filename": "a.tif", "driver": "GTiff", "width": 100, "height": 100, "band_count": 4,
        "dtypes": ["uint16"], "band_descriptions": None, "crs": "EPSG:32643",
        "bounds": {"left": 0.0, "bottom": 0.0, "right": 1000.0, "top": 1000.0}, "resolution": {"x": 10.0, "y": 10.0, "units": "metres"},
        "georeferenced": True, "nodata": None, "date": None, "sensor": None, "band_roles": None, "benchmark_mode": False}
S2_13 = ["B1", "B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B9", "B10", "B11", "B12"]


def table(spark, *rows):
    return spark.createDataFrame([{**BASE, **r} for r in rows], rd.CATALOGUE_SCHEMA)


def pair(spark, a=None, b=None, mode="bi_temporal", **both):
    first = {"mode": mode, "slot": 1, "date": "2021-01-01", **both, **(a or {})}
    second = {"mode": mode, "slot": 2, "date": "2022-01-01", **both, **(b or {})}
    r = cat.validate_pairs(table(spark, first, second), "2024-01-01").first()
    return [x.code for x in r.reasons], r


@pytest.mark.parametrize("row,sensor,kind,roles", [
    ({}, "bgrn", "optical", {"blue": 1, "green": 2, "red": 3, "nir": 4}),
    ({"sensor": "sentinel2", "band_count": 13}, "sentinel2", "optical", {"blue": 2, "green": 3, "red": 4, "nir": 8, "swir1": 12, "swir2": 13}),
    ({"band_count": 6, "band_descriptions": ["B02", "B03", "B04", "B08", "B8A", "B11"]}, "sentinel2", "optical",
     {"blue": 1, "green": 2, "red": 3, "nir": 4, "swir1": 6}),
    ({"band_count": 2}, "sar", "sar", {"vv": 1, "vh": 2}),
    ({"band_count": 2, "band_descriptions": ["HH", "hv"]}, "described", "sar", {"hh": 1, "hv": 2}),
    ({"band_count": 3, "band_descriptions": ["red", "Red", "Near Infrared"]}, "described", "optical", {"red": 1, "nir": 3}),
    ({"band_count": 4, "driver": "PNG", "filename": "a.png"}, "rgb", "optical", {"red": 1, "green": 2, "blue": 3}),
    ({"band_count": 1, "driver": "JPEG", "filename": "a.jpg"}, "photo_gray", "optical", {}),
    ({"band_count": 5, "band_roles": "Blue, green,red,nir,-"}, "user", "optical", {"blue": 1, "green": 2, "red": 3, "nir": 4}),
    ({"band_count": 7}, "unknown", "optical", {})])
def test_band_roles(spark, row, sensor, kind, roles):
    r = cat.resolve_bands(table(spark, row)).first()
    assert r.band_error is None and (r.bands.sensor, r.bands.kind, dict(r.bands.roles)) == (sensor, kind, roles)


@pytest.mark.parametrize("row,text", [
    ({"band_roles": "red,nir"}, "has 2 entries but the file has 4"), ({"band_roles": "red,nir,x,-"}, "unknown band roles ['x']"),
    ({"band_roles": "-,-,-,-"}, "every band as ignored"), ({"band_roles": "red,red,-,-"}, "only once"),
    ({"band_roles": "red,vv,-,-"}, "mix optical and SAR"), ({"band_roles": "red,nir,-,-", "sensor": "rgb"}, "not both"),
    ({"sensor": "sentinel2", "band_count": 5}, "sentinel2 expects [4, 10, 12, 13] bands, file has 5"),
    ({"sensor": "lidar"}, "unknown sensor 'lidar'"), ({"sensor": "sar"}, "SAR images must have 1 or 2 bands")])
def test_band_errors(spark, row, text):
    r = cat.resolve_bands(table(spark, row)).first()
    assert text in r.band_error and r.bands is None


def test_accepted_pair_and_all_reasons(spark):
    codes, r = pair(spark)
    assert codes == [] and r.ok and r.overlap_fraction == 1.0 and r.same_crs
    assert pair(spark, {"date": None}, {"date": "2030-01-01"})[0] == ["missing_date", "future_date"]
    assert pair(spark, {"date": "2021-2-5"}, {"filename": "b.gif"})[0] == ["invalid_date", "unsupported_format"]
    assert pair(spark, {"date": "2021-01-01"}, {"date": "2021-01-01"})[0] == ["same_date"]
    assert pair(spark, b={"crs": "EPSG:4326"})[0] == ["crs_mismatch"]
    assert pair(spark, b={"bounds": {"left": 1000.0, "bottom": 0.0, "right": 2000.0, "top": 1000.0}})[0] == ["no_overlap"]
    assert pair(spark, b={"band_count": 2})[0] == ["modality_mismatch"]
    assert pair(spark, b={"georeferenced": False, "crs": None})[0] == ["missing_crs"]
    assert pair(spark, {"georeferenced": False}, {"georeferenced": False, "width": 9}, benchmark_mode=True)[0] == ["size_mismatch"]
    assert pair(spark, {"filename": "a.png"}, {"driver": None})[0] == ["image_requires_benchmark_mode", "unreadable_raster"]
    assert pair(spark, {"driver": "PNG"}, {"band_roles": "red"})[0] == ["format_mismatch", "invalid_band_roles"]
    assert pair(spark, {"band_count": 2}, {"band_count": 4}, mode="optical_sar")[0] == ["wrong_modality", "wrong_modality"]
    assert pair(spark, mode="single")[0] == ["file_count"] and pair(spark, mode="odd")[0] == ["invalid_mode"]


def test_warnings(spark):
    _, r = pair(spark, {"date": "2022-06-01"}, {"bounds": {"left": 600.0, "bottom": 0.0, "right": 1600.0, "top": 1000.0},
                                               "resolution": {"x": 20.0, "y": 20.0, "units": "metres"}, "band_count": 13, "band_descriptions": S2_13})
    text = " | ".join(r.warnings)
    assert r.overlap_fraction == 0.4 and "overlap by only 40%" in text and "Resolutions differ (10x10 metres vs 20x20 metres)" in text
    assert "Band counts differ (4 vs 13)" in text and "File 1 is dated after file 2" in text


def test_single_file_and_missing_extension(spark):
    r = cat.validate_pairs(table(spark, {"filename": "scene"}), "2024-01-01").first()
    assert r.ok and "detected GTiff" in r.warnings[0]
    assert [x.code for x in cat.validate_pairs(table(spark, {"filename": "x", "driver": None}), "2024-01-01").first().reasons] == ["unreadable_raster"]


def test_metadata_answer(spark):
    df = cat.resolve_bands(table(spark, {"date": "2021-01-01"})).withColumn("fields", F.array(*[F.lit(f) for f in (
        "bands", "dtype", "crs", "resolution", "size", "bounds", "date", "sensor")]))
    assert cat.metadata_answer(df).first().line == (
        "File 1 (a.tif): 4 band(s), blue=band 1, green=band 2, red=band 3, nir=band 4 (inferred from band count); data type uint16; CRS EPSG:32643; "
        "resolution 10 x 10 metres; 100 x 100 pixels; bounds [0, 0, 1000, 1000]; date 2021-01-01; optical image, sensor profile 4-band blue/green/red/NIR")


def test_fetch_requests(spark):
    schema = "request_id int, mode string, box struct<w:double,s:double,e:double,n:double>, ranges array<struct<start:string,end:string>>"
    box, big = (77.6, 12.9, 77.64, 12.93), (77.0, 12.0, 78.0, 13.0)
    good = ("2024-01-01", "2024-03-01")
    df = spark.createDataFrame([(1, "bi_temporal", box, [good, good]), (2, "single", big, [good]), (3, "bi_temporal", box, [good]),
                                (4, "single", box, [("2024-1-1", "2024-03-01")]), (5, "single", box, [("2024-03-01", "2024-03-01")])], schema)
    checked = {r.request_id: r.problems for r in ft.check_requests(df, "2024-12-01").collect()}
    assert checked == {1: [], 2: ["too_large"], 3: ["missing_range"], 4: ["unreadable_date"], 5: ["start_not_before_end"]}
    plan = ft.fetch_plan(df, "2024-12-01").orderBy("slot").collect()
    assert [(r.slot, r["product"], str(r.mid_date)) for r in plan] == [(1, "s2", "2024-01-31"), (2, "s2", "2024-01-31")]


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([
        {"id": "a", "image": "x.tif", "question": "Q"}, {"images": ["/abs/1.tif", "2.tif"], "dates": ["2021-01-01", None]}]))
    items = {r.id: r for r in rd.read_manifest(spark, str(tmp_path / "m.json"), task="caption").collect()}
    assert items["a"].images == [f"{tmp_path}/x.tif"] and items["a"].mode == "single"
    assert items["1"].mode == "optical_sar" and items["1"].question == "Describe this image" and items["1"].images == ["/abs/1.tif", f"{tmp_path}/2.tif"]
    files = rd.manifest_files(rd.read_manifest(spark, str(tmp_path / "m.json"))).where("id = '1'").orderBy("slot").collect()
    assert [(f.slot, f.date) for f in files] == [(1, "2021-01-01"), (2, None)]
    folder = tmp_path / "f"
    folder.mkdir()
    for n, size in (("b.TIF", 5), ("a.tiff", 9), ("c.png", 3), ("d.txt", 1)):
        (folder / n).write_bytes(b"x" * size)
    assert sorted(r.id for r in rd.read_folder(spark, str(folder)).collect()) == ["a", "b"]
    assert [r.code for r in cat.size_problems(rd.read_folder(spark, str(folder), True), 8).collect()] == ["file_too_large"]
    for key, rows in (("images", [{"id": 1, "active": True}]), ("questions", [{"id": 5, "img_id": 1, "type": "count", "question": "q", "active": True}]),
                      ("answers", [{"id": 7, "question_id": 5, "answer": "3", "active": True}])):
        (tmp_path / f"LR_split_val_{key}.json").write_text(json.dumps({key: rows}))
    assert [t.count() for t in rd.read_qa_split(spark, str(tmp_path), "val")] == [1, 1, 1]
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"properties": {"shapeName": "A", "shapeISO": "X"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"properties": {"shapeName": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}]}))
    edges = rd.ring_edges(rd.read_boundaries(spark, str(tmp_path / "g.json")), ["feature_id", "ring_id"])
    assert {r.feature_id: r["count"] for r in edges.groupBy("feature_id").count().collect()} == {0: 4, 1: 8}


def test_sinks(spark, tmp_path):
    pred = spark.createDataFrame([("1", "OK"), ("2", "REJECTED"), ("3", "OK")], "id string, status string")
    assert wr.write_predictions(pred, str(tmp_path / "p")) == {"OK": 2, "REJECTED": 1}
    assert wr.write_predictions(pred.limit(0), str(tmp_path / "none")) == {}
    counts = {r.status: r.n for r in spark.read.json(str(tmp_path / "p/status_counts")).collect()}
    assert counts == {"OK": 2, "REJECTED": 1}
    store = str(tmp_path / "store")
    spark.createDataFrame([("a", [1.0], "m")], "key string, vec array<double>, model_id string").write.parquet(store)
    encode = lambda keys: keys.withColumn("vec", F.array(F.lit(2.0)))
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    wr.extend_embedding_store(keys, store, "m", encode)
    wr.extend_embedding_store(keys, store, "m", encode)
    assert sorted(r.key for r in spark.read.parquet(store).collect()) == ["a", "b"]
    px = spark.createDataFrame([("i", 0, 0, 1.0, float("nan")), ("i", 0, 1, -9.0, 2.0)], "image_id string, row int, col int, red double, nir double")
    px.write.parquet(str(tmp_path / "px"))
    got = rd.read_pixels(spark, str(tmp_path / "px"), ["red", "nir"], nodata=-9.0).orderBy("col").collect()
    assert [(r.red, r.nir) for r in got] == [(1.0, None), (None, 2.0)]
