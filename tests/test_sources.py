import datetime
import json

from pyspark.sql import functions as F

from pixelloom.functions import geodesy as geo
from pixelloom.operators import scoring as sc
from pixelloom.sources import readers as rd
from pixelloom.plans import predict as pr
from pixelloom.sources import writers as wr


def write(path, value, lines=False):
    path.write_text("\n".join(json.dumps(v) for v in value) if lines else json.dumps(value, indent=1))
    return str(path)


def test_catalogue_records(spark, tmp_path):
    path = write(tmp_path / "c.json", [{"upload_id": "u", "slot": 1, "band_count": 4, "nodata": "nan", "bounds": {"left": 1.0, "top": 2.0}}, {"upload_id": "v"}], True)
    rows = {r.upload_id: r for r in rd.read_catalogue(spark, path).collect()}
    assert rows["u"].nodata == "nan" and rows["u"].bounds.left == 1.0 and rows["v"].slot is None


def test_manifest_ids_are_positions_or_digests(spark, tmp_path):
    items = [{"image": "a.tif"}, {"id": "own", "images": ["/abs/b.tif", "c.tif"]}, {"image": "d.tif", "question": "why"}]
    got = rd.read_manifest(spark, write(tmp_path / "m.json", items), "caption").collect()
    assert [r.id for r in got] == ["0", "own", "2"] and got[0].question == "Describe this image" and got[2].question == "why"
    assert got[1].images == ["/abs/b.tif", f"{tmp_path}/c.tif"] and got[1]["mode"] == "optical_sar"
    lines = rd.read_manifest(spark, write(tmp_path / "m.jsonl", items, True), "caption", lines=True).collect()
    assert len({r.id for r in lines}) == 3 and sorted(r.question for r in lines) == sorted(r.question for r in got)


def test_split_boundaries_and_areas_read_alike_by_line(spark, tmp_path):
    parts = {"images": [{"id": 1, "active": True}], "questions": [{"id": 2, "img_id": 1, "type": "count", "question": "how", "active": True}],
             "answers": [{"id": 3, "question_id": 2, "answer": "4", "active": True}]}
    for key, rows in parts.items():
        write(tmp_path / f"LR_split_val_{key}.json", {key: rows})
        write(tmp_path / f"LR_split_val_{key}.jsonl", rows, True)
    for whole, lines in zip(rd.read_qa_split(spark, str(tmp_path), "val"), rd.read_qa_split(spark, str(tmp_path), "val", True), strict=True):
        assert whole.collect() == lines.collect() != []

    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]
    features = [{"properties": {"shapeName": "N", "shapeISO": "I", "shapeID": "x"}, "geometry": {"type": t, "coordinates": c}}
                for t, c in (("Polygon", [ring]), ("MultiPolygon", [[ring], [ring, ring]]))]
    whole = rd.read_boundaries(spark, write(tmp_path / "b.json", {"features": features}))
    lines = rd.read_boundaries(spark, write(tmp_path / "b.jsonl", features, True), lines=True)
    assert [(r.feature_id, r.ring_id) for r in whole.collect()] == [(0, 0), (1, 0), (1, 1), (1, 2)]
    assert whole.drop("feature_id").collect() == lines.drop("feature_id").collect()

    states = [{"name": "S", "districts": [{"name": "D", "lat": 1.0}], "aliases": {"old": "D"}, "major_cities": [{"label": "C", "district": "D"}]}]
    for df, first in zip(rd.read_areas(spark, write(tmp_path / "a.json", {"states": states})), ("S", "S", "S"), strict=True):
        assert [r.state for r in df.collect()] == [first]
    assert rd.read_areas(spark, write(tmp_path / "a.jsonl", states, True), lines=True)[1].first().district == "D"


def test_patches_and_collections_read_what_is_asked(spark, tmp_path):
    spark.createDataFrame([("i", "n", ["l"], 1, "c", "unused")], "image string, nir string, labels array<string>, image_id int, country string, more string"
                          ).write.parquet(f"{tmp_path}/p")
    assert rd.read_patches(spark, f"{tmp_path}/p").columns == ["image", "nir", "labels", "image_id", "country"]
    rows = [(datetime.datetime(2020, m, 15), 2020, m) for m in range(1, 13)]
    spark.createDataFrame(rows, "ts timestamp, year int, month int").write.partitionBy("year", "month").parquet(f"{tmp_path}/root/s2")
    assert [r.month for r in rd.read_collection(spark, f"{tmp_path}/root", "s2", "2020-03-15", "2020-05-15").orderBy("month").collect()] == [3, 4]


def test_results_and_reports(spark, tmp_path):
    day = datetime.datetime(2024, 5, 6, 7)
    results = spark.createDataFrame([("u", "q?", "OK", "head", day)], "upload_id string, question string, status string, headline string, created_at timestamp")
    wr.append_results(results, f"{tmp_path}/r")
    wr.append_results(results, f"{tmp_path}/r")
    back = spark.read.parquet(f"{tmp_path}/r")
    assert back.count() == 2 and back.first().day == day.date()
    file = "array<struct<slot:int,filename:string,kind:string,date:string,band_count:int,crs:string,resolution:string,roles:string>>"
    uploads = spark.createDataFrame([("u", "single", [(1, "f.tif", "optical", None, 4, "c", "r", "b")], None)], f"upload_id string, mode string, files {file}, warnings array<string>")
    report = json.loads(wr.report_records(uploads, results).first().report)
    assert report["answer"] == {"question": "q?", "status": "OK", "headline": "head"} and report["upload"]["files"][0]["bands"] == 4
    assert report["upload"]["warnings"] == []


def test_units_and_georeference(spark):
    rows = [("EPSG:4326", True, None), ("EPSG:32643", False, "metre"), (None, None, None)]
    df = spark.createDataFrame(rows, "crs string, geographic boolean, unit string")
    got = [r.u for r in df.select(geo.units_of(F.col("crs"), F.col("geographic"), F.col("unit")).alias("u")).collect()]
    assert got[0] == "degrees" and got[1] == "metres" and got[2] == "pixels"
    one = spark.createDataFrame([("c", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), ("c", 10.0, 0.0, 5.0, 0.0, -10.0, 9.0), (None, 10.0, 0.0, 5.0, 0.0, -10.0, 9.0)],
                                "crs string, a double, b double, c double, d double, e double, f double")
    got = [r.g for r in one.select(geo.georeferenced(*[F.col(x) for x in one.columns]).alias("g")).collect()]
    assert got == [False, True, False]


def test_records_meet_their_vectors(spark):
    records = spark.createDataFrame([(1, 7, "q1"), (2, 7, "q2"), (3, 8, "q1")], "qid int, img_id int, question string")
    images = spark.createDataFrame([(7, [1.0]), (9, [9.0])], "img_id int, vec array<double>")
    texts = spark.createDataFrame([("q1", [2.0]), ("q2", [3.0])], "question string, vec array<double>")
    got = {r.qid: (r.image_vec, r.question_vec) for r in sc.with_embeddings(records, images, texts).collect()}
    assert got == {1: ([1.0], [2.0]), 2: ([1.0], [3.0])}


def test_manifest_runs_from_files_to_predictions(spark):
    items = spark.createDataFrame([
        ("q1", None, ["d/a.tif"], None, None, "Is there a road?"), ("q2", "bi_temporal", ["d/a.tif", "d/b.tif"], ["2021-02-15", "2025-02-15"], None, "Has built-up area increased?"),
        ("q3", "bi_temporal", ["d/a.tif"], ["2021-02-15"], None, "What changed?"), ("q4", None, ["d/a.tif"], None, None, "Which CRS does the image have?"),
        ("q5", None, ["d/a.tif"], None, None, "Has built-up area increased?"), ("q6", "bi_temporal", ["d/a.tif", "d/b.tif"], ["2021-02-15", "no date"], None, "What changed?")],
        "id string, mode string, images array<string>, dates array<string>, band_roles array<string>, question string")
    bounds, res = "named_struct('left', 0D, 'bottom', 0D, 'right', 100D, 'top', 100D)", "named_struct('x', 10D, 'y', 10D, 'units', 'metres')"
    files = spark.sql(f"""select path, 'GTiff' driver, 10 width, 10 height, 4 band_count, array('uint16', 'uint16', 'uint16', 'uint16') dtypes,
      array('blue', 'green', 'red', 'nir') band_descriptions, 'EPSG:32643' crs, {bounds} bounds, {res} resolution, true georeferenced,
      cast(null as string) sensor, false benchmark_mode from values ('d/a.tif'), ('d/b.tif') t(path)""")
    results = spark.createDataFrame([("q1", "vqa", "OK", "Yes, there is a road.", "yes", 0.8, "vqa_head", "1", "trained_head"),
                                     ("q2", "change", "ERROR", "the model failed", None, None, "change_rules", "2", None)],
                                    "upload_id string, task string, status string, answer string, short_answer string, confidence double, tool string, tool_version string, answered_by string")
    got = {r.id: r for r in pr.run_manifest(items, files, results, "2026-01-01", "vqa").collect()}
    assert len(got) == 6
    assert (got["q1"].status, got["q1"].answer, got["q1"].tool, got["q1"].answered_by, got["q1"].reasons, got["q1"].reason, got["q1"].task_mismatch) == (
        "OK", "yes", "vqa_head", "trained_head", None, None, None)
    assert (got["q2"].status, got["q2"].answer, got["q2"].reason, got["q2"].task_mismatch) == ("ERROR", None, "the model failed", "routed to 'change', not 'vqa'")
    assert got["q3"].status == "REJECTED" and [r.code for r in got["q3"].reasons] == ["file_count"] and got["q3"].task is None and got["q3"].reason is None
    assert (got["q4"].status, got["q4"].task, got["q4"].reason) == ("NOT_AVAILABLE", "metadata", "no result for this task")
    assert got["q5"].status == "REJECTED" and got["q5"].reasons is None and got["q5"].reason == "the question does not fit the images"
    assert "invalid_date" in [r.code for r in got["q6"].reasons]
