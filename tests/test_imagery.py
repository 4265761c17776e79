import datetime
import statistics

import pytest
from pyspark.sql import functions as F

from pixelloom.operators import change as ch
from pixelloom.operators import composite as cp
from pixelloom.operators import cover as cv
from pixelloom.operators import fusion as fu
from pixelloom.operators.ordered import medians
from pixelloom.plans import answers as an
from tests import scenes as s
from workload import answers
from workload import derived as d


def by_class(df):
    return {r["class"]: r.asDict() for r in df.collect()}


def optical(spark, **kw):
    return s.scene(spark, [(2, s.WATER), (2, s.BUILT), (4, s.VEGETATION)], **kw)


def test_fusion_and(spark):
    got = by_class(fu.map_water_builtup(optical(spark), s.radar(spark), s.pairs(spark)))
    w, b = got["water"], got["built_up"]
    assert (w["valid_pixels"], w["valid_area_km2"]) == (64, 0.0064)
    assert (w["pixels"], w["percent"], w["sar_percent"], w["sar_only_percent"], w["agreement"]) == (16, 25.0, 26.56, 1.56, round(16 / 17, 4))
    assert (b["pixels"], b["percent"], b["optical_percent"], b["optical_only_percent"], b["agreement"]) == (
        15, 23.44, 25.0, 1.56, round(15 / 16, 4))


def test_fusion_or_and_invariant(spark):
    params = fu.FusionParams(fusion="or")
    got = by_class(fu.map_water_builtup(optical(spark), s.radar(spark), s.pairs(spark), params))
    assert got["water"]["pixels"] == 17 and got["built_up"]["pixels"] == 16
    pixels = fu.fused_pixels(optical(spark), s.radar(spark), s.pairs(spark), params)
    assert pixels.where("water and built_up").count() == 0


def test_fusion_with_missing_bands_and_nodata(spark):
    rgb = s.pairs(spark, roles=("blue", "green", "red"))
    got = by_class(fu.map_water_builtup(optical(spark), s.radar(spark), rgb))
    assert got["water"]["pixels"] == 17 and got["water"]["agreement"] is None and got["water"]["optical_percent"] is None
    half = by_class(fu.map_water_builtup(optical(spark), s.radar(spark, half_zero=True), s.pairs(spark)))
    assert half["water"]["valid_pixels"] == 32
    no_radar = s.pairs(spark, radar=())
    only = by_class(fu.map_water_builtup(optical(spark), s.radar(spark), no_radar))
    assert only["water"]["pixels"] == 16 and only["water"]["sar_percent"] is None


def test_radar_profile(spark):
    p = fu.radar_profile(s.radar(spark), s.pairs(spark)).first()
    assert p.was_linear and p.sar_calibrated and p.sar_band == "vv"
    raw = s.radar(spark).withColumn("vv", F.col("vv") * 1e6)
    assert not fu.radar_profile(raw, s.pairs(spark)).first().sar_calibrated


def test_fusion_parameters_are_checked():
    with pytest.raises(ValueError):
        fu.FusionParams(sar_water_db=-5, sar_builtup_db=-8)
    with pytest.raises(ValueError):
        fu.FusionParams(fusion="xor")
    with pytest.raises(ValueError):
        ch.ChangeParams(unchanged_tolerance_pp=30)


BEFORE = [(2, s.WATER), (2, s.BUILT), (4, s.VEGETATION)]
AFTER = [(2, s.WATER), (3, s.BUILT), (2, s.VEGETATION), (1, s.OTHER)]


def test_change_golden(spark):
    r = ch.analyse_change(s.scene(spark, BEFORE), s.scene(spark, AFTER), s.pairs(spark))
    got = by_class(r.classes)
    b, v, o = got["built_up"], got["vegetation"], got["other"]
    assert got["water"]["direction"] == "unchanged"
    assert (b["before_percent"], b["after_percent"], b["delta_pp"], b["relative_change_percent"]) == (25.0, 37.5, 12.5, 50.0)
    assert (b["before_km2"], b["after_km2"]) == (0.0016, 0.0024)
    assert v["delta_pp"] == -25.0 and o["delta_pp"] == 12.5 and o["relative_change_percent"] is None
    moves = [(t["from_class"], t["to_class"], t["pixels"]) for t in r.transitions.orderBy("rank").collect()]
    assert moves == [("vegetation", "built_up", 8), ("vegetation", "other", 8)]
    assert all(x["robustness"] == 1.0 and x["runs"] == 27 for x in r.robustness.collect())
    assert r.season.first().season_gap == 0.0 and r.summary.first().changed_percent == 25.0


def test_change_with_swir_and_dimmed_plants(spark):
    roles = ("blue", "green", "red", "nir", "swir1")
    r = ch.analyse_change(s.scene(spark, BEFORE, swir=True), s.scene(spark, AFTER, swir=True), s.pairs(spark, roles=roles))
    assert by_class(r.classes)["built_up"]["delta_pp"] == 12.5
    assert r.summary.first().built_method == "NDBI (SWIR1, NIR)"
    dim = s.scene(spark, BEFORE).withColumn("nir", F.when(F.col("nir") == 3000, 800.0).otherwise(F.col("nir")))
    season = ch.analyse_change(s.scene(spark, BEFORE), dim, s.pairs(spark)).season.first()
    assert season.season_gap > 0.15 and season.season_factor == 0.0


def test_change_needs_bands_and_valid_pixels(spark):
    r = ch.analyse_change(s.scene(spark, BEFORE), s.scene(spark, AFTER), s.pairs(spark, roles=("blue", "green", "red")))
    row = r.summary.first()
    assert row.status == "NOT_AVAILABLE" and row.missing_bands == "nir"
    empty = s.scene(spark, AFTER).withColumn("nir", F.lit(None).cast("double"))
    assert ch.analyse_change(s.scene(spark, BEFORE), empty, s.pairs(spark)).summary.first().status == "ERROR"


def test_zero_denominator_is_other_not_null(spark):
    dark = s.scene(spark, [(8, (0.0, 0.0, 0.0, 0.0))])
    got = by_class(ch.analyse_change(dark, dark, s.pairs(spark)).classes)
    assert got["other"]["before_percent"] == 100.0


def test_model_disagreement(spark):
    r = ch.analyse_change(s.scene(spark, BEFORE), s.scene(spark, AFTER), s.pairs(spark))
    scores = spark.createDataFrame([("p", "before", 0.5), ("p", "after", 0.3)], "pair_id string, date string, score double")
    v = ch.built_up_verdict(r.classes, r.confidence, ch.model_direction(scores)).first()
    assert (v.direction, v.agree, v.confidence) == ("decreased", False, 0.5)


def test_change_answer_text(spark):
    r = ch.analyse_change(s.scene(spark, BEFORE), s.scene(spark, AFTER), s.pairs(spark))
    row = an.change_answers(r, s.pairs(spark)).first()
    first, second = row.answer.split("\n")[:2]
    assert first == "Between 2021-02-05 and 2025-02-05, 25.00% of the compared area changed land-cover class."
    assert second == ("Vegetation decreased: 50.00% on 2021-02-05 -> 25.00% on 2025-02-05 (-25.00 percentage points, "
                      "0.0032 -> 0.0016 km², -0.0016 km², -50.0% relative).")
    assert "Largest transitions: Vegetation -> Built-up 12.50%; Vegetation -> Other 12.50%." in row.answer
    assert row.headline == "About 25.0% of the area changed between 5 Feb 2021 and 5 Feb 2025."


def test_composite_keeps_pixels_without_values(spark):
    rows = [(0, 0, i % 3, float((i * 37) % 101) / 7) for i in range(300)] + [(0, 5, 5, None)] * 20 + [(0, 6, 6, None), (0, 6, 6, 2.5)]
    obs = spark.createDataFrame(rows, "aoi int, row int, col int, vv double")
    got = {(r.row, r.col): r.vv for r in cp.median_composite(obs, ["vv"]).collect()}
    assert len(got) == 5 and got[5, 5] is None and got[6, 6] == 2.5
    assert got[0, 0] == statistics.median(v for _, _, c, v in rows[:300] if c == 0)


def test_pair_without_ndvi_keeps_its_answer(spark):
    only, pairs = s.scene(spark, [(8, (0.0, 0.0, 0.0, 0.0))]), s.pairs(spark)
    r = ch.analyse_change(only, only, pairs)
    season = r.season.first()
    assert season.season_gap is None and season.season_factor == 0.0
    assert r.confidence.count() == 4 and {x.confidence for x in r.confidence.collect() if x["class"] == "built_up"} == {0.0}
    assert an.change_answers(r, pairs).count() == 1


def test_scene_area_join(spark):
    box = "box struct<w:double,s:double,e:double,n:double>"
    scenes = spark.createDataFrame([(1, (0.0, 0.0, 2.5, 2.5)), (2, (3.0, 3.0, 4.0, 4.0)), (3, (-1.0, -1.0, 0.0, 0.0))], f"scene_id int, {box}")
    aois = spark.createDataFrame([(9, (0.0, 0.0, 3.0, 3.0))], f"aoi int, {box}")
    assert [r.scene_id for r in cp.touching(scenes, aois).collect()] == [1]


def test_lookback(spark):
    rows = [(1, datetime.datetime(2024, 11, 1)), (1, datetime.datetime(2024, 3, 1)), (2, datetime.datetime(2024, 3, 1)), (3, datetime.datetime(2020, 3, 1))]
    obs = spark.createDataFrame(rows, "aoi int, ts timestamp")
    got = sorted((r.aoi, r.period) for r in cp.lookback(obs, "2024-12-01").collect())
    assert got == [(1, "90 days"), (2, "365 days")]
    assert [r.aoi for r in cp.lookback(obs, "2024-12-01", "reject").collect()] == [1]


def test_clip_with_hole(spark):
    pixels = spark.createDataFrame([(1, x + 0.5, y + 0.5) for x in range(10) for y in range(10)], "aoi int, x double, y double")

    def ring(a, b):
        pts = [(a, a), (b, a), (b, b), (a, b)]
        return [(1, *map(float, pts[i]), *map(float, pts[(i + 1) % 4])) for i in range(4)]

    edges = spark.createDataFrame(ring(1, 9) + ring(4, 6), "aoi int, x1 double, y1 double, x2 double, y2 double")
    assert cv.clip_to_polygon(pixels, edges, band=2.0).count() == 64 - 4


def test_landcover_shares_sum_to_100(spark):
    areas = spark.createDataFrame([(1, 8, 8), (2, 4, 4)], "aoi int, height int, width int")
    grid = spark.range(80).selectExpr("1 aoi", "cast(id div 8 as int) row", "cast(id % 8 as int) col")  # two rows lie outside
    cmap = grid.withColumn("code", F.expr("case when row < 4 then 50 when row < 6 then 10 when row < 7 then 95 else 80 end"))
    rows = cv.landcover_composition(cmap, areas).collect()
    assert abs(sum(r.percent for r in rows) - 100) < 0.05 and len(rows) == 7
    assert next(r.percent for r in rows if r.label == "Built-up") == 57.14 and rows[0].mostly_built


def test_cover_totals_come_from_the_grid(spark):
    areas = spark.createDataFrame([(1, 2, 3), (2, 4, 4)], "aoi int, height int, width int")
    composite = spark.createDataFrame([(1, 0, 0, 100.0, 300.0), (1, 1, 2, 300.0, 100.0), (1, 0, 1, None, 5.0), (1, 9, 9, 1.0, 9.0)],
                                      "aoi int, row int, col int, red double, nir double")
    got = {r.aoi: r for r in cv.vegetation_cover(composite, areas).collect()}
    assert (got[1].pixels, got[1].cover_m2, got[1].total_m2) == (2, 100.0, 600.0)
    assert (got[2].pixels, got[2].cover_m2, got[2].total_m2, got[2].percentage_coverage) == (0, 0.0, 1600.0, 0.0)


def test_medians_of_small_and_crowded_groups(spark):
    rows = [(k, c, v) for k, c, v in [
        ("a", 1, 3), ("a", 1, 8), ("a", 1, 3), ("a", 1, None), ("b", None, 2), ("b", None, 5), (None, 1, 7), (None, 1, 7), ("c", 1, None), ("d", 2, 4)]]
    rows += [("e", i % 3, i * i % 101) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, c int, v int").withColumn("w", F.col("v") / -10.0)
    wanted = sorted(map(repr, df.groupBy("k", "c").agg(F.median("v").alias("v"), F.median("w").alias("w")).collect()))
    for many in (100_000, 5, 0):
        got = medians(df, ["k", "c"], ["v", "w"], many)
        assert sorted(map(repr, got.collect())) == wanted and got.schema["v"].dataType.typeName() == "double"


def test_medians_sort_each_row_once(spark):
    df = spark.range(2_000).selectExpr("id % 97 k", "id % 5 c", "cast(id * id % 101 as int) v")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = medians(df, ["k", "c"], ["v"]).join(medians(df.where("v > 9"), ["k", "c"], ["v"]).withColumnRenamed("v", "w"), ["k", "c"])
        assert joined.where("w >= v").count() == joined.count() == 97 * 5
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    plan = plan.split("Initial Plan")[0]
    assert "collect_list" in plan and "partial_collect_list" not in plan
    assert plan.count("SortMergeJoin") == 1 and plan.count(" Sort ") == 2


def test_counted_pixels_group_by_one_number(spark):
    rows = [(p, (i * 7) % 4, i % 3, (i // 3) % 4, (i * 5) % 4, (i // 2) % 3, i % 4, None if i % 5 == 0 else i % 6 / 8, i % 4 / 8, 2.0) for i in range(300) for p in (0, 1)]
    pixels = spark.createDataFrame(rows, f"pair_id int, {', '.join(f'{c} int' for c in ch.CODES)}, ndvi_before double, ndvi_after double, area_m2 double")
    counted = ch.counted_pixels(pixels)
    codes = pixels.groupBy("pair_id", *ch.CODES).agg(F.count(F.lit(1)).alias("n"), F.sum("area_m2").alias("area_m2"))
    assert sorted(map(repr, ch.threshold_counts(counted).collect())) == sorted(map(repr, codes.collect()))
    for date in ch.DATES:
        values = pixels.groupBy("pair_id", F.col(f"ndvi_{date}").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        got = counted.where(F.col("kind") == date)
        assert sorted(map(repr, got.select("pair_id", "value", "n").collect())) == sorted(map(repr, values.collect()))
        assert got.where(F.coalesce(*ch.CODES, "area_m2").isNotNull()).count() == 0
    grouped = counted._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[1].split("]")[0]
    assert len(grouped.split(",")) == 3


def _small_tables(spark, folder):
    """Some 40 pixels a pair with one to five observations, some without a date or a value, over both dates."""
    items = spark.range(2_000).selectExpr(
        "if(id % 97 = 0, null, id * 7 % 160 + if(id % 5 = 0, 256, 0)) l_orderkey", "id % 4 l_suppkey", "if(id % 31 = 0, null, cast(id * id % 50 + 1 as double)) l_quantity",
        "cast(id % 11 / 100 as double) l_discount", "if(id % 41 = 0, null, timestamp_seconds(800000000L + id * id % 400 * 864000)) l_shipdate")
    items.write.parquet(f"{folder}/lineitem.parquet")
    spark.range(50).selectExpr("if(id = 9, null, id) o_orderkey").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_pixels_of_dates_equal_dated_pixels(spark, tmp_path):
    sf = _small_tables(spark, tmp_path)
    both = d.pixels_of_dates(spark, sf).persist()
    try:
        for late in (False, True):
            got, wanted = d.one_date(both, late), d.dated_pixels(spark, sf, late)
            assert got.columns == wanted.columns and wanted.count() > 100
            assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
        joined = d.one_date(both, False).hint("merge").join(d.one_date(both, True), list(ch.KEY))
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        both.unpersist()


def _leaves(plan):
    leaves = plan.collectLeaves()
    return [leaves.apply(i) for i in range(leaves.size())]


@pytest.mark.parametrize("query", [answers.built_up_verdict, answers.asked_answers])
def test_rules_and_model_read_the_same_pixels(spark, tmp_path, query):
    sf = _small_tables(spark, tmp_path)
    df = query(spark, sf)
    read = [x for x in _leaves(df._jdf.queryExecution().optimizedPlan()) if x.nodeName() != "InMemoryRelation"]
    assert read and not any("l_quantity" in x.toString() for x in read)
    if query is answers.built_up_verdict:
        rows = {r.pair_id: r for r in df.collect()}
        assert set(rows) == {0, 1, 2, 3}
        for late, name in ((False, "score_before"), (True, "score_after")):
            for r in d.dated_pixels(spark, sf, late).groupBy("pair_id").agg(F.avg("red").alias("red")).where("pair_id is not null").collect():
                assert abs(rows[r.pair_id][name] - r.red / 1000) < 1e-4
    spark.catalog.clearCache()


def test_roles_are_compared_per_pair(spark, tmp_path):
    profile = ch.pair_profile(d.pair_catalogue(spark, _small_tables(spark, tmp_path))).where("comparable")
    assert profile.count() == 5
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan[plan.index("Aggregate"):]
