import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.functions import geodesy as geo
from pixelloom.functions import indices as ix
from pixelloom.functions import wording as wd
from pixelloom.functions.semantics import finite, fixed_text, general_text, iso_date, rounded
from pixelloom.operators import composite as cp
from pixelloom.operators.areas import plain_name


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_rounding_equals_python(spark, seed):
    rng = random.Random(seed)
    values = [rng.uniform(-200, 200) for _ in range(150)] + [100.0 * rng.randrange(4000) / 4000 for _ in range(150)]
    values += [2.675, 3.125, 0.125, -0.125, 2.5, 1.005, 0.285, -2.675, 0.0]
    for digits in (0, 1, 2, 4):
        got = column(spark, values, "double", F.expr(rounded("v", digits)))
        assert got == [float(round(v, digits)) + 0.0 for v in values]


def test_number_text_equals_python(spark):
    values = [25.0, 0.0024, 0.6246, 2110.5051, 1234567.0, 14.79, 0.0001, 5e-05, 0.0, -3.25, 100000.0, None]
    assert column(spark, values, "double", F.expr(general_text("v"))) == [None if v is None else f"{v:g}" for v in values]
    assert column(spark, values, "double", F.expr(general_text("v", True))) == [None if v is None else f"{v:+g}" for v in values]
    assert column(spark, [0.125, 2.675, None], "double", F.expr(fixed_text("v", 2))) == ["0.12", "2.67", None]


def test_nulls_and_dates(spark):
    assert column(spark, [float("nan"), float("inf"), float("-inf"), 1.5], "double", finite(F.col("v"))) == [None, None, None, 1.5]
    days = column(spark, ["2021-02-05", "2021", "2021-2-5", "2021-02-30", " 2021-02-05 "], "string", iso_date(F.col("v")).cast("string"))
    assert days == ["2021-02-05", None, None, None, "2021-02-05"]


def test_indices_and_db(spark):
    df = spark.createDataFrame([(3.0, 1.0), (0.0, 0.0), (None, 1.0), (1.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(ix.normalized_difference(F.col("a"), F.col("b"))).collect()] == [0.5, None, None, -0.5]
    db = column(spark, [0.01, 0.1, 1.0, 0.0], "double", ix.db_from_linear(F.col("v")))
    assert [None if v is None else round(v, 9) for v in db] == [-20.0, -10.0, 0.0, None]
    assert column(spark, [0.99, 1.0, -1.0], "double", ix.direction(F.col("v"), 1.0)) == ["unchanged", "increased", "decreased"]
    assert column(spark, [0.06, 0.2], "double", ix.season_factor("v")) == [0.6, 0.0]


def test_display_rules(spark):
    assert column(spark, [0.0, 255.0, None], "double", F.round(ix.inverse_tone_map(F.col("v")), 3)) == [0.0, 12000.0, None]
    assert column(spark, [0.0, 1.0, None], "double", F.round(ix.db_for_display(F.col("v")), 6)) == [-60.0, 0.0, None]
    df = cp.as_stored(spark.createDataFrame([(2.5,), (-3.0,), (7e4,), (None,)], "v double"), ["v"])
    assert [r.v for r in df.collect()] == [2, 0, 65535, None]
    assert column(spark, [0.5, 5000.0, 20000.0], "double", ix.reflectance_scale(F.col("v"))) == [
        "reflectance 0-1", "reflectance x10000", "unknown"]
    assert column(spark, [0.05, 14.79, None], "double", F.expr(wd.area_text("v"))) == ["50,000 m²", "14.79 km²", None]
    assert column(spark, ["2021-02-05", "x"], "string", F.expr(wd.date_text("v"))) == ["5 Feb 2021", "x"]
    assert column(spark, [0.75, 0.4, 0.1, None], "double", wd.confidence_level("v")) == ["High", "Medium", "Low", "Not rated"]
    assert column(spark, ["low NDVI here", "an NDVIX", "Threshold!"], "string", wd.banned_terms(F.col("v"))) == [["NDVI"], [], ["threshold"]]


def test_zones_and_names(spark):
    df = spark.createDataFrame([(-47.9, -15.8), (77.6, 12.9), (180.0, 1.0)], "lon double, lat double")
    assert [r[0] for r in df.select(geo.utm_epsg(F.col("lon"), F.col("lat"))).collect()] == [32723, 32643, 32660]
    point = "array(named_struct('lon', -79.387139D, 'lat', 43.642567D))"
    east, north = spark.sql(f"select inline({geo.utm_forward(point, '17')})").first()
    assert abs(east - 630084.3) < 0.5 and abs(north - 4833438.6) < 0.5
    assert column(spark, ["Karnātaka", "  a  b ", None, "Ḏé"], "string", plain_name(F.col("v"))) == ["Karnataka", "a b", None, "De"]


def test_ten_metre_shape(spark):
    df = spark.createDataFrame([("metres", 5.0, 0.0), ("degrees", 0.0001, 60.0), ("pixels", 1.0, 0.0), ("metres", 0.01, 0.0)], "u string, r double, lat double")
    got = [(r[0], r[1]) for r in df.select(geo.ten_metre_side("300", "r", "u", "lat", True), geo.ten_metre_side("300", "r", "u", "lat", False)).collect()]
    assert got == [(150, 150), (round(300 * 0.0001 * 111320 * 0.5 / 10), round(300 * 0.0001 * 111320 / 10)), (300, 300), (1, 1)]


def test_export_grid_covers_the_box(spark):
    df = spark.sql("select named_struct('w', 77.6D, 's', 12.9D, 'e', 77.64D, 'n', 12.93D) box")
    g = geo.export_grid(df).select("grid.*").first()
    assert g.epsg == 32643 and g.xmin % 10 == 0 and g.ymax % 10 == 0
    assert 430 <= g.width <= 440 and 328 <= g.height <= 340
