import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import display as dp
from pixelloom.operators import regrid as rg
from pixelloom.operators import windows as wn
from pixelloom.operators.ordered import exact_percentiles, running_totals


def image(spark, values, name="i"):
    h, w = values.shape
    rows = [(name, r, c, None if np.isnan(values[r, c]) else float(values[r, c])) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "image_id string, row int, col int, v double")


def array(df, h, w, value="v"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r[value] is None else r[value]
    return out


def dims(spark, h, w, name="i"):
    return spark.createDataFrame([(name, h, w)], "image_id string, height int, width int")


def test_downsample_and_grid(spark):
    v = np.arange(64.0).reshape(8, 8)
    grid = rg.grid_for(dims(spark, 8, 8), 4)
    got = array(rg.regrid(image(spark, v), grid, ["v"]), 4, 4)
    assert got[0, 0] == 4.5 and np.allclose(got, v.reshape(4, 2, 4, 2).mean(axis=(1, 3)))


def test_fractional_average_keeps_the_mean(spark):
    v = np.random.default_rng(1).uniform(0, 10, (9, 7))
    got = array(rg.regrid(image(spark, v), rg.grid_for(dims(spark, 9, 7), 5), ["v"]), 5, 4)
    sx, sy = 7 / 4, 9 / 5
    for r in range(5):
        for c in range(4):
            wy = np.clip(np.minimum(np.arange(1, 10), (r + 1) * sy) - np.maximum(np.arange(9), r * sy), 0, None)
            wx = np.clip(np.minimum(np.arange(1, 8), (c + 1) * sx) - np.maximum(np.arange(7), c * sx), 0, None)
            w = np.outer(wy, wx)
            assert abs(got[r, c] - (w * v).sum() / w.sum()) < 1e-9


def test_nodata_has_no_weight_and_offset_leaves_nulls(spark):
    v = np.ones((4, 4))
    v[0, 0] = np.nan
    got = array(rg.regrid(image(spark, v), rg.grid_for(dims(spark, 4, 4), 2), ["v"]), 2, 2)
    assert np.array_equal(got, np.ones((2, 2)))
    full = image(spark, np.ones((8, 8)))
    moved = dims(spark, 8, 8).selectExpr("image_id", "1D sx", "4D ox", "1D sy", "0D oy", "8 out_width", "8 out_height")
    aligned = array(rg.align(full, full, moved, ["v"]), 8, 8)
    assert np.isnan(aligned[:, :4]).all() and (aligned[:, 4:] == 1).all()


def test_nearest(spark):
    v = np.arange(35.0).reshape(5, 7)
    images = dims(spark, 5, 7).selectExpr("*", "13 out_width", "3 out_height")
    got = array(rg.resize_nearest(image(spark, v), images, ["v"]), 3, 13)
    rows = np.minimum((np.arange(3) + 0.5) * 5 / 3, 4).astype(int)
    cols = np.minimum((np.arange(13) + 0.5) * 7 / 13, 6).astype(int)
    assert np.array_equal(got, v[rows][:, cols])


@pytest.mark.parametrize("h,w", [(3, 5), (1, 4), (12, 12)])
def test_reflect_pad(spark, h, w):
    v = np.arange(float(h * w)).reshape(h, w)
    size = 10
    got = array(rg.reflect_pad(image(spark, v), dims(spark, h, w), size), max(h, size), max(w, size))
    want = np.pad(v, ((0, max(0, size - h)), (0, max(0, size - w))), mode="reflect")
    assert np.array_equal(got, want)


def test_augment_is_a_symmetry(spark):
    v = np.arange(16.0).reshape(4, 4)
    got = array(rg.augment(image(spark, v), 4, seed=3), 4, 4)
    options = [np.rot90(f, k) for f in (v, v[:, ::-1], v[::-1], v[::-1, ::-1]) for k in range(4)]
    assert any(np.array_equal(got, o) for o in options)


@pytest.mark.parametrize("h,w,size,stride", [(37, 20, 8, 4), (16, 16, 8, 4), (9, 30, 8, 3), (5, 11, 8, 4)])
def test_windows_and_score_map(spark, h, w, size, stride):
    def starts(n):
        if n <= size:
            return [0]
        s = list(range(0, n - size + 1, stride))
        return s if s[-1] == n - size else [*s, n - size]

    images = dims(spark, h, w)
    got = {(r.win_row, r.win_col) for r in wn.windows(images, size, stride).collect()}
    assert got == {(r, c) for r in starts(h) for c in starts(w)}
    pixels = image(spark, np.zeros((h, w)))
    covered = wn.window_pixels(pixels, images, size, stride).groupBy("win_row", "win_col").count().collect()
    assert {(r.win_row, r.win_col, r["count"]) for r in covered} == {
        (r, c, min(size, h) * min(size, w)) for r, c in got}
    rng = np.random.default_rng(0)
    rows = [("i", r, c, float(rng.uniform()), float(rng.uniform())) for r, c in sorted(got)]
    scores = spark.createDataFrame(rows, "image_id string, win_row int, win_col int, a double, b double")
    want = np.zeros((h, w))
    for _, r, c, a, b in rows:
        want[r:r + size, c:c + size] = np.maximum(want[r:r + size, c:c + size], max(a, b))
    assert np.array_equal(array(wn.score_map(scores, images, ["a", "b"], size, stride), h, w, "score"), want)
    assert abs(wn.scene_score(scores, ["a", "b"]).first().score - np.mean([max(a, b) for *_, a, b in rows])) < 1e-12


def test_window_scorer_sees_the_patch(spark):
    v = np.arange(35.0).reshape(5, 7)

    def scorer(batch):
        return np.stack([batch[:, 0, 0, 0], batch[:, 0].sum(axis=(1, 2))], axis=1)

    got = wn.score_windows(image(spark, v), dims(spark, 5, 7), scorer, ["first", "total"], ["v"], size=4, stride=2).collect()
    for r in got:
        patch = v[r.win_row:r.win_row + 4, r.win_col:r.win_col + 4]
        assert r["first"] == patch[0, 0] and r.total == patch.sum()
    small = wn.score_windows(image(spark, v[:2, :3]), dims(spark, 2, 3), scorer, ["first", "total"], ["v"], size=4, stride=2).first()
    assert small.total == np.pad(v[:2, :3], ((0, 2), (0, 1)), mode="reflect").sum()


@pytest.mark.parametrize("h,w,size,stride,tile", [(41, 30, 8, 4, 8), (41, 30, 8, 3, 13), (9, 50, 8, 8, 16), (6, 20, 8, 4, 8)])
def test_tiles_give_the_scorer_whole_windows_in_batches(spark, tmp_path, h, w, size, stride, tile):
    rng = np.random.default_rng(h * w + tile)
    images = {"i": rng.uniform(0, 100, (2, h, w)), "j": rng.uniform(0, 100, (2, w, h))}
    images["i"][0, 3, 4] = np.nan
    rows = [(k, r, c, *[None if np.isnan(v[b, r, c]) else float(v[b, r, c]) for b in range(2)])
            for k, v in images.items() for r in range(v.shape[1]) for c in range(v.shape[2])]
    pixels = spark.createDataFrame(rows, "image_id string, row int, col int, v double, u double").repartition(5)
    sizes = spark.createDataFrame([(k, *v.shape[1:]) for k, v in images.items()], "image_id string, height int, width int")
    weights = rng.uniform(-1, 1, (2, size, size)).astype("float32")
    log = str(tmp_path)

    def scorer(batch):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}-{len(batch)}", "w"):
            pass
        return np.stack([(batch.astype("float64") * weights).sum(axis=(1, 2, 3)), batch[:, 0, 0, 0]], axis=1)

    got = {(r.image_id, r.win_row, r.win_col): (r.a, r.b) for r in wn.score_windows(
        pixels, sizes, scorer, ["a", "b"], ["v", "u"], [50, 40], [10, 20], size, stride, 16, tile).collect()}
    want = {}
    for k, v in images.items():
        scaled = np.nan_to_num((v - np.array([50, 40])[:, None, None]) / np.array([10, 20])[:, None, None]).astype("float32")
        scaled = np.pad(scaled, ((0, 0), *[(0, max(0, size - n)) for n in v.shape[1:]]), mode="reflect")
        ends = [sorted({*range(0, n - size + 1, stride), n - size}) for n in scaled.shape[1:]]
        for r in ends[0]:
            for c in ends[1]:
                patch = scaled[:, r:r + size, c:c + size]
                want[(k, r, c)] = (float((patch.astype("float64") * weights).sum()), float(patch[0, 0, 0]))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)
    calls = [int(f.name.rpartition("-")[2]) for f in tmp_path.iterdir()]
    assert sum(calls) == len(want) and max(calls) <= 16
    assert len(calls) <= len(want) // 16 + 8  # full batches but for the last of a task


@pytest.mark.parametrize("bins", [(1 << 12,), (4, 64, 1 << 17)])
def test_percentiles_equal_numpy(spark, bins):
    rng = np.random.default_rng(5)
    frames = []
    for key, values in (("normal", rng.normal(0, 1, 500)), ("ties", rng.integers(0, 3, 400).astype(float)), ("one", np.array([7.5])),
                        ("hot", np.concatenate([np.full(900, 0.25), rng.uniform(-1, 1, 100)])), ("wide", 10 ** rng.uniform(-8, 8, 300))):
        frames.append(pd.DataFrame({"k": key, "v": values, "w": -values}))
    pdf = pd.concat(frames)
    probs = {"p02": 0.02, "p50": 0.5, "p90": 0.9, "p98": 0.98, "top": 1.0}
    got = exact_percentiles(spark.createDataFrame(pdf), ["k"], ["v", "w"], probs, bins).toPandas().set_index("k")
    for key, part in pdf.groupby("k"):
        for column in ("v", "w"):
            for name, p in probs.items():
                want = np.percentile(part[column], p * 100)
                assert abs(got.loc[key, f"{column}_{name}"] - want) <= 1e-9 * max(1, abs(want))


def test_running_totals(spark):
    pdf = pd.DataFrame({"k": [i % 2 for i in range(200)], "o": range(200), "n": [(i * 7) % 5 for i in range(200)]})
    df = spark.createDataFrame(pdf).withColumn("b", F.floor(F.col("o") / 13))
    got = running_totals(df, ["k"], "b", [F.col("o")], {"t": "n"}).toPandas().sort_values("o")
    assert (got["t"].to_numpy() == pdf.groupby("k")["n"].cumsum().to_numpy()).all()


def test_stretch_and_overlay(spark):
    v = np.random.default_rng(2).uniform(100, 200, (10, 10))
    got = array(dp.stretch(image(spark, v), ["v"]), 10, 10)
    lo, hi = np.percentile(v, [2, 98])
    assert np.array_equal(got, np.round(np.clip((v - lo) / (hi - lo), 0, 1) * 255))
    df = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False)], "i int, a boolean, b boolean")
    rows = {r.i: (r.r, r.g, r["b"], r.a) for r in dp.overlay(df.select("i", F.col("a").alias("m"), F.col("b").alias("n")), [
        ("m", "#010203", 9), ("n", "#0a0b0c", 8)]).collect()}
    assert rows == {1: (1, 2, 3, 9), 2: (10, 11, 12, 8), 3: (0, 0, 0, 0)}


def test_enlarging_is_dealt_out_by_the_size_of_the_target(spark, monkeypatch):
    pixels = spark.createDataFrame([("a", r, c, float(r * 31 + c * 7 % 13) if (r + c) % 5 else None) for r in range(20) for c in range(24)]
                                   + [("b", 0, 0, 1.0), ("b", None, 0, 2.0)], "image_id string, row int, col int, v double")
    images = spark.createDataFrame([("a", 1.5, 0.0, 1.5, 0.0, 36, 30), ("b", 1.5, 0.0, 1.5, 0.0, 1, 1), ("c", 1.5, 0.0, 1.5, 0.0, None, 1)],
                                   "image_id string, sx double, ox double, sy double, oy double, out_width int, out_height int")

    def run():
        df = rg.regrid(pixels, images, ["v"], "bilinear")
        return df, {(r.image_id, r.row, r.col): r.v for r in df.collect()}

    _, whole = run()
    monkeypatch.setattr(rg, "CELLS", 100)
    monkeypatch.setattr(rg, "BLOCK", 4)
    df, parts = run()
    assert len(whole) == 36 * 30 + 1 and whole.keys() == parts.keys()
    assert all(abs(whole[k] - parts[k]) < 1e-9 if whole[k] is not None else parts[k] is None for k in whole)
    assert ", 11" in [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x][0]
