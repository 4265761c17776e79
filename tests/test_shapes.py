import math
import random

import numpy as np
import pytest

from pixelloom.operators import areas, scoring, shapes
from pyspark.sql import functions as F

SCHEMA = "long, rings array<array<struct<x:double,y:double>>>"


def table(spark, key, rows):
    return spark.createDataFrame([(k, None if rings is None else [[tuple(map(float, p)) for p in r] for r in rings]) for k, rings in rows], f"{key} {SCHEMA}")


def inside(rings, x, y):
    """Even-odd test of points against all rings at once."""
    odd = np.zeros(x.shape, dtype=bool)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]]):
            if y0 != y1:
                odd ^= ((y0 > y) != (y1 > y)) & (x < x0 + (x1 - x0) * (y - y0) / (y1 - y0))
    return odd


def star(r, x, y, size, corners):
    angles = sorted(r.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + math.cos(a) * size * (q := r.uniform(0.4, 1)), y + math.sin(a) * size * q) for a in angles]


def found(spark, a, b):
    rows = shapes.overlaps(table(spark, "a", a), table(spark, "b", b), "a", "b").collect()
    return {(r.a, r.b): r.overlap for r in rows}


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


@pytest.mark.parametrize("turn", [False, True])
def test_known_areas(spark, turn):
    t = (lambda r: r[::-1]) if turn else (lambda r: r)
    a = [(1, [t(SQUARE)]), (2, [SQUARE, t([(1, 1), (2, 1), (2, 2), (1, 2)])]), (3, [[*t(SQUARE), t(SQUARE)[0]]]), (4, None), (5, [[(0, 0), (1, 1)]]),
         (6, [[(4, 0), (6, 0), (6, 4), (4, 4)]]), (7, [[(0, 0), (1, 0), (2, 0)]])]
    b = [(1, [[(2, 2), (6, 2), (6, 6), (2, 6)]]), (2, [[(0, 0), (4, 4), (0, 4)]]), (3, [[(-100, -50), (100, -50), (0, 400)]]), (4, [[(1.25, 1.25), (1.75, 1.25), (1.75, 1.75)]])]
    got = found(spark, a, b)
    want = {(1, 1): 4, (1, 2): 8, (1, 3): 16, (1, 4): 0.125, (2, 1): 4, (2, 2): 7.5, (2, 3): 15, (3, 1): 4, (3, 2): 8, (3, 3): 16, (3, 4): 0.125,
            (6, 1): 4, (6, 3): 8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_random_shapes_with_holes_and_parts(spark):
    r = random.Random(5)
    a, b = [], []
    for rows, n, size in ((a, 6, 1.5), (b, 4, 4.0)):
        for k in range(n):
            x, y = r.uniform(0, 6), r.uniform(0, 6)
            rows.append((k, [star(r, x, y, size, r.randrange(5, 40)), star(r, x, y, size * 0.1, 7)]))
    a.append((0, [star(r, 20, 20, 1, 9)]))
    b.append((1, [star(r, 20.5, 20, 2, 30)]))
    got = found(spark, a, b)
    step = 0.01
    gx, gy = np.meshgrid(np.arange(-6, 23, step) + step / 2, np.arange(-6, 23, step) + step / 2)
    cover = lambda rows, k: np.any([inside(rings, gx, gy) for i, rings in rows if i == k], axis=0)
    in_a, in_b = ({k: cover(rows, k) for k in {k for k, _ in rows}} for rows in (a, b))
    for i, p in in_a.items():
        for j, q in in_b.items():
            assert abs(got.get((i, j), 0) - (p & q).sum() * step * step) < 0.02, (i, j)


def test_boxes_of_any_size_meet_once(spark):
    r = random.Random(2)
    rows = []
    for k in range(300):
        size = 2 ** r.uniform(-12, 8)
        x, y = r.uniform(-170, 170), r.uniform(-80, 80)
        if k % 3:
            x, y = r.gauss(10, 0.01), r.gauss(20, 0.01)  # a busy spot
        rows.append((k, x, y, x + size, y + size * r.uniform(0.1, 1)))
    df = spark.createDataFrame(rows, "a int, w double, s double, e double, n double")
    pairs = shapes.box_pairs(df, df.withColumnRenamed("a", "b").where("b % 2 = 0"), "a", "b").collect()
    want = {(p[0], q[0]) for p in rows for q in rows if q[0] % 2 == 0 and max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4])}
    assert len(pairs) == len(want) and {tuple(x) for x in pairs} == want


def test_district_goes_to_the_largest_share_of_its_shape(spark):
    # the box of the angle lies mostly in state 2, its shape in state 1
    angle = [(0, 0), (1, 0), (1, 9), (10, 9), (10, 10), (0, 10)]
    states = table(spark, "state_id", [(1, [[(-5, -5), (2, -5), (2, 15), (-5, 15)]]), (2, [[(2, -5), (20, -5), (20, 15), (2, 15)]])])
    row = shapes.largest_shape_overlap(table(spark, "district_id", [(7, [angle])]), states).first()
    assert (row.state_id, row.overlap, row.candidates) == (1, 11.0, 2)
    named = table(spark, "district_id", [(7, [angle]), (8, [SQUARE])]).withColumn("name", F.concat(F.lit("d"), "district_id"))
    none = spark.createDataFrame([], "name string, state_id long")
    got = {r.name: r.state_id for r in areas.assign(named, states, spark.createDataFrame([("d8", 2)], "name string, state_id long"), none).collect()}
    assert got == {"d7": 1, "d8": 2}


def test_probe_equals_numpy_and_keeps_the_best_step(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (240, 6)).astype("float32")
    truth = rng.normal(0, 1, (6, 3))
    y = (x @ truth + rng.normal(0, 1, (240, 3))) > 0.5
    rows = [(i, x[i].tolist(), [c for c in range(3) if y[i, c]]) for i in range(240)]
    features = spark.createDataFrame(rows, "row_id long, vec array<float>, labels array<int>").repartition(5)
    probe = scoring.multilabel_probe(features, range(3), "row_id % 4 = 0", steps=6, rate=3.0, decay=0.05)
    fit, w, states = np.arange(240) % 4 != 0, np.zeros((3, 7)), []
    xb = np.concatenate([x.astype("float64"), np.ones((240, 1))], axis=1)
    for _ in range(6):
        p = 1 / (1 + np.exp(-xb @ w.T))
        w = w - 3.0 * ((p - y)[fit].T @ xb[fit] / fit.sum() + 0.05 * w)
        states.append(w)

    def micro(w):
        p, t = (1 / (1 + np.exp(-xb[~fit] @ w.T))).ravel(), y[~fit].ravel()
        t = t[np.argsort(-p, kind="stable")]
        return round(float((np.cumsum(t)[t] / (np.flatnonzero(t) + 1)).mean()), 4)

    history = [micro(s) for s in states]
    assert probe.history == history and probe.step == 1 + int(np.argmax(history))
    assert np.allclose(probe.weights, states[probe.step - 1], atol=1e-9)
    got = {(r.row_id, r.class_idx): (r.y, r.p) for r in probe.scores.collect()}
    assert got.keys() == {(i, c) for i in range(0, 240, 4) for c in range(3)}
    p = 1 / (1 + np.exp(-xb @ probe.weights.T))
    assert all(t == y[i, c] and abs(v - p[i, c]) < 1e-9 for (i, c), (t, v) in got.items())
