"""Overlap of polygons, as joins of edges.

A shape is an array of rings of points, the first ring its outline and the others holes, in either direction and closed
or not; a shape with several parts has several rows. Its points above a line are counted by its edges: every edge that runs over x
adds or takes away what lies below it. So the common area of two shapes is a sum over pairs of edges of the signed integral of the lower of
the two, exact for any outline, and needs only pairs that share an x. To keep these few, the common stretch of two shapes is cut
into as many strips as the finer of them has edges, and edges meet by strip.

Shapes meet by a pyramid of cells. A box belongs to the cells of its own size, at most four, and knows their ancestors on the levels
that the other side uses; two boxes that overlap share a cell that is one's own. No cell size is fixed.

Defined cases: a NULL shape, a ring of fewer than three points and a shape without area overlap with nothing; shapes that
only touch have no common area and make no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.session import stable

#: Levels of the pyramid: cells of 2^level a side.
LEVELS = (-16, 10)
#: Strips of a pair at most; above it edges meet more edges than they need to, and results stay exact.
STRIPS = 1 << 16


def edges(shapes: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """(key, lx, ly, rx, ry, sign): the edges of all shapes from left to right; ``sign`` is 1 where the inside is below."""
    each = shapes.select(key, F.posexplode(rings).alias("__ring", "__p")).where("size(__p) >= 3")
    each = each.withColumn("__e", F.expr(
        "transform(__p, (p, i) -> named_struct('x0', cast(p.x as double), 'y0', cast(p.y as double), "
        "'x1', cast(__p[(i + 1) % size(__p)].x as double), 'y1', cast(__p[(i + 1) % size(__p)].y as double)))"))
    twice = F.aggregate("__e", F.lit(0.0), lambda a, e: a + (e["x0"] - F.col("__e")[0]["x0"]) * (e["y1"] - F.col("__e")[0]["y0"])
                        - (e["x1"] - F.col("__e")[0]["x0"]) * (e["y0"] - F.col("__e")[0]["y0"]))
    turn = F.signum(twice) * F.when(F.col("__ring") == 0, 1).otherwise(-1)  # leftward edges of an outline run over the inside
    return each.select(key, turn.alias("__turn"), F.explode("__e").alias("e")).where("e.x0 <> e.x1 and __turn <> 0").selectExpr(
        key, "if(e.x0 < e.x1, e.x0, e.x1) lx", "if(e.x0 < e.x1, e.y0, e.y1) ly", "if(e.x0 < e.x1, e.x1, e.x0) rx",
        "if(e.x0 < e.x1, e.y1, e.y0) ry", "__turn * if(e.x1 < e.x0, 1, -1) sign")


def boxes(edge_rows: DataFrame, key: str) -> DataFrame:
    """(key, w, s, e, n, edges) of each shape."""
    return edge_rows.groupBy(key).agg(F.min("lx").alias("w"), F.min(F.least("ly", "ry")).alias("s"), F.max("rx").alias("e"),
                                      F.max(F.greatest("ly", "ry")).alias("n"), F.count(F.lit(1)).alias("edges"))


def _level(w: str, s: str, e: str, n: str) -> Column:
    side = F.greatest(F.col(e) - F.col(w), F.col(n) - F.col(s), F.lit(2.0 ** LEVELS[0]))
    return F.greatest(F.lit(LEVELS[0]), F.ceil(F.log2(side))).cast("int")


def box_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key) of all boxes (key, w, s, e, n) that overlap."""
    a, b = (df.select(k, "w", "s", "e", "n").withColumn("__level", _level("w", "s", "e", "n")) for df, k in ((left, left_key), (right, right_key)))
    levels = lambda df: sorted(r[0] for r in df.select("__level").distinct().collect())  # noqa: E731 - some thirty values at most
    a_levels, b_levels = levels(a), levels(b)

    def cells(df: DataFrame, others: list[int], name: str) -> DataFrame:
        known = F.array(*[F.lit(x) for x in others]).cast("array<int>")
        wanted = F.array_union(F.array("__level"), F.filter(known, lambda x: x > F.col("__level")))
        rows = df.withColumn("__at", F.explode(wanted))
        for axis, low, high in (("__x", "w", "e"), ("__y", "s", "n")):
            rows = rows.withColumn(axis, F.explode(F.expr(f"sequence(cast(floor({low} / pow(2D, __at)) as bigint), cast(floor({high} / pow(2D, __at)) as bigint))")))
        return rows.select("__at", "__x", "__y", F.struct(*df.columns).alias(name), (F.col("__at") == F.col("__level")).alias(f"{name}_own"))

    met = cells(a, b_levels, "__a").join(cells(b, a_levels, "__b"), ["__at", "__x", "__y"]).where("__a_own or __b_own")
    real = "greatest(__a.w, __b.w) < least(__a.e, __b.e) and greatest(__a.s, __b.s) < least(__a.n, __b.n)"
    return met.where(real).selectExpr(f"__a.{left_key} {left_key}", f"__b.{right_key} {right_key}").distinct()


def overlaps(left: DataFrame, right: DataFrame, left_key: str, right_key: str, rings: str = "rings") -> DataFrame:
    """(left_key, right_key, overlap): the common area of all shapes that have one."""
    a, b = edges(left, left_key, rings), edges(right, right_key, rings)
    a_box, b_box = stable(boxes(a, left_key)), stable(boxes(b, right_key))  # a row a shape, read several times
    pairs = stable(box_pairs(a_box, b_box, left_key, right_key))
    size = lambda df, k, name: df.select(k, F.struct("w", "s", "e", "n", "edges").alias(name))
    pairs = pairs.join(size(a_box, left_key, "__a"), left_key).join(size(b_box, right_key, "__b"), right_key).selectExpr(
        left_key, right_key, "greatest(__a.w, __b.w) __u0", "least(__a.e, __b.e) __u1", "__a.s __base",
        f"cast(least({STRIPS}, greatest(__a.edges, __b.edges)) as int) __strips")
    pairs = pairs.withColumn("__width", F.expr("(__u1 - __u0) / __strips"))

    def dealt(edge_rows: DataFrame, key: str, name: str) -> DataFrame:
        near = pairs.join(edge_rows.select(key, F.struct("lx", "ly", "rx", "ry", "sign").alias(name)), key).where(f"{name}.rx > __u0 and {name}.lx < __u1")
        first, last = f"cast(floor(({name}.lx - __u0) / __width) as int)", f"cast(floor(({name}.rx - __u0) / __width) as int)"
        return near.withColumn("__strip", F.expr(f"explode(sequence(greatest(0, {first}), least(__strips - 1, greatest(0, {last}))))"))

    # an edge below all of the left shape adds as much as it takes away
    b_rows = dealt(b, right_key, "__b").where("greatest(__b.ly, __b.ry) > __base").select(left_key, right_key, "__strip", "__b")
    met = dealt(a, left_key, "__a").join(b_rows, [left_key, right_key, "__strip"])
    met = met.withColumns({
        "__u": F.expr("greatest(__a.lx, __b.lx, __u0 + __strip * __width)"),
        "__v": F.expr("least(__a.rx, __b.rx, if(__strip = __strips - 1, __u1, __u0 + (__strip + 1) * __width))")}).where("__u < __v")
    at = lambda e, x: f"{e}.ly + ({e}.ry - {e}.ly) * (({x} - {e}.lx) / ({e}.rx - {e}.lx)) - __base"
    heights = met.selectExpr(left_key, right_key, "__a.sign * __b.sign __sign", "__v - __u __span", f"{at('__a', '__u')} __au", f"{at('__a', '__v')} __av",
                             f"{at('__b', '__u')} __bu", f"{at('__b', '__v')} __bv")
    # the lower of two lines is their mean less half their distance, which is a triangle on each side of where they cross
    gap = ("if((__au - __bu) * (__av - __bv) >= 0, (abs(__au - __bu) + abs(__av - __bv)) / 2, "
           "((__au - __bu) * (__au - __bu) + (__av - __bv) * (__av - __bv)) / (2 * (abs(__au - __bu) + abs(__av - __bv))))")
    lower = heights.selectExpr(left_key, right_key, f"__sign * __span * ((__au + __av + __bu + __bv) / 4 - {gap} / 2) __part")
    return lower.groupBy(left_key, right_key).agg(F.sum("__part").alias("overlap")).where("overlap > 1e-12")


def largest_shape_overlap(districts: DataFrame, states: DataFrame) -> DataFrame:
    """State of each district by largest common area of their shapes: ``(district_id, rings)`` and ``(state_id, rings)``.

    Ties, to nine digits, go to the lower state id. Returns district_id, state_id, overlap, candidates.
    """
    areas = overlaps(districts, states, "district_id", "state_id").withColumn("__r", F.round("overlap", 9))
    return areas.groupBy("district_id").agg(
        F.max_by("state_id", F.struct(F.col("__r"), -F.col("state_id"))).alias("state_id"), F.max("__r").alias("overlap"),
        F.count(F.lit(1)).alias("candidates"))
