"""Grid and map arithmetic: pixel areas, boxes, UTM, Web-Mercator tiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.semantics import holds, non_null, rounded

# Metres per degree and limits.
M_PER_DEG_LAT = 110574.0
M_PER_DEG_LON_EQUATOR = 111320.0
M_PER_DEG = 111320.0
KM_PER_DEG = 111.32
MAX_SIDE_KM = 10.0
SIDE_SLACK_KM = 0.05
EXPORT_SCALE_M = 10
TILE_MAX_LAT = 85.05
TILE_BLOCK_SIDE = 8
ALWAYS_AVAILABLE_LEVEL = 16
ZOOM_MAP_PX, ZOOM_MIN, ZOOM_MAX = 500, 5, 12


# ------------------------------------------------------------------------------ rasters

def grid_side(side: str, width: str = "width", height: str = "height", max_size: int = 1024) -> Column:
    """Pixels of one side of the grid downsampled to at most ``max_size`` on the long side."""
    scale = f"greatest(1D, greatest({width}, {height}) / {max_size}D)"
    return F.expr(f"greatest(1, cast({rounded(f'{side} / {scale}', 0)} as int))")


def pixel_area(units: Column, a: Column, e: Column, f: Column, row: Column) -> Column:
    """m2 of a pixel; NULL without a usable ground scale. Degrees: per row, by the cosine of its latitude."""
    latitude = f + (row + F.lit(0.5)) * e
    degrees = (F.abs(a) * M_PER_DEG_LON_EQUATOR * F.cos(F.radians(latitude))) * F.abs(e) * M_PER_DEG_LAT
    return F.when(units == "metres", F.abs(a * e)).when(units == "degrees", degrees)


def georeferenced(crs: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """A CRS is present and the transform is not the identity."""
    identity = (a == 1) & (b == 0) & (c == 0) & (d == 0) & (e == 1) & (f == 0)
    return crs.isNotNull() & ~identity


def units_of(crs: Column, geographic: Column, linear_unit: Column) -> Column:
    return (F.when(crs.isNull(), "pixels").when(geographic, "degrees")
            .when(linear_unit.isin("metre", "meter"), "metres")
            .otherwise(F.coalesce(linear_unit, F.lit("unknown"))))


def ten_metre_side(side: str, resolution: str, units: str, mid_lat: str, is_width: bool) -> Column:
    """Pixels of one side after resampling to 10 m; unchanged without a ground scale."""
    per_degree = f"{M_PER_DEG}D * cos(radians({mid_lat}))" if is_width else f"{M_PER_DEG}D"
    metres = f"case {units} when 'metres' then {resolution} when 'degrees' then {resolution} * {per_degree} end"
    # greatest() would skip the NULL of an unknown scale, so that case is told apart first
    scaled = f"greatest(1, cast({rounded(f'{side} * ({metres}) / 10D', 0)} as int))"
    return F.expr(f"if(({metres}) is null, cast({side} as int), {scaled})")


# ------------------------------------------------------------------------------ boxes

def intersection(a: Column, b: Column) -> Column:
    """Common box of two ``STRUCT<w, s, e, n>``; NULL when they only touch or are apart."""
    w, e = F.greatest(a.w, b.w), F.least(a.e, b.e)
    s, n = F.greatest(a.s, b.s), F.least(a.n, b.n)
    return F.when((w < e) & (s < n), F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n")))


def overlap_share(common: str, a: str, b: str) -> Column:
    """Common area as a share of the smaller box, 4 decimals; 0 when the smaller box is empty, NULL without one."""
    def area(box):
        return f"(({box}.e - {box}.w) * ({box}.n - {box}.s))"

    share = rounded(f"try_divide({area(common)}, least({area(a)}, {area(b)}))", 4)
    return F.expr(f"if({common} is null, null, coalesce({share}, 0D))")


def same_resolution(ax: Column, ay: Column, bx: Column, by: Column, tolerance: float = 1e-6) -> Column:
    def near(p, q):
        return F.abs(p - q) <= F.lit(tolerance) * F.greatest(F.abs(p), F.abs(q), F.lit(1e-12))

    return near(ax, bx) & near(ay, by)


def box_size_km(box: Column) -> tuple[Column, Column]:
    mid = F.radians((box.s + box.n) / 2)
    return ((box.e - box.w) * M_PER_DEG * F.cos(mid) / 1000.0, (box.n - box.s) * M_PER_DEG / 1000.0)


def box_problems(box: Column) -> Column:
    """Codes of what is wrong with a box: ``invalid_box`` or ``too_large``; empty when it is fine."""
    in_world = (holds((box.w >= -180) & (box.w < box.e) & (box.e <= 180))
                & holds((box.s >= -85) & (box.s < box.n) & (box.n <= 85)))
    width, height = box_size_km(box)
    limit = MAX_SIDE_KM + SIDE_SLACK_KM
    return non_null([
        F.when(~in_world, F.lit("invalid_box")),
        F.when(in_world & ((width > limit) | (height > limit)), F.lit("too_large"))])


def box_around(lat: Column, lon: Column, size_km: Column) -> Column:
    """Box of a given side around a point, 6 decimals (halves go up, as the map front end does)."""
    d_lat = size_km / 2 / KM_PER_DEG
    d_lon = size_km / 2 / (F.lit(KM_PER_DEG) * F.cos(F.radians(lat)))

    def six(v):
        return F.floor(v * 1e6 + 0.5).cast("double") / 1e6

    return F.struct(six(lon - d_lon).alias("w"), six(lat - d_lat).alias("s"),
                    six(lon + d_lon).alias("e"), six(lat + d_lat).alias("n"))


def zoom_for(box: Column) -> Column:
    """Map zoom at which the box fits the map."""
    extent = F.greatest((box.e - box.w) * F.cos(F.radians((box.s + box.n) / 2)), box.n - box.s, F.lit(1e-6))
    level = F.floor(F.log2(F.lit(float(ZOOM_MAP_PX * 360)) / (F.lit(256.0) * extent)))
    return F.greatest(F.lit(ZOOM_MIN), F.least(F.lit(ZOOM_MAX), level)).cast("int")


# ------------------------------------------------------------------------------ UTM

def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


@dataclass(frozen=True)
class _Ellipsoid:
    """WGS84 numbers of the Krüger series to the third power of n (sub-millimetre inside a zone)."""

    a: float = 6378137.0
    f: float = 1 / 298.257223563

    @property
    def n(self):
        return self.f / (2 - self.f)

    @property
    def radius(self):
        n = self.n
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def alpha(self):
        n = self.n
        return (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)


def utm_forward(points: str, zone: str) -> str:
    """SQL text: an array of ``struct(lon, lat)`` as an array of ``struct(east, north)`` in a UTM zone.

    The published Krüger series. One ``transform`` per step, so each step is computed once per point.
    """
    ell = _Ellipsoid()
    k = 2 * math.sqrt(ell.n) / (1 + ell.n)
    sines = (f"transform({points}, p -> named_struct('s', sin(radians(p.lat)), 'd', radians(p.lon - ({zone} * 6 - 183))))")
    conformal = f"transform({sines}, p -> named_struct('t', sinh(atanh(p.s) - {k!r}D * atanh({k!r}D * p.s)), 'd', p.d))"
    sphere = (f"transform({conformal}, p -> named_struct('x', atan2(p.t, cos(p.d)), 'y', atanh(sin(p.d) / sqrt(1 + p.t * p.t))))")
    east, north = "p.y", "p.x"
    for j, alpha in enumerate(ell.alpha, start=1):
        east += f" + {alpha!r}D * cos({2 * j} * p.x) * sinh({2 * j} * p.y)"
        north += f" + {alpha!r}D * sin({2 * j} * p.x) * cosh({2 * j} * p.y)"
    scale = f"{0.9996 * ell.radius!r}D"
    return f"transform({sphere}, p -> named_struct('east', 500000D + {scale} * ({east}), 'north', {scale} * ({north})))"


def export_grid(df: DataFrame, box: str = "box", scale: int = EXPORT_SCALE_M, points: int = 21) -> DataFrame:
    """Adds the ``grid`` that covers a box: its UTM extent, from points along its edges, snapped outward."""
    steps = f"transform(sequence(0, {points - 1}), i -> i / {points - 1}D)"
    lon, lat = f"{box}.w + ({box}.e - {box}.w) * t", f"{box}.s + ({box}.n - {box}.s) * t"
    sides = ", ".join(f"transform({steps}, t -> named_struct('lon', {x}, 'lat', {y}))" for x, y in (
        (lon, f"{box}.s"), (lon, f"{box}.n"), (f"{box}.w", lat), (f"{box}.e", lat)))
    middle = df.withColumns({"__lon": F.expr(f"({box}.w + {box}.e) / 2"), "__lat": F.expr(f"({box}.s + {box}.n) / 2")})
    zoned = middle.withColumns({"__zone": utm_zone(F.col("__lon")), "__epsg": utm_epsg(F.col("__lon"), F.col("__lat"))})
    drawn = zoned.withColumn("__edge", F.expr(utm_forward(f"concat({sides})", "__zone")))
    south = "if(__lat < 0, 10000000D, 0D)"
    extent = drawn.withColumns({
        name: F.expr(f"{snap}((array_{side}(__edge.{axis}) + {shift}) / {scale}) * {scale}")
        for name, snap, side, axis, shift in (
            ("__x0", "floor", "min", "east", "0D"), ("__x1", "ceil", "max", "east", "0D"),
            ("__y0", "floor", "min", "north", south), ("__y1", "ceil", "max", "north", south))})
    grid = (f"named_struct('epsg', __epsg, 'xmin', __x0, 'ymax', __y1, 'width', cast((__x1 - __x0) div {scale} as int), "
            f"'height', cast((__y1 - __y0) div {scale} as int))")
    return extent.select(*df.columns, F.expr(grid).alias("grid"))


# ------------------------------------------------------------------------------ tiles

def tile_xy(lat: Column, lon: Column, z: Column) -> tuple[Column, Column]:
    """Web-Mercator tile of a point."""
    n = F.pow(F.lit(2.0), z)
    x = F.floor((lon + 180) / 360 * n)
    phi = F.radians(F.greatest(F.lit(-TILE_MAX_LAT), F.least(F.lit(TILE_MAX_LAT), lat)))
    y = F.floor((F.lit(1.0) - F.asinh(F.tan(phi)) / F.lit(math.pi)) / 2 * n)
    last = n.cast("long") - 1
    return (F.greatest(F.lit(0), F.least(last, x)).cast("int"), F.greatest(F.lit(0), F.least(last, y)).cast("int"))


def tile_block(box: Column, z: Column, side: int = TILE_BLOCK_SIDE) -> Column:
    """Tiles that cover a box, at most ``side`` per direction around the centre. The limit is the feature."""
    x0, y0 = tile_xy(box.n, box.w, z)
    x1, y1 = tile_xy(box.s, box.e, z)
    w, h = x1 - x0 + 1, y1 - y0 + 1

    def shifted(start, count):
        return start + F.when(count > side, F.floor((count - side) / 2)).otherwise(0).cast("int")

    return F.struct(shifted(x0, w).alias("x"), shifted(y0, h).alias("y"),
                    F.least(w, F.lit(side)).alias("w"), F.least(h, F.lit(side)).alias("h"))
