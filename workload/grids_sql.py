"""SQL checks of the grid, window, box and tile queries."""

from __future__ import annotations

from workload.imagery_sql import change_sql, fused_sql
from workload.sql_parts import WIDE, nd, rnd

SIZE, STRIDE = 16, 8

IMGS = """imgs AS (SELECT pair_id image_id, max("row") + 1 height, max(col) + 1 width FROM wide GROUP BY 1)"""


def _axis(name: str, source: str, s: str, o: str, size: str) -> str:
    """Overlap weight of each source row/column with each target cell, by brute force over all target cells."""
    return (f"""{name} AS (SELECT image_id, src, t, least((src + 1) * s + o, t + 1) - greatest(src * s + o, t) w FROM
  (SELECT DISTINCT b.pair_id image_id, b.{source} src, {s}::DOUBLE s, {o}::DOUBLE o, unnest(range(0, {size})) t
   FROM base b JOIN g ON g.image_id = b.pair_id) WHERE least((src + 1) * s + o, t + 1) - greatest(src * s + o, t) > 0)""")


def _windows(base: str = "bef") -> str:
    def starts(n):
        return (f"CASE WHEN {n} <= {SIZE} THEN [0] ELSE list_distinct(list_concat(range(0, {n} - {SIZE} + 1, {STRIDE}), "
                f"[{n} - {SIZE}])) END")
    return f"""{IMGS},
win AS (SELECT image_id, height, width, win_row, unnest({starts('width')}) win_col FROM
  (SELECT *, unnest({starts('height')}) win_row FROM imgs)),
gath AS (SELECT w.image_id, win_row, win_col, b.* FROM win w JOIN {base} b ON b.pair_id = w.image_id
  AND b."row" >= win_row AND b."row" < win_row + {SIZE} AND b.col >= win_col AND b.col < win_col + {SIZE}),
ws AS (SELECT image_id, win_row, win_col, avg((coalesce({nd('swir1', 'nir')} > 0, false))::INT::DOUBLE) u, avg((red > 925)::INT::DOUBLE) i
  FROM gath GROUP BY ALL)"""


BOX = """bx AS (SELECT o_orderkey box_id, (o_orderkey * 37 % 35800) / 100::DOUBLE - 179 w, (o_orderkey * 53 % 16000) / 100::DOUBLE - 80 s,
  o_custkey c FROM orders),
by_ AS (SELECT box_id, w, s, w + (1 + c % 12) / 100::DOUBLE e, s + (1 + c % 7) / 100::DOUBLE n,
  w + (c % 15 - 7) / 100::DOUBLE w2, s + (c % 11 - 5) / 100::DOUBLE s2, w + (c % 15 - 1) / 100::DOUBLE e2, s + (c % 11 + 1) / 100::DOUBLE n2 FROM bx)"""


def _tile(lat: str, lon: str, z: str) -> tuple[str, str]:
    n = f"pow(2::DOUBLE, {z})"
    x = f"floor(({lon} + 180) / 360 * {n})"
    y = f"floor((1 - asinh(tan(radians(greatest(-85.05::DOUBLE, least(85.05::DOUBLE, {lat}))))) / pi()) / 2 * {n})"
    return tuple(f"greatest(0, least({n} - 1, {v}))::INT" for v in (x, y))


_X, _Y = _tile("lat", "lon", "z")
_X0, _Y0 = _tile("n", "w", "z")
_X1, _Y1 = _tile("s", "e", "z")

# Overlay colours.
CHANGE_RGB = {0: (31, 111, 235), 1: (215, 58, 73), 2: (45, 164, 78), 3: (191, 135, 0)}


# WGS84 numbers of the Krüger series.
_N = 0.00335281066474748 / (2 - 0.00335281066474748)
_K = 2 * _N**0.5 / (1 + _N)
_M = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_A = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def _series(along: str, across: str) -> str:
    return " + ".join(f"{a!r}::DOUBLE * {along}({2 * j} * x) * {across}({2 * j} * y)" for j, a in enumerate(_A, 1))


def _stretch(b: str) -> str:
    hi = f"CASE WHEN {b}h <= {b}l THEN {b}l + 1 ELSE {b}h END"
    return f"round_even(greatest(0, least(1, ({b} - {b}l) / ({hi} - {b}l))) * 255, 0)::INT {b}"


ORACLE = {
    "downsample_avg": f"""WITH {WIDE}, {IMGS}, base AS (SELECT * FROM bef),
g AS (SELECT *, greatest(1, round_even(width / greatest(1, greatest(width, height) / 40::DOUBLE), 0))::INT ow,
  greatest(1, round_even(height / greatest(1, greatest(width, height) / 40::DOUBLE), 0))::INT oh FROM imgs),
{_axis('ax', 'col', '(g.ow / g.width::DOUBLE)', '0', 'g.ow')}, {_axis('ay', '"row"', '(g.oh / g.height::DOUBLE)', '0', 'g.oh')}
SELECT b.pair_id image_id, ay.t::INT AS "row", ax.t::INT col, (sum(ax.w * ay.w * red) / sum(ax.w * ay.w))::FLOAT::DOUBLE red,
  (sum(ax.w * ay.w * nir) / sum(ax.w * ay.w))::FLOAT::DOUBLE nir
FROM base b JOIN ax ON ax.image_id = b.pair_id AND ax.src = b.col JOIN ay ON ay.image_id = b.pair_id AND ay.src = b."row" GROUP BY ALL""",
    "upsample_bilinear": f"""WITH {WIDE}, {IMGS},
tc AS (SELECT image_id, unnest(range(0, (width * 1.5)::INT)) t FROM imgs),
tr AS (SELECT image_id, unnest(range(0, floor(height * 1.5)::INT)) t FROM imgs),
cx AS (SELECT tc.image_id, t, src, 1 - abs(t + 0.5::DOUBLE - (src + 0.5::DOUBLE) * 1.5) / 1.5 w FROM tc,
  LATERAL (SELECT unnest(range(greatest(0, (t / 1.5)::INT - 2), (t / 1.5)::INT + 3)) src) WHERE 1 - abs(t + 0.5::DOUBLE - (src + 0.5::DOUBLE) * 1.5) / 1.5 > 0),
cy AS (SELECT tr.image_id, t, src, 1 - abs(t + 0.5::DOUBLE - (src + 0.5::DOUBLE) * 1.5) / 1.5 w FROM tr,
  LATERAL (SELECT unnest(range(greatest(0, (t / 1.5)::INT - 2), (t / 1.5)::INT + 3)) src) WHERE 1 - abs(t + 0.5::DOUBLE - (src + 0.5::DOUBLE) * 1.5) / 1.5 > 0)
SELECT b.pair_id image_id, cy.t::INT AS "row", cx.t::INT col, (sum(cx.w * cy.w * nir) / sum(cx.w * cy.w))::FLOAT::DOUBLE nir
FROM bef b JOIN cx ON cx.image_id = b.pair_id AND cx.src = b.col JOIN cy ON cy.image_id = b.pair_id AND cy.src = b."row" GROUP BY ALL""",
    "regrid_offset": f"""WITH {WIDE}, {IMGS}, base AS (SELECT * FROM aft), g AS (SELECT * FROM imgs),
{_axis('ax', 'col', '0.75', '2.25', 'g.width')}, {_axis('ay', '"row"', '0.75', '-1.5', 'g.height')},
m AS (SELECT b.pair_id, ay.t AS "row", ax.t col, sum(ax.w * ay.w * green) / sum(ax.w * ay.w) green
  FROM base b JOIN ax ON ax.image_id = b.pair_id AND ax.src = b.col JOIN ay ON ay.image_id = b.pair_id AND ay.src = b."row" GROUP BY ALL)
SELECT f.pair_id image_id, f."row", f.col, (m.green)::FLOAT::DOUBLE green FROM bef f LEFT JOIN m USING (pair_id, "row", col)""",
    "nearest_resize": f"""WITH {WIDE}, {IMGS},
t AS (SELECT image_id, height, width, unnest(range(0, height * 3 // 4)) tr FROM imgs),
tt AS (SELECT *, unnest(range(0, width * 5 // 3)) tc FROM t)
SELECT image_id, tr::INT AS "row", tc::INT col, b.nir FROM tt JOIN bef b ON b.pair_id = image_id
  AND b."row" = floor(least((tr + 0.5::DOUBLE) * height / (height * 3 // 4), height - 1))
  AND b.col = floor(least((tc + 0.5::DOUBLE) * width / (width * 5 // 3), width - 1))""",
    "window_list": f"WITH {WIDE}, {_windows()} SELECT image_id, win_row::INT win_row, win_col::INT win_col FROM win",
    "scene_score": f"""WITH {WIDE}, {_windows()} SELECT image_id, (avg(greatest(u, i)))::FLOAT::DOUBLE score, count(*) windows FROM ws GROUP BY 1""",
    "score_map": f"""WITH {WIDE}, {_windows()},
px AS (SELECT image_id, "row", unnest(range(0, width)) col FROM (SELECT *, unnest(range(0, height)) "row" FROM imgs))
SELECT p.image_id, p."row"::INT AS "row", p.col::INT col, (max(greatest(u, i)))::FLOAT::DOUBLE score FROM px p JOIN ws w ON w.image_id = p.image_id
  AND p."row" >= win_row AND p."row" < win_row + {SIZE} AND p.col >= win_col AND p.col < win_col + {SIZE} GROUP BY ALL""",
    "patch_scores": f"""WITH {WIDE}, {_windows()}
SELECT image_id, win_row::INT win_row, win_col::INT win_col,
  (1 / (1 + exp(-sum(((blue - 500) / 50)::FLOAT::DOUBLE) / 256)))::FLOAT::DOUBLE low,
  (1 / (1 + exp(-sum(((nir - 1500) / 800)::FLOAT::DOUBLE) / 256)))::FLOAT::DOUBLE high FROM gath GROUP BY ALL""",
    "stretch_2_98": f"""WITH {WIDE}, l AS (SELECT pair_id, """ + ", ".join(
        f"quantile_cont({b}, 0.02) {b}l, quantile_cont({b}, 0.98) {b}h" for b in ("red", "green", "blue"))
    + f""" FROM bef GROUP BY 1) SELECT pair_id image_id, "row", col, {_stretch('red')}, {_stretch('green')}, {_stretch('blue')}
FROM bef JOIN l USING (pair_id)""",
    "reflectance_scale": f"""WITH {WIDE}, v AS (SELECT pair_id image_id, unnest([blue, green, red, nir]) x FROM bef),
p AS (SELECT image_id, quantile_cont(CASE image_id WHEN 1 THEN x / 10000 WHEN 2 THEN x * 5 ELSE x END, 0.99) p FROM v GROUP BY 1)
SELECT image_id, (p)::FLOAT::DOUBLE p99, CASE WHEN p > 0 AND p <= 2 THEN 'reflectance 0-1' WHEN p BETWEEN 100 AND 12000 THEN 'reflectance x10000' ELSE 'unknown' END input_scale,
  CASE WHEN p > 0 AND p <= 2 THEN 10000::DOUBLE ELSE 1::DOUBLE END factor FROM p""",
    "overlay_change": change_sql("SELECT pair_id, \"row\", col, ca after_code, " + ", ".join(
        f"CASE ca {' '.join(f'WHEN {k} THEN {v[i]}' for k, v in CHANGE_RGB.items())} END {ch}" for i, ch in enumerate("rgb"))
        + ", 170 a FROM runs WHERE main"),
    "overlay_fusion": fused_sql("and", """SELECT pair_id, "row", col,
  CASE WHEN wo AND ws THEN 31 WHEN wo THEN 121 WHEN ws THEN 163 ELSE 0 END r, CASE WHEN wo AND ws THEN 111 WHEN wo THEN 192 WHEN ws THEN 113 ELSE 0 END g,
  CASE WHEN wo AND ws THEN 235 WHEN wo THEN 255 WHEN ws THEN 247 ELSE 0 END b, CASE WHEN wo AND ws THEN 210 WHEN wo OR ws THEN 160 ELSE 0 END a FROM f"""),
    "box_overlap": f"""WITH {BOX}, i AS (SELECT *, greatest(w, w2) iw, greatest(s, s2) is_, least(e, e2) ie, least(n, n2) in_ FROM by_),
a AS (SELECT box_id, iw < ie AND is_ < in_ ov, (ie - iw) * (in_ - is_) ia, least((e - w) * (n - s), (e2 - w2) * (n2 - s2)) sm FROM i)
SELECT box_id, ov AS "overlaps", CASE WHEN ov THEN coalesce({rnd('ia / nullif(sm, 0)', 4)}, 0) END overlap_fraction FROM a""",
    "box_check": f"""WITH {BOX}, k AS (SELECT *, (e - w) * 111320::DOUBLE * cos(radians((s + n) / 2)) / 1000 wk, (n - s) * 111320::DOUBLE / 1000 hk FROM by_)
SELECT box_id, (wk)::FLOAT::DOUBLE width_km, (hk)::FLOAT::DOUBLE height_km, CASE WHEN NOT (w >= -180 AND w < e AND e <= 180 AND s >= -85 AND s < n AND n <= 85) THEN 'invalid_box'
  WHEN wk > 10.05::DOUBLE OR hk > 10.05::DOUBLE THEN 'too_large' ELSE '' END problems,
  greatest(5, least(12, floor(log2(500::DOUBLE * 360 / (256 * greatest((e - w) * cos(radians((s + n) / 2)), n - s, 1e-6))))))::INT zoom FROM k""",
    "utm_grid": f"""WITH {BOX} SELECT box_id, (CASE WHEN (s + n) / 2 >= 0 THEN 32600 ELSE 32700 END + least(60, floor(((w + e) / 2 + 180) / 6) + 1))::INT epsg,
  true has_pixels, true on_grid FROM by_""",
    "utm_extent": f"""WITH {BOX}, st AS (SELECT *, unnest(range(0, 21)) / 20::DOUBLE t FROM by_),
p AS (SELECT box_id, (w + e) / 2 ml, (s + n) / 2 mt, unnest([{{'x': w + (e - w) * t, 'y': s}}, {{'x': w + (e - w) * t, 'y': n}}, {{'x': w, 'y': s + (n - s) * t}}, {{'x': e, 'y': s + (n - s) * t}}]) q FROM st),
z AS (SELECT box_id, mt, least(60, floor((ml + 180) / 6) + 1)::INT zone, radians(q.y) f, radians(q.x - (least(60, floor((ml + 180) / 6) + 1) * 6 - 183)) d FROM p),
c AS (SELECT *, sinh(atanh(sin(f)) - {_K!r}::DOUBLE * atanh({_K!r}::DOUBLE * sin(f))) t FROM z),
h AS (SELECT *, atan2(t, cos(d)) x, atanh(sin(d) / sqrt(1 + t * t)) y FROM c),
u AS (SELECT box_id, zone, mt, 500000 + {_M!r}::DOUBLE * (y + {_series('cos', 'sinh')}) east,
  {_M!r}::DOUBLE * (x + {_series('sin', 'cosh')}) + CASE WHEN mt < 0 THEN 10000000 ELSE 0 END north FROM h),
g AS (SELECT box_id, any_value(CASE WHEN mt >= 0 THEN 32600 ELSE 32700 END + zone)::INT epsg, floor(min(east) / 10)::BIGINT * 10 x0, ceil(max(east) / 10)::BIGINT * 10 x1,
  floor(min(north) / 10)::BIGINT * 10 y0, ceil(max(north) / 10)::BIGINT * 10 y1 FROM u GROUP BY 1)
SELECT box_id, epsg, x0 xmin, y1 ymax, ((x1 - x0) // 10)::INT width, ((y1 - y0) // 10)::INT height FROM g""",
    "tile_xy": f"""SELECT c_custkey, z, {_X} x, {_Y} y FROM (SELECT c_custkey, (c_custkey * 71 % 18000) / 100::DOUBLE - 90 lat,
  (c_custkey * 131 % 36000) / 100::DOUBLE - 180 lon, (3 + c_custkey % 16)::INT z FROM customer)""",
    "tile_block": f"""WITH {BOX}, t AS (SELECT box_id, z, {_X0} x0, {_Y0} y0, {_X1} x1, {_Y1} y1 FROM (SELECT *, (8 + box_id % 10)::INT z FROM by_)),
c AS (SELECT *, x1 - x0 + 1 w, y1 - y0 + 1 h FROM t)
SELECT box_id, z, (x0 + CASE WHEN w > 8 THEN (w - 8) // 2 ELSE 0 END)::INT x, (y0 + CASE WHEN h > 8 THEN (h - 8) // 2 ELSE 0 END)::INT y,
  least(w, 8)::INT w, least(h, 8)::INT h FROM c""",
    "deepest_level": """WITH f AS (SELECT event_id // 6 view_id, (17 + event_id % 3)::INT z, bool_and(event_type <> 'error') ok FROM events GROUP BY ALL)
SELECT view_id, coalesce(max(z) FILTER (ok), 16)::INT AS "level" FROM f GROUP BY 1""",
    "box_around": """WITH p AS (SELECT c_custkey, (c_custkey * 71 % 16000) / 100::DOUBLE - 80 lat, (c_custkey * 131 % 36000) / 100::DOUBLE - 180 lon,
  (1 + c_custkey % 10)::DOUBLE km FROM customer), q AS (SELECT *, km / 2 / 111.32::DOUBLE dy, km / 2 / (111.32::DOUBLE * cos(radians(lat))) dx FROM p)
SELECT c_custkey, floor((lon - dx) * 1e6 + 0.5) / 1e6 w, floor((lat - dy) * 1e6 + 0.5) / 1e6 s, floor((lon + dx) * 1e6 + 0.5) / 1e6 e,
  floor((lat + dy) * 1e6 + 0.5) / 1e6 n FROM q""",
    "date_ranges": """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN year(o_orderdate)::VARCHAR
    WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y-%-m-%-d') ELSE strftime(o_orderdate, '%Y-%m-%d') END a,
  (o_orderdate + to_days((o_custkey % 90 - 10)::INT))::DATE e FROM orders),
p AS (SELECT o_orderkey, CASE WHEN regexp_full_match(a, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(a AS DATE) END s, e FROM t)
SELECT o_orderkey, CASE WHEN s IS NULL THEN 'unreadable' WHEN s >= e THEN 'order' WHEN s > DATE '2001-06-01' THEN 'future' ELSE 'ok' END status,
  CASE WHEN s < e THEN (s + ((e - s) // 2)::INT)::VARCHAR END mid_date FROM p""",
}


def _ten_metres() -> str:
    """Average where the image gets no more rows, else bilinear, by brute force over all target cells."""
    def weights(name: str, size: str, out: str) -> str:
        span = f"least((src + 1) * {out} / {size}::DOUBLE, t + 1) - greatest(src * {out} / {size}::DOUBLE, t)"
        tent = f"1 - abs(t + 0.5::DOUBLE - (src + 0.5::DOUBLE) * {out} / {size}::DOUBLE) / ({out} / {size}::DOUBLE)"
        return f"""{name} AS (SELECT image_id, src, t, w FROM (SELECT image_id, src, t, CASE WHEN oh <= height THEN {span} ELSE {tent} END w
  FROM (SELECT *, unnest(range(0, {out})) t FROM (SELECT *, unnest(range(0, {size})) src FROM g))) WHERE w > 0)"""

    def side(size: str, scale: str) -> str:
        grown = f"greatest(1, round_even({size} * {scale} / 10, 0))::INT"
        return f"CASE image_id WHEN 1 THEN {size} ELSE {grown} END"

    metres = "CASE image_id WHEN 0 THEN 5::DOUBLE WHEN 2 THEN 15::DOUBLE ELSE 0.00007::DOUBLE * 111320::DOUBLE{} END"
    return f"""WITH {WIDE}, {IMGS}, g AS (SELECT *, {side('width', metres.format(' * cos(radians(12.9::DOUBLE))'))} ow, {side('height', metres.format(''))} oh FROM imgs),
{weights('ax', 'width', 'ow')}, {weights('ay', 'height', 'oh')}
SELECT b.pair_id image_id, ay.t::INT AS "row", ax.t::INT col, (sum(ax.w * ay.w * red) / sum(ax.w * ay.w))::FLOAT::DOUBLE red,
  (sum(ax.w * ay.w * nir) / sum(ax.w * ay.w))::FLOAT::DOUBLE nir
FROM bef b JOIN ax ON ax.image_id = b.pair_id AND ax.src = b.col JOIN ay ON ay.image_id = b.pair_id AND ay.src = b."row" GROUP BY ALL"""


ORACLE["ten_metre_pixels"] = _ten_metres()
