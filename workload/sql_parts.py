"""Pieces of SQL text shared by the checks: rounding and the derived inputs as CTEs."""

from __future__ import annotations


def rnd(x: str, digits: int = 2) -> str:
    """Round half to even on the exact binary value: split the product and settle ties by its error."""
    s = f"{10**digits}::DOUBLE"
    return (f"(SELECT CASE WHEN v < 0 THEN -r ELSE r END FROM (SELECT v, (CASE WHEN o > 0 OR (o = 0 AND e > 0) "
            f"OR (o = 0 AND e = 0 AND w % 2 = 1) THEN w + 1 ELSE w END) / {s} r FROM ("
            f"SELECT v, w, (p - w) - 0.5::DOUBLE o, e FROM (SELECT v, p, floor(p) w, (h * {s} - p) + (x - h) * {s} e FROM ("
            f"SELECT v, x, x * {s} p, x * 134217729::DOUBLE - (x * 134217729::DOUBLE - x) h FROM ("
            f"SELECT v, abs(v) x FROM (SELECT ({x})::DOUBLE v)))))))")


def pct(part: str, total: str, digits: int = 2) -> str:
    return rnd(f"100.0::DOUBLE * ({part}) / nullif({total}, 0)", digits)


def share(part: str, total: str, digits: int = 2) -> str:
    return rnd(f"(({part})::DOUBLE / nullif({total}, 0)) * 100.0::DOUBLE", digits)


def whole_mean(x: str, digits: int = 4) -> str:
    """The mean of values with so many decimals, added as whole numbers."""
    return f"sum(round(({x}) * {10**digits})::BIGINT) / (count({x}) * {10**digits})::DOUBLE"


def nd(a: str, b: str) -> str:
    return f"((({a})::DOUBLE - ({b})::DOUBLE) / nullif(({a})::DOUBLE + ({b})::DOUBLE, 0))"


BANDS = """500 + j AS blue,
  (CASE lc WHEN 0 THEN 1000 WHEN 1 THEN 600 WHEN 2 THEN 800 ELSE 800 END) + j AS green,
  (CASE lc WHEN 0 THEN 300 WHEN 1 THEN 400 WHEN 2 THEN 900 ELSE 900 END) + j AS red,
  (CASE lc WHEN 0 THEN 200 WHEN 1 THEN 3000 WHEN 2 THEN 1000 ELSE 1500 END) + 2 * j AS nir,
  (CASE lc WHEN 0 THEN 100 WHEN 1 THEN 1500 WHEN 2 THEN 1400 ELSE 1450 END) + 3 * j AS swir1,
  (CASE lc WHEN 0 THEN -23 WHEN 1 THEN -13 WHEN 2 THEN -3 ELSE -10 END)::DOUBLE + (j - 25)::DOUBLE / 10::DOUBLE AS vv_db"""


def obs(flooded: bool = False) -> str:
    extra = ("WHEN base = 3 AND ts >= TIMESTAMP '2001-07-01' AND (\"row\" + col) % 3 = 0 THEN 0 " if flooded else "")
    return f"""o1 AS (SELECT (l_suppkey % 4)::INT aoi, (l_orderkey % 16)::INT "row", ((l_orderkey // 16) % 16)::INT col,
  l_shipdate ts, (year(l_shipdate) * 100 + month(l_shipdate))::INT scene_id,
  round(100 * (1 - 10 * l_discount))::INT / 100::DOUBLE cs_cdf, l_quantity::INT j FROM lineitem),
o2 AS (SELECT *, (("row" // 4 + col // 4 + aoi) % 4)::INT base FROM o1),
o3 AS (SELECT *, CASE WHEN base = 1 AND year(ts) >= 1996 AND ("row" + col) % 3 = 0 THEN 2 {extra}ELSE base END lc FROM o2),
obs AS (SELECT *, {BANDS} FROM o3),
areas AS (SELECT aoi, max("row") + 1 height, max(col) + 1 width FROM obs GROUP BY aoi),
grid AS (SELECT aoi, "row"::INT "row", col::INT col, 100.0::DOUBLE area_m2 FROM
  (SELECT aoi, width, unnest(range(0, height)) "row" FROM areas), LATERAL (SELECT unnest(range(0, width)) col)),
cmap AS (SELECT aoi, "row", col, 100.0::DOUBLE area_m2, CASE max(base) WHEN 0 THEN CASE WHEN max(j) % 2 = 0 THEN 80 ELSE 90 END
  WHEN 1 THEN CASE WHEN max(j) % 3 = 0 THEN 10 ELSE 40 END WHEN 2 THEN 50
  ELSE CASE WHEN max(j) % 4 = 0 THEN 70 ELSE 60 END END code FROM obs GROUP BY aoi, "row", col)"""


WIDE = f"""w1 AS (SELECT (l_orderkey % 4)::INT pair_id, (l_orderkey // 256)::INT "row", ((l_orderkey // 4) % 64)::INT col,
  year(l_shipdate) >= 1998 late, l_quantity::INT j FROM lineitem),
w2 AS (SELECT *, (("row" // 4 + col // 4 + pair_id) % 4)::INT base FROM w1),
w3 AS (SELECT *, CASE WHEN base = 1 AND late AND ("row" + col) % 3 = 0 THEN 2
  WHEN base = 3 AND late AND ("row" * 2 + col) % 5 = 0 THEN 1 ELSE base END lc FROM w2),
w4 AS (SELECT *, {BANDS} FROM w3),
wide AS (SELECT * REPLACE (CASE WHEN pair_id = 2 AND late AND lc = 1 THEN nir // 2 ELSE nir END AS nir) FROM w4),
bef AS (SELECT pair_id, "row", col, median(blue)::DOUBLE blue, median(green)::DOUBLE green, median(red)::DOUBLE red,
  median(nir)::DOUBLE nir, median(swir1)::DOUBLE swir1 FROM wide WHERE NOT late GROUP BY ALL),
aft AS (SELECT pair_id, "row", col, median(blue)::DOUBLE blue, median(green)::DOUBLE green, median(red)::DOUBLE red,
  median(nir)::DOUBLE nir, CASE WHEN pair_id <> 3 THEN median(swir1)::DOUBLE END swir1 FROM wide WHERE late GROUP BY pair_id, "row", col),
r1 AS (SELECT pair_id, "row", col, median(vv_db)::DOUBLE db FROM wide GROUP BY ALL),
r2 AS (SELECT *, db + CASE WHEN ("row" * 7 + col * 3) % 11 = 0 THEN 9.0::DOUBLE WHEN ("row" * 5 + col) % 13 = 0 THEN -9.0::DOUBLE
  ELSE 0.0::DOUBLE END v FROM r1),
radar AS (SELECT pair_id, "row", col, CASE WHEN pair_id % 2 = 1 THEN pow(10.0::DOUBLE, v / 10.0::DOUBLE) ELSE v END v FROM r2)"""
