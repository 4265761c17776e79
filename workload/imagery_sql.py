"""SQL checks of the scene-stack queries."""

from __future__ import annotations

from workload.sql_parts import WIDE, nd, obs, pct, rnd, share


def _cover(a: str, b: str, above: str, name: str) -> str:
    stats = ", ".join(f"{rnd(f'coalesce({s}_v, 0)', 3)} {s}_{name}, round(coalesce({s}_v, 0), 6) {s}_{name}_exact"
                      for s in ("mean", "min", "max"))
    return f"""WITH {obs()},
comp AS (SELECT aoi, "row", col, median({a})::DOUBLE a, median({b})::DOUBLE b FROM obs WHERE cs_cdf >= 0.6 GROUP BY ALL),
px AS (SELECT g.aoi, g.area_m2, {nd('a', 'b')} v FROM grid g LEFT JOIN comp USING (aoi, "row", col)),
s AS (SELECT aoi, count(v) pixels, sum(CASE WHEN v > {above} THEN area_m2 ELSE 0 END) cover_m2, sum(area_m2) total_m2,
  avg(v) mean_v, min(v) min_v, max(v) max_v FROM px GROUP BY aoi)
SELECT aoi, pixels, cover_m2, total_m2,
  CASE WHEN total_m2 / 10000 > 10000 THEN {rnd('cover_m2 / 1e6')} ELSE {rnd('cover_m2 / 1e4')} END area,
  CASE WHEN total_m2 / 10000 > 10000 THEN 'km²' ELSE 'ha' END area_unit,
  CASE WHEN total_m2 / 10000 > 10000 THEN {rnd('total_m2 / 1e6')} ELSE {rnd('total_m2 / 1e4')} END total_aoi,
  {share('cover_m2', 'total_m2')} percentage_coverage, {stats} FROM s"""


def _period(alias: str, start: str, end: str) -> str:
    return f"""{alias} AS (SELECT aoi, "row", col, {nd('median(green)', 'median(nir)')} > 0 wet FROM obs
  WHERE cs_cdf >= 0.6 AND ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{end}' GROUP BY aoi, "row", col)"""


CODES = {10: "Trees", 20: "Shrubland", 30: "Grassland", 40: "Cropland", 50: "Built-up", 60: "Bare", 80: "Water"}

ORACLE = {
    "veg_cover": _cover("nir", "red", "0.2::DOUBLE", "ndvi"),
    "water_cover": _cover("green", "nir", "0", "ndwi"),
    "flood_potential": f"""WITH {obs(True)}, {_period('cur', '2001-07-15', '2001-10-13')}, {_period('bas', '2000-10-13', '2001-10-13')},
f AS (SELECT c.aoi, c."row", c.col, c.wet AND NOT (b.wet OR m.code = 80) flood FROM cur c
  JOIN bas b USING (aoi, "row", col) JOIN cmap m USING (aoi, "row", col)),
s AS (SELECT g.aoi, sum(CASE WHEN flood THEN area_m2 ELSE 0 END) flood_m2, sum(area_m2) total_m2
  FROM grid g LEFT JOIN f USING (aoi, "row", col) GROUP BY g.aoi)
SELECT aoi, flood_m2, total_m2, {rnd('flood_m2 / 1e4')} area, 'ha' area_unit, {rnd('total_m2 / 1e4')} total_aoi,
  {share('flood_m2', 'total_m2')} percentage_coverage FROM s""",
    "landcover_composition": f"""WITH {obs()},
k(code, label) AS (VALUES {', '.join(f"({c}, '{n}')" for c, n in CODES.items())}),
s AS (SELECT aoi, code, sum(area_m2) m FROM cmap GROUP BY ALL),
f AS (SELECT a.aoi, k.code, k.label, coalesce(m, 0)::DOUBLE class_m2 FROM (SELECT DISTINCT aoi FROM grid) a, k
  LEFT JOIN s ON s.aoi = a.aoi AND s.code = k.code),
p AS (SELECT *, sum(class_m2) OVER (PARTITION BY aoi) t FROM f),
q AS (SELECT *, {share('class_m2', 't')} AS "percent" FROM p)
SELECT aoi, code, label, class_m2, "percent", max(CASE WHEN code = 50 THEN "percent" END) OVER (PARTITION BY aoi) > 50 mostly_built FROM q""",
    "s2_median": f"""WITH {obs()} SELECT aoi, "row", col, """ + ", ".join(
        f"round_even(least(greatest(median({b}), 0), 65535), 0)::INT {b}" for b in ("blue", "green", "red", "nir", "swir1"))
    + """ FROM obs WHERE cs_cdf >= 0.6 GROUP BY ALL""",
    "s1_median": f"""WITH {obs()} SELECT aoi, "row", col, round(median(vv_db), 6) vv_db FROM obs GROUP BY ALL""",
    "scene_counts": f"""WITH {obs()} SELECT aoi, count(DISTINCT scene_id) scenes FROM obs WHERE cs_cdf >= 0.6 GROUP BY aoi""",
    "cloud_semi_join": f"""WITH {obs()}, s AS (SELECT DISTINCT aoi, scene_id FROM obs)
SELECT aoi, count(*) scenes, max(scene_id) newest FROM s WHERE EXISTS (SELECT 1 FROM obs o WHERE o.aoi = s.aoi
  AND o.scene_id = s.scene_id AND o.ts < TIMESTAMP '2001-08-01') GROUP BY aoi""",
    "cloud_mask_join": f"""WITH {obs()},
c AS (SELECT aoi, scene_id, "row", col, max(cs_cdf) cs FROM obs WHERE ts < TIMESTAMP '2001-08-01' GROUP BY ALL),
p AS (SELECT aoi, scene_id, "row", col, avg(nir) nir FROM obs GROUP BY ALL)
SELECT aoi, scene_id, count(*) pixels, max(nir) max_nir FROM p JOIN c USING (aoi, scene_id, "row", col)
WHERE cs >= 0.6 GROUP BY ALL""",
    "radar_scene_filter": """SELECT year(o_orderdate)::INT AS "year", count(*) scenes, max(o_orderkey) last_scene FROM orders
WHERE o_orderstatus <> 'F' AND o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%'
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1""",
    "lookback_counts": f"""WITH {obs()},
y AS (SELECT * FROM obs WHERE cs_cdf >= 0.6 AND (aoi <> 3 OR ts < TIMESTAMP '2001-06-01')
  AND ts >= DATE '2001-11-01' - 365 AND ts < DATE '2001-11-01'),
z AS (SELECT *, max(ts) OVER (PARTITION BY aoi) >= DATE '2001-11-01' - 90 recent FROM y)
SELECT aoi, CASE WHEN recent THEN '90 days' ELSE '365 days' END period, count(*) observations, min(ts)::DATE first_day
FROM z WHERE NOT recent OR ts >= DATE '2001-11-01' - 90 GROUP BY ALL""",
}


def fused_sql(rule: str, tail: str | None = None) -> str:
    op = "AND" if rule == "and" else "OR"
    head = f"""WITH {WIDE},
low AS (SELECT pair_id, min(v) m FROM radar GROUP BY 1),
j AS (SELECT o.*, CASE WHEN m >= 0 THEN CASE WHEN v > 0 THEN 10.0::DOUBLE * log10(v) END ELSE v END db
  FROM aft o JOIN radar r USING (pair_id, "row", col) JOIN low USING (pair_id)),
v AS (SELECT pair_id, "row", col, coalesce(CASE WHEN pair_id <> 3 THEN {nd('green', 'swir1')} ELSE {nd('green', 'nir')} END > 0, false) wo,
  coalesce(CASE WHEN pair_id <> 3 THEN {nd('swir1', 'nir')} > 0 ELSE {nd('nir', 'red')} < 0.2::DOUBLE END, false) b0,
  db < -18 ws, db > -6 bs0,
  CASE pair_id WHEN 1 THEN (0.0001::DOUBLE * 111320::DOUBLE * cos(radians(12.9::DOUBLE + ("row" + 0.5::DOUBLE) * -0.0001::DOUBLE))) * 0.0001::DOUBLE * 110574::DOUBLE
    WHEN 2 THEN NULL ELSE 100.0::DOUBLE END area
  FROM j WHERE db IS NOT NULL AND green IS NOT NULL AND red IS NOT NULL AND nir IS NOT NULL AND (pair_id = 3 OR swir1 IS NOT NULL)),
f AS (SELECT *, wo {op} ws w, b0 AND NOT wo AND NOT (wo {op} ws) bo, bs0 AND NOT (wo {op} ws) bs FROM v)"""
    return f"""{head} {tail}""" if tail else f"""{head},
l AS (SELECT pair_id, area, 'water' AS class, w AS fin, wo o, ws s FROM f UNION ALL
  SELECT pair_id, area, 'built_up', bo {op} bs, bo, bs FROM f),
g AS (SELECT pair_id, class, count(*) n, sum(area) m, count(*) FILTER (fin) fin, sum(CASE WHEN fin THEN area WHEN area IS NOT NULL THEN 0 END) fm,
  count(*) FILTER (o) o, count(*) FILTER (s) s, count(*) FILTER (o AND s) b, count(*) FILTER (o AND NOT s) oo,
  count(*) FILTER (s AND NOT o) so FROM l GROUP BY ALL)
SELECT pair_id, class, n valid_pixels, {rnd('m / 1e6', 4)} valid_area_km2, {pct('fin', 'n')} AS "percent", fin pixels,
  {rnd('fm / 1e6', 4)} area_km2, {pct('b', 'n')} both_percent, {pct('oo', 'n')} optical_only_percent,
  {pct('so', 'n')} sar_only_percent, {pct('o', 'n')} optical_percent, {pct('s', 'n')} sar_percent,
  coalesce({rnd('b::DOUBLE / nullif(b + oo + so, 0)', 4)}, 1.0::DOUBLE) agreement FROM g"""


def change_sql(tail: str) -> str:
    """Full passes over the pixels, one per threshold run, where the Spark side counts combinations once."""
    def cls(d, w, v, b, n):
        return (f"CASE WHEN {d}w > {w} THEN 0 WHEN {d}v > {v} THEN 2 WHEN CASE WHEN swir THEN {d}b > {b} ELSE {d}v < {n} END "
                f"THEN 1 ELSE 3 END")
    side = ", ".join(
        f"{nd(f'{d}.nir', f'{d}.red')} {d}v, CASE WHEN b.pair_id <> 3 THEN {nd(f'{d}.green', f'{d}.swir1')} "
        f"ELSE {nd(f'{d}.green', f'{d}.nir')} END {d}w, CASE WHEN b.pair_id <> 3 THEN {nd(f'{d}.swir1', f'{d}.nir')} END {d}b"
        for d in ("b", "a"))
    return f"""WITH {WIDE},
px AS (SELECT b.pair_id, b."row", b.col, b.pair_id <> 3 swir, {side},
  CASE b.pair_id WHEN 1 THEN (0.0001::DOUBLE * 111320::DOUBLE * cos(radians(12.9::DOUBLE + (b."row" + 0.5::DOUBLE) * -0.0001::DOUBLE))) * 0.0001::DOUBLE * 110574::DOUBLE
    WHEN 2 THEN NULL ELSE 100.0::DOUBLE END area
  FROM bef b JOIN aft a USING (pair_id, "row", col)),
sh(i, w, v, c, n) AS (SELECT row_number() OVER () - 1, w, v, c, n FROM (VALUES (0::DOUBLE + -0.05::DOUBLE), (0::DOUBLE), (0.05::DOUBLE)) x(w),
  (VALUES (0.3::DOUBLE + -0.05::DOUBLE), (0.3::DOUBLE), (0.3::DOUBLE + 0.05::DOUBLE)) y(v),
  (VALUES (0::DOUBLE + -0.05::DOUBLE, 0.2::DOUBLE + -0.05::DOUBLE), (0::DOUBLE, 0.2::DOUBLE), (0.05::DOUBLE, 0.2::DOUBLE + 0.05::DOUBLE)) z(c, n)),
runs AS (SELECT pair_id, "row", col, i, w = 0 AND v = 0.3::DOUBLE AND c = 0 main, area, {cls('b', 'w', 'v', 'c', 'n')} cb, {cls('a', 'w', 'v', 'c', 'n')} ca FROM px, sh),
k(class_code, class) AS (VALUES (0, 'water'), (1, 'built_up'), (2, 'vegetation'), (3, 'other')),
g AS (SELECT pair_id, i, main, class_code, class, count(*) n, count(*) FILTER (cb = class_code) bn, count(*) FILTER (ca = class_code) an,
  sum(CASE WHEN cb = class_code THEN area WHEN area IS NOT NULL THEN 0 END) bm, sum(CASE WHEN ca = class_code THEN area WHEN area IS NOT NULL THEN 0 END) am
  FROM runs, k GROUP BY ALL),
h AS (SELECT *, {pct('bn', 'n')} bp, {pct('an', 'n')} ap, {rnd('bm / 1e6', 4)} bk, {rnd('am / 1e6', 4)} ak FROM g),
e AS (SELECT *, {rnd('ap - bp', 2)} dp, {rnd('ak - bk', 4)} dk FROM h),
q AS (SELECT *, CASE WHEN abs(dp) < 1 THEN 'unchanged' WHEN dp > 0 THEN 'increased' ELSE 'decreased' END direction FROM e),
classes AS (SELECT pair_id, class_code, class, n valid_pixels, bn before_pixels, an after_pixels, bp before_percent, ap after_percent,
  bk before_km2, ak after_km2, dp delta_pp, dk delta_km2, {rnd('100.0::DOUBLE * dp / nullif(bp, 0)', 1)} relative_change_percent, direction FROM q WHERE main),
robust AS (SELECT q.pair_id, q.class, {rnd('avg((q.direction = c.direction)::INT::DOUBLE)', 4)} robustness, count(*) runs
  FROM q JOIN classes c USING (pair_id, class) GROUP BY q.pair_id, q.class),
sp AS (SELECT pair_id, quantile_cont(bv, 0.9) pb, quantile_cont(av, 0.9) pa FROM px GROUP BY 1),
sg AS (SELECT pair_id, {rnd('pb', 4)} season_before, {rnd('pa', 4)} season_after, {rnd('abs(pa - pb)', 4)} season_gap FROM sp),
season AS (SELECT *, {rnd('greatest(0, 1 - season_gap / 0.15::DOUBLE)', 4)} season_factor FROM sg)
{tail}"""


ORACLE |= {
    "fusion_and": fused_sql("and"),
    "fusion_or": fused_sql("or"),
    "sar_db": f"""WITH {WIDE}, low AS (SELECT pair_id, min(v) >= 0 lin FROM radar GROUP BY 1),
m AS (SELECT pair_id, lin, median(CASE WHEN lin THEN CASE WHEN v > 0 THEN 10.0::DOUBLE * log10(v) END ELSE v END) md
  FROM radar JOIN low USING (pair_id) GROUP BY ALL)
SELECT pair_id, CASE WHEN pair_id = 2 THEN 'hh' ELSE 'vv' END sar_band, lin was_linear, round(md, 6) median_db,
  md BETWEEN -40 AND 10 sar_calibrated FROM m""",
    "change_classes": change_sql("SELECT * FROM classes"),
    "change_transitions": change_sql(f"""SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, cb, ca))::INT AS "rank",
  f.class from_class, t.class to_class, {pct('n', 'tot')} AS "percent", n pixels FROM
  (SELECT *, sum(n) OVER (PARTITION BY pair_id) tot FROM (SELECT pair_id, cb, ca, count(*) n FROM runs WHERE main GROUP BY ALL))
  JOIN k f ON f.class_code = cb JOIN k t ON t.class_code = ca WHERE cb <> ca"""),
    "change_robustness": change_sql("SELECT * FROM robust"),
    "change_summary": change_sql(f"""SELECT pair_id, 'OK' status, '' missing_bands,
  CASE WHEN pair_id = 3 THEN 'blue,green,nir,red' ELSE 'blue,green,nir,red,swir1' END bands_used,
  CASE WHEN pair_id = 3 THEN 'swir1' ELSE '' END ignored_bands,
  CASE WHEN pair_id = 3 THEN 'NDWI (green, NIR)' ELSE 'MNDWI (green, SWIR1)' END water_method,
  CASE WHEN pair_id = 3 THEN 'low-NDVI proxy (no SWIR)' ELSE 'NDBI (SWIR1, NIR)' END built_method,
  n valid_pixels, {rnd('m / 1e6', 4)} valid_area_km2, {pct('moved', 'n')} changed_percent
  FROM (SELECT pair_id, count(*) n, sum(area) m, count(*) FILTER (ca <> cb) moved FROM runs WHERE main GROUP BY pair_id)"""),
    "season_gap": change_sql("SELECT * FROM season"),
    "change_confidence": change_sql(f"""SELECT pair_id, class, {rnd("CASE WHEN class = 'water' THEN robustness ELSE robustness * season_factor END", 4)} confidence
  FROM robust JOIN season USING (pair_id)"""),
}
