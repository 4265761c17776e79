"""SQL checks of the scene, display, shape and menu queries."""

from __future__ import annotations

from workload.catalogue_sql import CAT
from workload.grids_sql import BOX, IMGS
from workload.imagery_sql import fused_sql
from workload.language_sql import STATES
from workload.quality_sql import APS
from workload.sql_parts import WIDE, nd, rnd, whole_mean


def _confidence() -> str:
    head, stats = fused_sql("and").rsplit("\nSELECT ", 1)
    return f"""{head}, fs AS (SELECT {stats}), av AS (SELECT pair_id, {whole_mean('agreement')} m FROM fs GROUP BY 1) SELECT pair_id, {rnd('m', 4)} confidence FROM av"""


def _fold(target: str, n: str) -> str:
    return f"CASE WHEN {target} % (2 * ({n} - 1)) < {n} THEN {target} % (2 * ({n} - 1)) ELSE 2 * ({n} - 1) - {target} % (2 * ({n} - 1)) END"


_AFTER = APS.replace("sc AS (", "sc0 AS (", 1).replace("FROM embeddings, range(0, 64) r(c))", "FROM embeddings, range(0, 64) r(c)),\nsc AS (SELECT row_id, class_idx, y, CASE WHEN y THEN least(1, p + 0.25::DOUBLE) ELSE p END p FROM sc0)", 1)
_VALUES = (f"SELECT 'micro_map' metric, {rnd('m', 4)} v FROM mi UNION ALL SELECT 'macro_map', {rnd('m', 4)} FROM ma "
           f"UNION ALL SELECT 'macro_f1', {rnd('m', 4)} FROM mf")

ORACLE = {
    "scene_area_join": f"""WITH {BOX}, a AS (SELECT n_nationkey aoi, n_nationkey * 13::DOUBLE - 170 aw, n_nationkey * 5::DOUBLE - 70 as_, n_nationkey * 13::DOUBLE - 155.5 ae,
  n_nationkey * 5::DOUBLE - 57.25 an FROM nation) SELECT aoi, count(*) scenes, max(box_id) last_scene FROM a JOIN by_ ON greatest(w, aw) < least(e, ae) AND greatest(s, as_) < least(n, an) GROUP BY 1""",
    "cloudy_scenes": "SELECT o_orderstatus kind, count(*) scenes FROM orders WHERE o_custkey % 400 < 100 GROUP BY 1",
    "ndvi_layer": f"WITH {WIDE} SELECT pair_id, count(*) shown FROM bef WHERE {nd('nir', 'red')} > 0 GROUP BY 1",
    "pair_confidence": _confidence(),
    "unusable_pairs": """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'sar_is_photo' WHEN o_custkey % 4 = 0 THEN 'sar_not_calibrated' END,
  CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'optical_is_photo' END) reasons FROM orders""",
    "display_choice": f"""WITH {CAT}, m AS (SELECT *, CASE WHEN roles = '' THEN [] ELSE string_split(roles, ',') END l FROM ce WHERE r IS NOT NULL),
p AS (SELECT *, CASE WHEN len(l) = 0 THEN MAP {{}} ELSE map(list_transform(l, lambda x: split_part(x, '=', 1)), list_transform(l, lambda x: split_part(x, '=', 2))) END ro FROM m)
SELECT upload_id, slot, CASE WHEN kind = 'sar' THEN coalesce(ro['vv'], ro['hh'], ro['vh'], ro['hv'], '1')
  WHEN ro['red'] IS NOT NULL AND ro['green'] IS NOT NULL AND ro['blue'] IS NOT NULL THEN concat_ws(',', ro['red'], ro['green'], ro['blue']) ELSE '1' END shown,
  CASE WHEN kind = 'sar' THEN 'sar_db' WHEN ro['red'] IS NOT NULL AND ro['green'] IS NOT NULL AND ro['blue'] IS NOT NULL THEN 'rgb' ELSE 'gray' END rendering FROM p""",
    "ten_metre_shape": f"""WITH o AS (SELECT o_orderkey k, 100 + o_custkey % 300 w, 80 + o_custkey % 170 h, o_orderkey % 3 u, (o_orderkey % 120) - 60::DOUBLE lat FROM orders),
p AS (SELECT *, w * (CASE u WHEN 0 THEN 5.8::DOUBLE ELSE 0.00007::DOUBLE * (111320::DOUBLE * cos(radians(lat))) END) / 10 a, h * (CASE u WHEN 0 THEN 5.8::DOUBLE ELSE 0.00007::DOUBLE * 111320::DOUBLE END) / 10 b FROM o)
SELECT k o_orderkey, (CASE u WHEN 2 THEN w ELSE greatest(1, {rnd('a', 0)}) END)::INT width, (CASE u WHEN 2 THEN h ELSE greatest(1, {rnd('b', 0)}) END)::INT height FROM p""",
    "grid_area": f"""WITH {WIDE}, {IMGS}, g AS (SELECT *, greatest(1, round_even(width / greatest(1, greatest(width, height) / 40::DOUBLE), 0))::INT ow,
  greatest(1, round_even(height / greatest(1, greatest(width, height) / 40::DOUBLE), 0))::INT oh FROM imgs),
s AS (SELECT image_id, ow, width::DOUBLE / ow kx, height::DOUBLE / oh ky, unnest(range(0, oh)) r FROM g)
SELECT image_id, sum(ow * CASE image_id WHEN 1 THEN 0.0001::DOUBLE * kx * 111320::DOUBLE * cos(radians(12.9::DOUBLE - (r + 0.5::DOUBLE) * 0.0001::DOUBLE * ky)) * 0.0001::DOUBLE * ky * 110574::DOUBLE
  WHEN 2 THEN NULL ELSE 100::DOUBLE * kx * ky END)::FLOAT::DOUBLE area_m2, count(*) AS "rows" FROM s GROUP BY 1""",
    "reflect_padded": f"""WITH {WIDE}, {IMGS}, t AS (SELECT image_id, height, width, unnest(range(0, greatest(height, 150))) tr FROM imgs),
u AS (SELECT *, unnest(range(0, greatest(width, 150))) tc FROM t)
SELECT image_id, tr::INT AS "row", tc::INT col, b.nir FROM u JOIN bef b ON b.pair_id = image_id AND b."row" = CASE WHEN height >= 150 THEN tr ELSE {_fold('tr', 'height')} END
  AND b.col = CASE WHEN width >= 150 THEN tc ELSE {_fold('tc', 'width')} END""",
    "augmented_tiles": f"""WITH {WIDE}, t AS (SELECT pair_id * 1000000::BIGINT + "row" // 64 k, "row" % 64 r, col c, nir FROM bef),
f AS (SELECT *, (k * 7 + k // 1000000) % 16 h FROM t), m AS (SELECT *, CASE WHEN h % 4 >= 2 THEN 63 - r ELSE r END r1, CASE WHEN h % 2 = 1 THEN 63 - c ELSE c END c1 FROM f)
SELECT k image_id, (CASE h // 4 WHEN 1 THEN 63 - c1 WHEN 2 THEN 63 - r1 WHEN 3 THEN c1 ELSE r1 END)::INT AS "row",
  (CASE h // 4 WHEN 1 THEN r1 WHEN 2 THEN 63 - c1 WHEN 3 THEN 63 - r1 ELSE c1 END)::INT col, nir FROM m""",
    "menu_order": f"""WITH {STATES}, m AS (SELECT s_nationkey % 5 state_id, s_name district, s_suppkey::INT p FROM supplier WHERE s_nationkey < 9)
SELECT n.state_id, n.district, CASE WHEN p IS NULL THEN 1 ELSE 0 END AS "section", p AS "position" FROM (SELECT DISTINCT state_id, district FROM nm) n
  LEFT JOIN m ON m.state_id = n.state_id AND m.district = n.district""",
    "duplicate_districts": """SELECT s_nationkey % 5 state_id, 'Area ' || (s_suppkey % 60) district, count(*) n FROM supplier GROUP BY ALL HAVING count(*) > 1""",
    "model_comparison": f"""WITH b AS (WITH {APS} {_VALUES}), a AS (WITH {_AFTER} {_VALUES}), j AS (SELECT metric, b.v bv, a.v av FROM b JOIN a USING (metric))
SELECT metric, bv AS "before", av AS "after", {rnd('av - bv', 4)} AS "change" FROM j""",
}
ORACLE["metadata_answers"] = f"""WITH {CAT} SELECT upload_id, slot, concat('File ', slot, ' (scene_', k, CASE fx WHEN '.png' THEN '.PNG' ELSE fx END, '): ',
  CASE WHEN geo THEN 'CRS EPSG:326' || zone ELSE 'no CRS' END, '; ', width, ' x 300 pixels; resolution ', CASE WHEN coarse THEN 20 ELSE 10 END, ' x 10 metres; bounds [',
  format('{{:g}}', lf), ', ', format('{{:g}}', 1430000::DOUBLE), ', ', format('{{:g}}', rt), ', ', format('{{:g}}', 1440000::DOUBLE), ']; ',
  coalesce('date ' || dt, 'no date given'), '; data type uint16; ', bc, ' band(s), ', CASE WHEN roles = '' THEN 'no roles' ELSE replace(replace(roles, ',', ', '), '=', '=band ') END,
  CASE WHEN src IN ('descriptions', 'sensor_hint', 'user_roles') THEN '' ELSE ' (inferred from band count)' END, '; ', kind, ' image, sensor profile ',
  CASE sn WHEN 'sentinel2' THEN 'Sentinel-2' WHEN 'cartosat2s' THEN 'Cartosat-2S MX' WHEN 'bgrn' THEN '4-band blue/green/red/NIR' WHEN 'rgb' THEN 'RGB' WHEN 'sar' THEN 'SAR'
    WHEN 'described' THEN 'from band descriptions' WHEN 'user' THEN 'user-specified band roles' ELSE sn END) line FROM ce WHERE r IS NOT NULL"""
