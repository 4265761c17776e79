"""SQL checks of the catalogue queries."""

from __future__ import annotations

from workload.catalogue_queries import COUNTS
from workload.sql_parts import rnd

_S2 = {13: "1,2,3,4,5,6,7,8,8A,9,10,11,12", 12: "1,2,3,4,5,6,7,8,8A,9,11,12", 10: "2,3,4,5,6,7,8,8A,11,12", 4: "2,3,4,8"}
_S2_NAMES = {n: ",".join("B" + b for b in v.split(",")) for n, v in _S2.items()}
_ROLE = {"B2": "blue", "B3": "green", "B4": "red", "B8": "nir", "B11": "swir1", "B12": "swir2"}


def _roles(names) -> str:
    return ",".join(f"{_ROLE[b]}={i}" for i, b in enumerate(names.split(","), 1) if b in _ROLE)


def _s2_case(what) -> str:
    return "CASE bc " + " ".join(f"WHEN {n} THEN '{what(v)}'" for n, v in _S2_NAMES.items()) + " END"


def _unnamed(start: int = 1) -> str:
    return f"array_to_string(list_transform(range({start}, bc + 1), lambda i: 'band_' || i), ',')"


CAT = f"""ca AS (SELECT o_orderkey k, o_orderkey // 2 upload_id, (o_orderkey % 2 + 1)::INT slot, o_custkey c,
  CASE WHEN o_orderkey // 2 % 23 = 0 THEN 'weird' WHEN o_orderkey // 2 % 5 = 0 THEN 'single' WHEN o_orderkey // 2 % 2 = 0 THEN 'optical_sar' ELSE 'bi_temporal' END "mode",
  CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN '.gif' WHEN o_orderkey % 9 = 0 THEN '.png' ELSE '.tif' END fx,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'PNG' WHEN o_orderkey % 29 = 0 THEN 'JPEG' ELSE 'GTiff' END driver,
  400 + o_orderkey // 2 % 3 + CASE WHEN o_orderkey % 37 = 0 THEN 5 ELSE 0 END width,
  CASE o_orderkey % 6 WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 3 THEN 2 ELSE [{', '.join(map(str, COUNTS))}][o_custkey % 8 + 1] END bc,
  o_orderkey % 6 ds, CASE WHEN o_orderkey % 43 = 0 THEN 44 ELSE 43 END zone, o_orderkey % 17 <> 0 geo,
  780000::DOUBLE + o_custkey % 40 * 100 lf, 784000::DOUBLE + o_custkey % 40 * 100 rt, o_orderkey % 7 = 0 coarse,
  CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN '2021-2-5' ELSE strftime(o_orderdate, '%Y-%m-%d') END dt,
  CASE o_orderkey % 13 WHEN 7 THEN 'sentinel2' WHEN 8 THEN 'rgb' WHEN 9 THEN 'cartosat2s' WHEN 10 THEN 'sar' ELSE 'auto' END sensor,
  CASE o_orderkey % 16 WHEN 5 THEN 1 WHEN 9 THEN 2 WHEN 11 THEN 3 ELSE 0 END ur, o_orderkey // 2 % 3 = 0 bm FROM orders),
cb AS (SELECT *, CASE WHEN "mode" = 'optical_sar' THEN CASE slot WHEN 1 THEN 'optical' ELSE 'sar' END END ek, ds IN (1, 2, 3) has_d, coalesce(driver IN ('PNG', 'JPEG'), false) ph FROM ca),
cc AS (SELECT *, CASE
    WHEN ur > 0 THEN CASE WHEN sensor <> 'auto' THEN 'give either a sensor or explicit band roles, not both'
      WHEN bc <> [5, 2, 2][ur] THEN concat('band roles list has ', [5, 2, 2][ur], ' entries but the file has ', bc, ' bands')
      WHEN ur = 3 THEN 'band roles mix optical and SAR bands in one file' END
    WHEN sensor = 'sentinel2' AND bc NOT IN (4, 10, 12, 13) THEN concat('sentinel2 expects [4, 10, 12, 13] bands, file has ', bc)
    WHEN sensor = 'cartosat2s' AND bc <> 4 THEN concat('cartosat2s expects 4 bands, file has ', bc)
    WHEN sensor = 'rgb' AND bc <> 3 THEN concat('rgb expects 3 bands, file has ', bc)
    WHEN bc > 2 AND (sensor = 'sar' OR (sensor = 'auto' AND NOT has_d AND NOT ph AND ek = 'sar')) THEN concat('SAR images must have 1 or 2 bands, file has ', bc) END err FROM cb),
-- which of the rules decides: the source of trust, then the rule
cd AS (SELECT *, CASE WHEN err IS NOT NULL OR driver IS NULL THEN NULL WHEN ur > 0 THEN 'u' || ur WHEN sensor <> 'auto' THEN 's_' || sensor
    WHEN ds = 1 THEN 'd1' WHEN ds = 2 THEN 'd2' WHEN ds = 3 THEN 'd3'
    WHEN ph AND ek IS DISTINCT FROM 'sar' THEN CASE WHEN bc >= 3 THEN 'p_rgb' ELSE 'p_gray' END WHEN ph THEN 'p_sar'
    WHEN ek = 'sar' OR (ek IS NULL AND bc <= 2) THEN 'c_sar' WHEN bc IN (10, 12, 13) THEN 'c_s2' WHEN bc = 4 THEN 'c_bgrn' WHEN bc = 3 THEN 'c_rgb' ELSE 'c_none' END r FROM cc),
ce AS (SELECT *, CASE WHEN r IN ('u1', 'u2') THEN 'user' WHEN r IN ('s_sentinel2', 'd2', 'c_s2') THEN 'sentinel2' WHEN r = 's_cartosat2s' THEN 'cartosat2s'
    WHEN r IN ('s_rgb', 'p_rgb', 'c_rgb') THEN 'rgb' WHEN r IN ('s_sar', 'c_sar') THEN 'sar' WHEN r IN ('d1', 'd3') THEN 'described' WHEN r = 'p_gray' THEN 'photo_gray'
    WHEN r = 'p_sar' THEN 'photo' WHEN r = 'c_bgrn' THEN 'bgrn' WHEN r = 'c_none' THEN 'unknown' END sn,
  CASE WHEN r IN ('u2', 's_sar', 'c_sar', 'd3', 'p_sar') THEN 'sar' WHEN r = 'c_none' THEN coalesce(ek, 'optical') WHEN r IS NOT NULL THEN 'optical' END kind,
  CASE WHEN r LIKE 'u%' THEN 'user_roles' WHEN r LIKE 's%' THEN 'sensor_hint' WHEN r LIKE 'd%' THEN 'descriptions' WHEN r = 'c_none' THEN 'unresolved' WHEN r IS NOT NULL THEN 'band_count' END src,
  CASE r WHEN 'u1' THEN 'blue=1,green=2,red=3,nir=4' WHEN 'u2' THEN 'vv=1,vh=2' WHEN 's_cartosat2s' THEN 'blue=1,green=2,red=3,nir=4' WHEN 'c_bgrn' THEN 'blue=1,green=2,red=3,nir=4'
    WHEN 's_rgb' THEN 'red=1,green=2,blue=3' WHEN 'c_rgb' THEN 'red=1,green=2,blue=3' WHEN 'p_rgb' THEN 'red=1,green=2,blue=3'
    WHEN 'd1' THEN 'blue=1,green=2,red=3,nir=4,swir1=5' WHEN 'd2' THEN 'blue=1,green=2,red=3,nir=4,swir1=6' WHEN 'd3' THEN 'vv=1,vh=2' WHEN 'p_sar' THEN 'vv=1'
    WHEN 's_sar' THEN CASE bc WHEN 1 THEN 'vv=1' ELSE 'vv=1,vh=2' END WHEN 'c_sar' THEN CASE bc WHEN 1 THEN 'vv=1' ELSE 'vv=1,vh=2' END
    WHEN 's_sentinel2' THEN {_s2_case(_roles)} WHEN 'c_s2' THEN {_s2_case(_roles)} ELSE '' END roles,
  CASE WHEN r IN ('u1') THEN 'blue,green,red,nir,band_5' WHEN r IN ('u2', 'd3') THEN 'vv,vh' WHEN r IN ('s_cartosat2s', 'c_bgrn') THEN 'blue,green,red,nir'
    WHEN r IN ('s_rgb', 'c_rgb') THEN 'red,green,blue' WHEN r = 'p_rgb' THEN 'red,green,blue' || CASE WHEN bc > 3 THEN ',' || {_unnamed(4)} ELSE '' END
    WHEN r = 'p_sar' THEN 'vv' || CASE WHEN bc > 1 THEN ',' || {_unnamed(2)} ELSE '' END WHEN r = 'd1' THEN 'blue,green,red,nir,swir1' WHEN r = 'd2' THEN 'B2,B3,B4,B8,B8A,B11'
    WHEN r IN ('s_sar', 'c_sar') THEN CASE bc WHEN 1 THEN 'vv' ELSE 'vv,vh' END WHEN r IN ('s_sentinel2', 'c_s2') THEN {_s2_case(str)}
    WHEN r IN ('p_gray', 'c_none') THEN {_unnamed()} ELSE '' END nms,
  CASE WHEN r IS NULL THEN NULL WHEN r IN ('s_sar', 'c_sar', 'c_bgrn', 'c_rgb', 'c_none') THEN 1 ELSE 0 END bw FROM cd)"""

CHECK = f"""{CAT},
fa AS (SELECT *, CASE WHEN fx <> '' THEN fx WHEN driver = 'GTiff' THEN '.tif' WHEN driver = 'PNG' THEN '.png' WHEN driver = 'JPEG' THEN '.jpg' ELSE '' END ext FROM ce),
fb AS (SELECT *, CASE WHEN fx = '' AND driver IS NULL THEN 'unreadable_raster' WHEN ext IN ('.png', '.jpg') AND NOT bm THEN 'image_requires_benchmark_mode'
    WHEN ext NOT IN ('.tif', '.png', '.jpg') THEN 'unsupported_format' WHEN driver IS NULL THEN 'unreadable_raster'
    WHEN (ext = '.tif' AND driver <> 'GTiff') OR (ext <> '.tif' AND driver = 'GTiff') THEN 'format_mismatch' END e1 FROM fa),
fc AS (SELECT *, coalesce(e1, CASE WHEN err IS NOT NULL THEN CASE WHEN ur > 0 THEN 'invalid_band_roles' WHEN ek = 'sar' AND sensor = 'auto' THEN 'wrong_modality' ELSE 'sensor_mismatch' END
    WHEN ek = 'optical' AND (kind = 'sar' OR bc < 3) THEN 'wrong_modality' WHEN ek = 'sar' AND kind <> 'sar' THEN 'wrong_modality' END) rs,
  CASE WHEN regexp_full_match(dt, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(dt AS DATE) END pd FROM fb),
fd AS (SELECT *, (fx = '' AND ext <> '')::INT + coalesce((e1 IS NULL AND ext IN ('.png', '.jpg') AND ((ext = '.png') <> (driver = 'PNG')))::INT, 0)
    + CASE WHEN rs IS NULL THEN (NOT geo)::INT + bw ELSE 0 END fw,
  CASE WHEN dt IS NULL THEN CASE WHEN "mode" = 'bi_temporal' THEN 'missing_date' END WHEN pd IS NULL THEN 'invalid_date' WHEN pd > DATE '2001-06-01' THEN 'future_date' END dr FROM fc),
pa AS (SELECT a.upload_id, a."mode", a.bm, a.rs ra, b.rs rb, a.dr da, b.dr db, a.pd pa, b.pd pb, a.fw wa, b.fw wb, a.kind ka, b.kind kb, a.geo ga, b.geo gb, a.width = b.width sw,
  a.zone = b.zone sc, greatest(a.lf, b.lf) l, least(a.rt, b.rt) r, a.coarse <> b.coarse rd, a.bc <> b.bc bd, a."mode" IN ('optical_sar', 'bi_temporal') ok2
  FROM fd a JOIN fd b ON a.upload_id = b.upload_id AND a.slot = 1 AND b.slot = 2),
pb AS (SELECT *, ok2 AND ra IS NULL AND rb IS NULL pr, ok2 AND ra IS NULL AND rb IS NULL AND ga AND gb mp FROM pa),
pc AS (SELECT *, CASE WHEN mp THEN sc END same_crs, mp AND sc AND l < r ov FROM pb),
pd_ AS (SELECT *, CASE WHEN ov THEN {rnd('((r - l) * 10000) / 40000000::DOUBLE', 4)} END overlap_fraction, CASE WHEN pr THEN NOT rd END same_resolution FROM pc),
va AS (SELECT *, CASE WHEN "mode" = 'weird' THEN ['invalid_mode'] WHEN "mode" = 'single' THEN ['file_count'] ELSE list_filter([
    da || ':1', db || ':2', CASE WHEN "mode" = 'bi_temporal' AND pa = pb THEN 'same_date' END, ra || ':1', rb || ':2',
    CASE WHEN pr AND "mode" = 'bi_temporal' AND ka <> kb THEN 'modality_mismatch' END, CASE WHEN pr AND NOT mp AND NOT bm THEN 'missing_crs' END,
    CASE WHEN pr AND NOT mp AND bm AND NOT sw THEN 'size_mismatch' END, CASE WHEN NOT same_crs THEN 'crs_mismatch' END, CASE WHEN same_crs AND NOT ov THEN 'no_overlap' END],
    lambda v: v IS NOT NULL) END rsn,
  CASE WHEN ok2 THEN wa + wb + (pr AND NOT mp AND bm AND sw)::INT + coalesce((overlap_fraction < 0.5)::INT, 0) + coalesce((ov AND rd)::INT, 0)
    + coalesce((ov AND "mode" = 'bi_temporal' AND bd)::INT, 0) + coalesce((pr AND "mode" = 'bi_temporal' AND pa > pb)::INT, 0) ELSE 0 END wn FROM pd_)"""

ORACLE = {
    "band_roles": f"""WITH {CAT} SELECT upload_id, slot, err band_error, sn sensor, kind, src AS "source", roles, nms band_names, bw AS "warnings" FROM ce""",
    "validate_pairs": f"""WITH {CHECK} SELECT upload_id, "mode", len(rsn) = 0 ok, array_to_string(rsn, ',') reasons, wn::INT AS "warnings", same_crs, overlap_fraction, same_resolution FROM va""",
    "reason_counts": f"""WITH {CHECK} SELECT split_part(u, ':', 1) code, count(*) n FROM (SELECT unnest(rsn) u FROM va) GROUP BY 1""",
}
