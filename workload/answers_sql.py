"""SQL checks of the answer, prediction, fetch and clipping queries."""

from __future__ import annotations

from pixelloom.functions.wording import CHANGE_CAVEATS, FUSION_CAVEATS
from workload.imagery_sql import change_sql, fused_sql
from workload.sql_parts import WIDE, pct, rnd, whole_mean

# NOTE: format() prints the value given, so every value is rounded before.
_LABEL = "CASE {c} WHEN 'water' THEN 'Water' WHEN 'built_up' THEN 'Built-up' WHEN 'vegetation' THEN 'Vegetation' ELSE 'Other' END"
_VERB = "CASE {d} WHEN 'unchanged' THEN 'remained essentially unchanged' ELSE {d} END"
_C = list(CHANGE_CAVEATS.values())
_F = list(FUSION_CAVEATS.values())


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINE = f"""li AS (SELECT *, concat({_LABEL.format(c='class')}, ' ', {_VERB.format(d='direction')}, ': ', format('{{:.2f}}', before_percent), '% on 2019-02-15 -> ',
  format('{{:.2f}}', after_percent), '% on 2025-02-15 (', format('{{:+.2f}}', delta_pp), ' percentage points',
  CASE WHEN delta_km2 IS NOT NULL THEN concat(', ', format('{{:g}}', before_km2), ' -> ', format('{{:g}}', after_km2), ' km², ', format('{{:+g}}', delta_km2), ' km²') ELSE '' END,
  CASE WHEN relative_change_percent IS NOT NULL AND direction <> 'unchanged' THEN concat(', ', format('{{:+.1f}}', relative_change_percent), '% relative') ELSE '' END,
  ')', CASE WHEN direction = 'unchanged' THEN '; the change is within the ±1 pp tolerance' ELSE '' END, '.') line FROM classes)"""

_SEASON = ("'Note: The dates differ in overall greenness (NDVI p90 ' || format('{:.2f}', s2) || ' vs ' || format('{:.2f}', a2) || "
           "'). Index rules count dry bare fields as built-up, so built-up / vegetation / other changes may reflect season or rainfall "
           "rather than real land-cover change. Compare images from the same season.'")

ANSWER = f""", {LINE},
ls AS (SELECT pair_id, string_agg(line, chr(10) ORDER BY -abs(delta_pp), class_code) t FROM li GROUP BY 1),
tr AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, cb, ca) r, sum(n) OVER (PARTITION BY pair_id) off_ FROM
  (SELECT pair_id, cb, ca, count(*) n FROM runs WHERE main AND cb <> ca GROUP BY ALL)),
tot AS (SELECT pair_id, count(*) n, count(*) FILTER (ca <> cb) moved FROM runs WHERE main GROUP BY 1),
tp AS (SELECT tr.pair_id, r, {_LABEL.format(c='f.class')} || ' -> ' || {_LABEL.format(c='g.class')} || ' ' l, {pct('tr.n', 'tot.n')} p FROM tr JOIN tot USING (pair_id)
  JOIN k f ON f.class_code = cb JOIN k g ON g.class_code = ca WHERE r <= 3),
ts AS (SELECT pair_id, string_agg(l || format('{{:.2f}}', p) || '%', '; ' ORDER BY r) t FROM tp GROUP BY 1),
sr AS (SELECT pair_id, season_gap, {rnd('season_before', 2)} s2, {rnd('season_after', 2)} a2 FROM season),
ch AS (SELECT pair_id, {pct('moved', 'n')} c FROM tot), c1 AS (SELECT pair_id, c, {rnd('c', 1)} c1 FROM ch)
SELECT pair_id, concat_ws(chr(10), concat('Between 2019-02-15 and 2025-02-15, ', format('{{:.2f}}', c), '% of the compared area changed land-cover class.'), ls.t,
    'Largest transitions: ' || ts.t || '.', CASE WHEN pair_id = 3 THEN 'Note: No SWIR band on both dates: built-up uses a low-NDVI proxy, which also counts bare soil as built-up.' END,
    CASE WHEN pair_id = 3 THEN 'Note: Bands only present on one date were ignored: swir1.' END, CASE WHEN season_gap >= 0.05 THEN {_SEASON} END) answer,
  concat('About ', format('{{:.1f}}', c1), '% of the area changed between 15 Feb 2019 and 15 Feb 2025.') headline,
  concat_ws('|', CASE WHEN pair_id = 3 THEN {_q(_C[1])} END, CASE WHEN pair_id = 3 THEN {_q(_C[2])} END, CASE WHEN season_gap >= 0.05 THEN {_q(_C[0])} END) caveats, '' banned
FROM c1 JOIN ls USING (pair_id) JOIN ts USING (pair_id) JOIN sr USING (pair_id)"""

_ANSWER_PARTS, _ANSWER_SELECT = ANSWER.rsplit("\nSELECT ", 1)
_ANSWER_SELECT = "SELECT " + _ANSWER_SELECT

VERDICT = f""", sb AS (SELECT pair_id, avg(red) / 1000 b FROM bef GROUP BY 1), sa AS (SELECT pair_id, avg(red) / 1000 a FROM aft GROUP BY 1),
s1 AS (SELECT pair_id, {rnd('b', 4)} score_before, {rnd('a', 4)} score_after FROM sb JOIN sa USING (pair_id)),
s2 AS (SELECT *, {rnd('score_after - score_before', 4)} score_delta FROM s1),
s3 AS (SELECT *, CASE WHEN abs(score_delta) < 0.05 THEN 'unchanged' WHEN score_delta > 0 THEN 'increased' ELSE 'decreased' END model_direction FROM s2),
cf AS (SELECT pair_id, {rnd('robustness * season_factor', 4)} confidence FROM robust JOIN season USING (pair_id) WHERE class = 'built_up'),
v AS (SELECT s3.*, c.direction rules_direction, c.delta_pp rd, model_direction = c.direction agree, confidence,
    {rnd('score_before', 2)} b2, {rnd('score_after', 2)} a2, {rnd('score_delta', 2)} d2 FROM s3 JOIN classes c USING (pair_id) JOIN cf USING (pair_id) WHERE c.class = 'built_up'),
vl AS (SELECT *, concat('Built-up ', {_VERB.format(d='model_direction')}, ' according to the land-cover model: scene score ', format('{{:.2f}}', b2), ' on 2019-02-15 -> ', format('{{:.2f}}', a2),
  ' on 2025-02-15 (', format('{{:+.2f}}', d2), '; unchanged within ±0.05). ', CASE WHEN pair_id = 2 THEN 'Input is not Sentinel-2-like reflectance, so the model is out of its training distribution. ' ELSE '' END,
  CASE WHEN agree THEN 'The pixel rules agree.' ELSE concat('Disagreement: the pixel rules say built-up ',
  {_VERB.format(d='rules_direction')}, ' (', format('{{:+.2f}}', rd), ' percentage points, area table below); confidence lowered.') END) lead FROM v)"""

_NAMES = "CASE class WHEN 'water' THEN 'water' WHEN 'built_up' THEN 'built-up area' WHEN 'vegetation' THEN 'vegetation' ELSE 'other land' END"

FUSED = f""", fs AS ({{stats}}),
r1_ AS (SELECT *, {rnd('"percent"', 1)} p1, {rnd('agreement * 100', 0)} ag, CASE pair_id WHEN 2 THEN 'HH (dB)' WHEN 0 THEN 'VV (dB)' ELSE 'VV (linear, converted to dB)' END band FROM fs),
ln AS (SELECT *, (class = 'built_up')::INT i, concat(CASE class WHEN 'water' THEN 'Water' ELSE 'Built-up' END, ': ', format('{{:.2f}}', "percent"), '% of ',
  CASE WHEN valid_area_km2 IS NULL THEN concat('the ', valid_pixels, ' pixels both images cover') ELSE concat('the ', format('{{:g}}', valid_area_km2), ' km² both images cover') END,
  CASE WHEN area_km2 IS NULL THEN '' ELSE concat(' (', format('{{:g}}', area_km2), ' km²)') END, '. Optical (',
  CASE WHEN class = 'water' THEN CASE WHEN pair_id = 3 THEN 'NDWI (green, NIR)' ELSE 'MNDWI (green, SWIR1)' END
    ELSE CASE WHEN pair_id = 3 THEN 'low NDVI (< 0.2) proxy, no SWIR band' ELSE 'NDBI (SWIR1, NIR)' END END, ') flagged ', format('{{:.2f}}', optical_percent),
  '%, SAR (', band, CASE WHEN class = 'water' THEN ' < -18 dB' ELSE ' > -6 dB' END, ') flagged ', format('{{:.2f}}', sar_percent), '%; they agree on ', format('{{:.2f}}', both_percent),
  '% (optical only ', format('{{:.2f}}', optical_only_percent), '%, SAR only ', format('{{:.2f}}', sar_only_percent), '%, agreement ', format('{{:.0f}}', ag), '%).') l FROM r1_)
SELECT pair_id, string_agg(l, chr(10) ORDER BY i) || chr(10) || 'Final masks: both modalities must agree.' answer,
  'About ' || string_agg(format('{{:.1f}}', p1) || '% of the area is ' || CASE class WHEN 'water' THEN 'water' ELSE 'built-up (buildings and roads)' END, ' and ' ORDER BY i) || '.' headline,
  arg_min(class, (agreement, i)) worst_agreement, CASE WHEN pair_id = 3 THEN {_q(_F[1])} ELSE '' END caveats FROM ln GROUP BY pair_id"""


def _fusion_answers() -> str:
    whole = fused_sql("and")
    head, stats = whole.rsplit("\nSELECT ", 1)
    return head + FUSED.replace("{stats}", "SELECT " + stats).replace("{{", "{").replace("}}", "}")


ORACLE = {
    "change_lines": change_sql(f", {LINE} SELECT pair_id, class, line FROM li"),
    "change_answers": change_sql(ANSWER),
    "class_headlines": change_sql(f"""SELECT pair_id, class, direction short_answer, CASE direction WHEN 'unchanged' THEN 'No — the ' || {_NAMES} || ' has stayed about the same.'
  ELSE 'Yes — the ' || {_NAMES} || ' has ' || direction || '.' END headline,
  concat({_LABEL.format(c='class').replace("'Other'", "'Other land'")}, ': ', format('{{:.2f}}', before_percent), '% → ', format('{{:.2f}}', after_percent), '% of the area') key_number FROM classes"""),
    "fusion_answers": _fusion_answers(),
    "built_up_verdict": change_sql(f"""{VERDICT}
SELECT pair_id, rules_direction, model_direction, score_before, score_after, score_delta, agree, model_direction direction, confidence * CASE WHEN agree THEN 1 ELSE 0.5 END confidence, lead FROM vl"""),
    "asked_answers": change_sql(f"""{_ANSWER_PARTS}, full_ AS ({_ANSWER_SELECT}){VERDICT},
pc AS (SELECT pair_id, class, {rnd("robustness * CASE WHEN class IN ('built_up', 'vegetation', 'other') THEN season_factor ELSE 1 END", 4)} c FROM robust JOIN season USING (pair_id)),
ask AS (SELECT pair_id, unnest(cl) class, unnest(range(0, len(cl))) i, len(cl) n FROM (SELECT DISTINCT pair_id, CASE pair_id WHEN 0 THEN ['built_up'] WHEN 1 THEN ['water', 'vegetation']
  WHEN 2 THEN ['vegetation', 'built_up', 'water', 'other'] ELSE ['built_up', 'other'] END cl FROM classes)),
sm AS (SELECT pair_id, any_value(n) n, string_agg(line, chr(10) ORDER BY i) t, {whole_mean('c')} m, max(li.direction) d, bool_or(class = 'built_up') bu
  FROM ask JOIN li USING (pair_id, class) JOIN pc USING (pair_id, class) GROUP BY pair_id)
SELECT pair_id, concat_ws(chr(10), CASE WHEN bu THEN lead END, CASE WHEN n = 4 THEN answer ELSE concat_ws(chr(10), sm.t,
    CASE WHEN pair_id = 3 THEN 'Note: No SWIR band on both dates: built-up uses a low-NDVI proxy, which also counts bare soil as built-up.' END,
    CASE WHEN pair_id = 3 THEN 'Note: Bands only present on one date were ignored: swir1.' END, CASE WHEN sr.season_gap >= 0.05 THEN {_SEASON} END) END) answer,
  CASE WHEN n = 1 THEN CASE WHEN bu THEN model_direction ELSE d END END short_answer, round(m * CASE WHEN bu AND NOT agree THEN 0.5 ELSE 1 END, 6) confidence
FROM sm JOIN (SELECT pair_id, answer FROM full_) USING (pair_id) JOIN (SELECT pair_id, lead, model_direction, agree FROM vl) USING (pair_id) JOIN sr USING (pair_id)"""),
    "qa_headlines": f"""WITH a AS (SELECT event_id qid, CASE event_type WHEN 'click' THEN 'count' WHEN 'purchase' THEN 'rural_urban' WHEN 'signup' THEN 'comp' ELSE 'presence' END t,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'a lake' END o, CASE event_type WHEN 'click' THEN user_id::VARCHAR WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'rural' ELSE 'urban' END
  WHEN 'error' THEN 'maybe' ELSE CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END END a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 101) / 100::DOUBLE END p FROM events),
b AS (SELECT *, {rnd('p * 100', 0)} c FROM a)
SELECT qid, CASE WHEN t = 'rural_urban' THEN CASE a WHEN 'rural' THEN 'This looks like a rural area (countryside).' ELSE 'This looks like an urban area (a town or city).' END
  WHEN t = 'presence' AND o IS NOT NULL AND a = 'yes' THEN 'Yes — the model found a lake in this image.' WHEN t = 'presence' AND o IS NOT NULL AND a = 'no' THEN 'No — the model did not find a lake in this image.'
  WHEN t = 'count' THEN 'The model estimates a count of about ' || a || '.' WHEN a = 'yes' THEN 'Yes — that is the model''s answer to your question.'
  WHEN a = 'no' THEN 'No — that is the model''s answer to your question.' ELSE 'The model''s answer is "' || a || '".' END headline,
  CASE WHEN p IS NULL THEN 'Not rated' WHEN p >= 0.75 THEN 'High' WHEN p >= 0.4 THEN 'Medium' ELSE 'Low' END AS "level", format('{{:.0f}}', c) || '%' certainty FROM b""",
    "fetch_plan": f"""WITH q AS (SELECT o_orderkey request_id, CASE o_orderkey % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'single' WHEN 2 THEN 'single' WHEN 3 THEN 'optical_sar' ELSE 'bi_temporal' END "mode",
  o_orderdate::DATE s, (o_orderdate + to_days((o_custkey % 60 - 5)::INT))::DATE e, o_custkey % 8 = 0 big FROM orders),
g AS (SELECT * FROM q WHERE "mode" <> 'other' AND s < e AND s <= DATE '2001-05-01' AND NOT big AND NOT ("mode" = 'bi_temporal' AND request_id % 10 = 0))
SELECT request_id, "mode", u.slot AS slot, u.product AS product, s AS "start", e AS "end", (s + ((e - s) // 2)::INT)::DATE mid_date, 32643::INT epsg FROM
  (SELECT *, unnest(CASE "mode" WHEN 'single' THEN [{{'slot': 1, 'product': 's2'}}] WHEN 'optical_sar' THEN [{{'slot': 1, 'product': 's2'}}, {{'slot': 2, 'product': 's1'}}]
    ELSE [{{'slot': 1, 'product': 's2'}}, {{'slot': 2, 'product': 's2'}}] END) u FROM g)""",
    "aoi_clip": f"""WITH {WIDE}, im AS (SELECT pair_id, max("row") + 1 h, max(col) + 1::DOUBLE w FROM wide GROUP BY 1),
ed AS (SELECT pair_id, w / 2 x1, 0::DOUBLE y1, w x2, h / 2::DOUBLE y2 FROM im UNION ALL SELECT pair_id, w, h / 2::DOUBLE, w / 2, h FROM im
  UNION ALL SELECT pair_id, w / 2, h, 0, h / 2::DOUBLE FROM im UNION ALL SELECT pair_id, 0, h / 2::DOUBLE, w / 2, 0 FROM im)
SELECT b.pair_id aoi, "row", col FROM bef b JOIN ed USING (pair_id) WHERE (y1 > "row" + 0.5::DOUBLE) <> (y2 > "row" + 0.5::DOUBLE)
  AND x1 + ("row" + 0.5::DOUBLE - y1) * (x2 - x1) / (y2 - y1) > col + 0.5::DOUBLE GROUP BY ALL HAVING count(*) % 2 = 1""",
}
ORACLE["captions"] = """WITH p AS (SELECT label, arg_min(embedding, vec_id) pv FROM embeddings GROUP BY 1),
s AS (SELECT e.vec_id k, p.label i, 10::DOUBLE * list_sum(list_transform(range(1, 65), lambda j: e.embedding[j]::DOUBLE * pv[j]::DOUBLE)) l FROM embeddings e, p),
x AS (SELECT k, i, exp(l - max(l) OVER (PARTITION BY k)) e FROM s), y AS (SELECT k, i, e / sum(e) OVER (PARTITION BY k) pr FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr DESC, i) r FROM y),
n AS (SELECT *, concat('label ', i, ' (', format('{:.0f}', round_even(pr * 100, 0)), '%)') t FROM z WHERE r = 1 OR (r <= 3 AND pr >= 0.05))
SELECT k image_id, concat('A satellite image of ', max(t) FILTER (r = 1), '.', coalesce(' Also possible: ' || string_agg(t, ', ' ORDER BY r) FILTER (r > 1) || '.', '')) caption,
  CASE WHEN max(pr) >= 0.75 THEN 'High' WHEN max(pr) >= 0.4 THEN 'Medium' ELSE 'Low' END AS "level" FROM n GROUP BY k"""
for _name in ("qa_headlines", "fetch_plan"):
    ORACLE[_name] = ORACLE[_name].replace("{{", "{").replace("}}", "}")
for _name in ("change_lines", "change_answers", "class_headlines", "built_up_verdict", "asked_answers"):
    ORACLE[_name] = ORACLE[_name].replace("{{", "{").replace("}}", "}")
