"""SQL checks of the question-log, embedding and area queries."""

from __future__ import annotations

from pixelloom.functions import questions as q
from workload.language import MODES, WORDINGS
from workload.sql_parts import rnd


def _t(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LOG = f"""lg AS (SELECT event_id qid, user_id, [{', '.join(_t(m) for m in MODES)}][user_id % 3 + 1] "mode",
  replace([{', '.join(_t(w) for w in WORDINGS)}][event_id * 7 % {len(WORDINGS)} + 1], '%d', user_id::VARCHAR) question FROM events)"""


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_t('(?i)' + pattern)})"


def _hits(text: str) -> str:
    parts = ", ".join(f"CASE WHEN {' OR '.join(_m(f'trim({text})', p) for p in ps)} THEN '{t}' END" for t, ps in q.RULES.items())
    return f"list_filter([{parts}], lambda v: v IS NOT NULL)"


def _type(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {_m(text, p)} THEN '{t}'" for t, p in q.TYPE_PATTERNS.items()) + " ELSE 'other' END"


def _object(text: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {_m(text, p)} THEN nullif(trim(regexp_replace(regexp_extract({text}, {_t('(?i)' + p)}, 1), '\\s+', ' ', 'g'), ' ?.'), '')"
        for p in q.OBJECT_PATTERNS) + " END"


def _mentioned(patterns: dict) -> str:
    parts = ", ".join(f"CASE WHEN {_m('question', p)} THEN '{c}' END" for c, p in patterns.items())
    found = f"list_filter([{parts}], lambda v: v IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN array_to_string({found}, ',') ELSE {_t(','.join(patterns))} END"


_MATCHED = "CASE hits[1] " + " ".join(
    f"WHEN '{t}' THEN array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {_m('trim(question)', p)} THEN regexp_extract(trim(question), {_t('(?i)' + p)}, 0) END" for p in ps)
    + "], lambda v: v IS NOT NULL), '|')" for t, ps in q.RULES.items()) + " ELSE '' END"

STATES = """st AS (SELECT r_regionkey state_id, r_regionkey * 10::DOUBLE w, 0::DOUBLE s, r_regionkey * 10::DOUBLE + 10 e, 10::DOUBLE n FROM region),
di AS (SELECT s_suppkey district_id, s_name name, s_nationkey, (s_suppkey * 37 % 480) / 10::DOUBLE w, (s_suppkey * 11 % 90) / 10::DOUBLE s,
    (s_suppkey * 37 % 480) / 10::DOUBLE + (5 + s_suppkey % 13) / 10::DOUBLE e, (s_suppkey * 11 % 90) / 10::DOUBLE + 0.5 n FROM supplier
  UNION ALL SELECT s_suppkey, s_name, s_nationkey, (s_suppkey * 37 % 480) / 10::DOUBLE + 0.75, (s_suppkey * 11 % 90) / 10::DOUBLE + 0.5,
    (s_suppkey * 37 % 480) / 10::DOUBLE + 1.75, (s_suppkey * 11 % 90) / 10::DOUBLE + 0.75 FROM supplier),
ov AS (SELECT district_id, state_id, sum((least(d.e, t.e) - greatest(d.w, t.w)) * (least(d.n, t.n) - greatest(d.s, t.s))) a
  FROM di d JOIN st t ON greatest(d.w, t.w) < least(d.e, t.e) AND greatest(d.s, t.s) < least(d.n, t.n) GROUP BY ALL),
be AS (SELECT district_id, state_id, round(a, 9) a, count(*) OVER (PARTITION BY district_id) candidates,
  row_number() OVER (PARTITION BY district_id ORDER BY round(a, 9) DESC, state_id) r FROM ov),
asg AS (SELECT s_suppkey district_id, s_name name, CASE WHEN s_nationkey = 3 THEN 4 ELSE be.state_id END state_id FROM supplier
  LEFT JOIN be ON be.district_id = s_suppkey AND r = 1 WHERE s_nationkey <> 11),
nm AS (SELECT a.district_id, a.state_id, a.name AS "source", CASE WHEN s.s_nationkey < 6 AND a.state_id < 3 THEN 'District ' || s.s_suppkey ELSE a.name END district
  FROM asg a JOIN supplier s ON s.s_suppkey = a.district_id)"""

PROB = "exp(l - max(l) OVER (PARTITION BY k)) e"

ORACLE = {
    "task_rules": f"""WITH {LOG}, h AS (SELECT *, {_hits('question')} hits FROM lg)
SELECT qid, array_to_string(hits, ',') hits, {_MATCHED} matched FROM h""",
    "route": f"""WITH {LOG}, t AS (SELECT qid, ['metadata', 'caption', 'vqa', 'water_builtup', 'change', 'unknown'][qid % 6 + 1] task, "mode" FROM lg)
SELECT qid, task, "mode", CASE WHEN task = 'metadata' THEN task WHEN task IN ('caption', 'vqa') AND "mode" = 'single' THEN task
  WHEN task = 'water_builtup' THEN CASE "mode" WHEN 'optical_sar' THEN task WHEN 'single' THEN 'vqa' ELSE 'change' END
  WHEN task = 'change' AND "mode" = 'bi_temporal' THEN task END routed_task,
  CASE WHEN task = 'water_builtup' AND "mode" <> 'optical_sar' THEN task END rerouted_from FROM t""",
    "intent": f"""WITH {LOG}, t AS (SELECT qid, lower(question) s FROM lg)
SELECT qid, CASE WHEN s LIKE '%vegetation%' OR s LIKE '%green%' OR s LIKE '%crop%' THEN 'vegetation' WHEN s LIKE '%flood%' THEN 'flood'
  WHEN s LIKE '%water%' OR s LIKE '%lake%' OR s LIKE '%river%' THEN 'water' ELSE 'unknown' END intent FROM t""",
    "classes_mentioned": f"WITH {LOG} SELECT qid, {_mentioned(q.CLASS_PATTERNS)} classes, {_mentioned(q.FIELD_PATTERNS)} fields FROM lg",
    "question_type": f"WITH {LOG} SELECT qid, {_type('question')} AS \"type\" FROM lg",
    "presence_object": f"WITH {LOG} SELECT qid, {_object('question')} AS \"object\" FROM lg",
    "conversation_wording": f"""SELECT role, array_to_string({_hits('"text"')}, ',') hits, {_type('"text"')} AS "type", count(*) n FROM conversations GROUP BY ALL""",
    "count_bins": """WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN (user_id * user_id)::VARCHAR WHEN 1 THEN concat(' ', user_id, ' ')
  WHEN 2 THEN concat('-', user_id) WHEN 3 THEN "value"::VARCHAR WHEN 4 THEN concat('9999999999999999999', user_id) ELSE event_type END a FROM events),
b AS (SELECT event_id, CASE WHEN regexp_full_match(a, '\\s*[+-]?[0-9]+\\s*') THEN trim(a)::HUGEINT END v FROM a)
SELECT event_id, CASE WHEN v <= 0 THEN '0' WHEN v <= 10 THEN '1-10' WHEN v <= 100 THEN '11-100' WHEN v <= 1000 THEN '101-1000' WHEN v > 1000 THEN '>1000' END bin FROM b""",
    "pair_order": """WITH f AS (SELECT o_orderkey // 2 upload_id, (o_orderkey % 2 + 1)::INT slot,
  CASE WHEN o_custkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END date FROM orders)
SELECT *, (row_number() OVER (PARTITION BY upload_id ORDER BY coalesce(date, ''), slot))::INT AS "position" FROM f""",
    "l2_normalised": """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) l FROM embeddings)
SELECT vec_id image_id, list_sum(list_transform(embedding, lambda x: (x::DOUBLE / l) * (x::DOUBLE / l)))::FLOAT::DOUBLE norm,
  (embedding[6]::DOUBLE / l)::FLOAT::DOUBLE v5 FROM n""",
    "zero_shot_topk": f"""WITH p AS (SELECT label, arg_min(embedding, vec_id) pv FROM embeddings GROUP BY 1),
s AS (SELECT e.vec_id k, p.label i, 10::DOUBLE * list_sum(list_transform(range(1, len(pv) + 1), lambda j: e.embedding[j]::DOUBLE * pv[j]::DOUBLE)) l FROM embeddings e, p),
x AS (SELECT k, i, {PROB} FROM s), y AS (SELECT k, i, e / sum(e) OVER (PARTITION BY k) pr FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr DESC, i) r FROM y)
SELECT k image_id, r::INT AS "rank", 'label ' || i AS "label", round(pr, 5) probability FROM z WHERE r = 1 OR (r <= 3 AND pr >= 0.05)""",
    "two_prompt_answers": f"""WITH {LOG}, a AS (SELECT qid, qid % (SELECT count(*) FROM embeddings) image_id, {_type('question')} t, {_object('question')} o FROM lg),
c AS (SELECT qid, image_id, t, unnest(CASE WHEN t = 'rural_urban' THEN [{{'i': 0, 'a': 'rural', 'x': 'a satellite image of a rural area.'}}, {{'i': 1, 'a': 'urban', 'x': 'a satellite image of an urban area.'}}]
  WHEN t = 'presence' AND o IS NOT NULL THEN [{{'i': 0, 'a': 'yes', 'x': 'a satellite image containing ' || o || '.'}}, {{'i': 1, 'a': 'no', 'x': 'a satellite image with no ' || o || '.'}}] END) u FROM a),
s AS (SELECT c.qid k, u.i, u.a, 5::DOUBLE * list_sum(list_transform(range(1, 65), lambda j: v.embedding[j]::DOUBLE * w.embedding[j]::DOUBLE)) l
  FROM c JOIN embeddings v ON v.vec_id = c.image_id JOIN embeddings w ON w.vec_id = length(u.x) * 37 % (SELECT count(*) FROM embeddings)),
x AS (SELECT k, i, a, {PROB} FROM s), y AS (SELECT k, i, a, e / sum(e) OVER (PARTITION BY k) pr FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr DESC, i) r FROM y)
SELECT a.qid, a.t AS "type", z.a answer, round(z.pr, 5) probability FROM a LEFT JOIN z ON z.k = a.qid AND r = 1""",
    "masked_softmax": f"""WITH s AS (SELECT vec_id k, 't' || (vec_id % 4) t, i, embedding[i + 1]::DOUBLE * 10 l FROM embeddings, range(0, 64) g(i)
  WHERE vec_id % 4 = 3 OR i % 3 = vec_id % 4),
x AS (SELECT k, t, i, {PROB} FROM s), y AS (SELECT k, t, i, e / sum(e) OVER (PARTITION BY k) pr FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr DESC, i) r FROM y)
SELECT k qid, t AS "type", r::INT AS "rank", 'a' || i answer, round(pr, 5) probability FROM z WHERE r <= 3""",
    "multi_hot": """SELECT vec_id image_id, 2::DOUBLE ones, 1::DOUBLE own FROM embeddings""",
    "qa_split_join": """WITH an AS (SELECT event_id - event_id % 2 qid, arg_max(floor("value")::BIGINT::VARCHAR, event_id) answer FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT e.event_id qid, user_id img_id, 'question ' || (event_id % 50) question, answer, event_type AS "type" FROM events e JOIN an ON an.qid = e.event_id
WHERE "value" > 5 AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')""",
    "embedding_gap": """SELECT DISTINCT user_id::VARCHAR AS "key" FROM events WHERE user_id NOT IN (SELECT vec_id * 3 FROM embeddings WHERE label < 8)""",
    "answer_choice": """SELECT event_id qid, CASE WHEN event_type = 'click' THEN 'count' ELSE 'presence' END AS "type", user_id % 4 <> 0 georeferenced,
  CASE event_type WHEN 'click' THEN user_id::VARCHAR WHEN 'error' THEN NULL ELSE 'yes' END answer,
  CASE event_type WHEN 'click' THEN 0.5::DOUBLE WHEN 'error' THEN NULL ELSE 0.75::DOUBLE END probability,
  CASE event_type WHEN 'click' THEN 'trained_head' WHEN 'error' THEN NULL ELSE 'zero_shot' END answered_by,
  event_type = 'click' AND user_id % 4 = 0 count_is_rough FROM events""",
    "district_to_state": f"WITH {STATES} SELECT district_id, state_id, a::FLOAT::DOUBLE overlap, candidates FROM be WHERE r = 1",
    "district_names": f"WITH {STATES} SELECT * FROM nm",
    "alias_resolve": f"""WITH {STATES}, al AS (SELECT state_id, "source" alias, district FROM nm WHERE "source" <> district UNION ALL
  SELECT 2, 'Old ' || s_name, s_name FROM supplier WHERE s_nationkey = 8),
rq AS (SELECT c_custkey, (c_custkey % 5)::INT state_id, CASE WHEN c_custkey % 7 = 0 THEN 'Old ' ELSE '' END || 'Supplier#' || lpad((c_custkey * 13 % 100)::VARCHAR, 9, '0') area FROM customer)
SELECT rq.state_id, rq.area, rq.c_custkey, coalesce(nm.district, al.district) district FROM rq LEFT JOIN (SELECT DISTINCT state_id, district FROM nm) nm
  ON nm.state_id = rq.state_id AND nm.district = rq.area LEFT JOIN al ON al.state_id = rq.state_id AND al.alias = rq.area""",
    "boundary_boxes": """SELECT o_custkey district_id, min((o_orderkey * 37 % 3600) / 10::DOUBLE) w, min((o_orderkey * 53 % 1800) / 10::DOUBLE) s,
  max((o_orderkey * 37 % 3600) / 10::DOUBLE) e, max((o_orderkey * 53 % 1800) / 10::DOUBLE) n FROM orders GROUP BY 1""",
    "city_check": f"""WITH {STATES} SELECT s_nationkey % 5 state_id, count(*) missing FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM nm
  WHERE nm.state_id = s.s_nationkey % 5 AND nm.district = s.s_name) GROUP BY 1""",
}

# Cells of a fine grid that both shapes cover; all corners lie on it.
ORACLE["district_shapes"] = """WITH di AS (SELECT s_suppkey k, s_suppkey * 37 % 190 x, s_suppkey * 11 % 36 y, 3 + s_suppkey % 9 w, 3 + s_suppkey % 5 h FROM supplier),
dc AS (SELECT k, x + i cx, y + j cy FROM di, range(0, 11) a(i), range(0, 7) b(j) WHERE ((i < w AND j < 2) OR (i < 2 AND j < h)) AND NOT (i = 1 AND j = 1)
  UNION SELECT k, x + i, y FROM di, range(12, 14) a(i) WHERE k % 3 = 0),
sc AS (SELECT r_regionkey state_id, r_regionkey * 40 + i cx, j cy FROM region, range(0, 40) a(i), range(0, 40) b(j)
  WHERE NOT (i >= 28 AND j >= 16 AND j < 24) AND NOT (i >= 8 AND i < 16 AND j >= 8 AND j < 20)),
ov AS (SELECT k district_id, state_id, count(*) / 16::DOUBLE a FROM dc JOIN sc USING (cx, cy) GROUP BY ALL)
SELECT district_id, arg_max(state_id, a * 1000 - state_id) state_id, max(a)::FLOAT::DOUBLE overlap, count(*) candidates FROM ov GROUP BY 1"""


def _probe_sql(steps: int, rate: float, decay: float) -> str:
    """Gradient steps written out one after the other."""
    out = ["""WITH x AS (SELECT vec_id row_id, vec_id % 4 = 0 held, unnest(range(0, 65)) d, unnest(list_append(embedding::DOUBLE[], 1::DOUBLE)) v FROM embeddings),
y AS (SELECT vec_id row_id, vec_id % 4 = 0 held, c::INT c, (label = c OR (vec_id + c) % 17 = 0) y FROM embeddings, range(0, 10) r(c)),
n AS (SELECT count(*)::DOUBLE n FROM embeddings WHERE vec_id % 4 <> 0),
w0 AS (SELECT c::INT c, d, 0::DOUBLE w FROM range(0, 10) a(c), range(0, 65) b(d))"""]
    for t in range(1, steps + 1):
        out.append(f"""p{t - 1} AS (SELECT row_id, c, 1 / (1 + exp(-sum(w * v))) p FROM x JOIN w{t - 1} USING (d) GROUP BY ALL),
g{t} AS (SELECT c, d, sum((p - y::INT) * v) / any_value(n) g FROM p{t - 1} JOIN y USING (row_id, c) JOIN x USING (row_id), n WHERE NOT y.held GROUP BY ALL),
w{t} AS (SELECT c, d, w - {rate!r}::DOUBLE * (g + {decay!r}::DOUBLE * w) w FROM w{t - 1} JOIN g{t} USING (c, d)),
s{t} AS (SELECT {t} step, c, y, row_number() OVER (ORDER BY p DESC, row_id, c) r, p FROM (SELECT row_id, c, 1 / (1 + exp(-sum(w * v))) p FROM x JOIN w{t} USING (d) WHERE held GROUP BY ALL)
  JOIN y USING (row_id, c))""")
    every = " UNION ALL ".join(f"SELECT * FROM s{t}" for t in range(1, steps + 1))
    out.append(f"""al AS ({every}), hit AS (SELECT *, sum(y::INT) OVER (PARTITION BY step ORDER BY r) h FROM al),
mm AS (SELECT step, {rnd('sum(h / r::DOUBLE) FILTER (y) / count(*) FILTER (y)', 4)} m FROM hit GROUP BY 1), be AS (SELECT step, m FROM mm ORDER BY m DESC, step LIMIT 1)""")
    return ", ".join(out) + """ SELECT c class_idx, count(*) AS "rows", count(*) FILTER (y) positives, round(avg(p), 6) mean_p, be.step::INT step, be.m micro_map
FROM al JOIN be USING (step) GROUP BY c, be.step, be.m"""


ORACLE["probe_best"] = _probe_sql(3, 4.0, 0.01)
