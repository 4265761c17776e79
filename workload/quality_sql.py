"""SQL checks of the prediction, label, map accuracy and sampling queries."""

from __future__ import annotations

from workload.imagery_sql import change_sql
from workload.language_sql import LOG, _type
from workload.sql_parts import obs, pct, rnd, whole_mean

REC = """rec AS (SELECT event_id qid, CASE event_type WHEN 'signup' THEN 'comp' WHEN 'click' THEN 'count' WHEN 'purchase' THEN 'rural_urban' ELSE 'presence' END "type",
  CASE event_type WHEN 'click' THEN (user_id * user_id % 1300)::VARCHAR WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'rural' ELSE 'urban' END
    ELSE CASE WHEN user_id % 5 < 2 THEN 'no' ELSE 'yes' END END answer,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_type = 'click' THEN (user_id * user_id % 1300 + event_id % 3 * 4)::VARCHAR
    WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'rural' ELSE 'urban' END
    ELSE CASE WHEN event_id % 7 < 3 THEN 'no' ELSE 'yes' END END predicted FROM events)"""


def _bin(x: str) -> str:
    v = f"try_cast({x} AS BIGINT)"
    return f"CASE WHEN {v} <= 0 THEN '0' WHEN {v} <= 10 THEN '1-10' WHEN {v} <= 100 THEN '11-100' WHEN {v} <= 1000 THEN '101-1000' ELSE '>1000' END"


def _accuracy(source: str) -> str:
    return f"""t AS (SELECT "type", count(*) n, count(*) FILTER (predicted = answer) h, count(predicted) a,
  count(*) FILTER ("type" = 'count' AND predicted IS NOT NULL AND {_bin('predicted')} = {_bin('answer')}) bh,
  count(*) FILTER ("type" = 'count') bn FROM {source} GROUP BY 1),
u AS (SELECT *, {rnd('h / n::DOUBLE', 4)} acc FROM t),
v AS (SELECT sum(h) / sum(n)::DOUBLE oa, {whole_mean('acc')} aa, sum(bh) / nullif(sum(bn), 0)::DOUBLE ba, sum(a)::BIGINT answered, sum(n)::BIGINT n FROM u)
SELECT {rnd('oa', 4)} overall_accuracy, {rnd('aa', 4)} average_accuracy, {rnd('ba', 4)} count_binned_accuracy, answered, n FROM v"""


def _vocab(least: int) -> str:
    return f"""voc AS (SELECT answer, n, row_number() OVER (ORDER BY n DESC, answer) - 1 AS "index" FROM
  (SELECT answer, count(*) n FROM rec GROUP BY 1 HAVING count(*) >= {least}))"""


SCORED = """sc AS (SELECT vec_id row_id, c::INT class_idx, label = c OR (vec_id + c) % 17 = 0 y,
  floor(greatest(0, least(1, 0.5::DOUBLE + embedding[c + 1]::DOUBLE + CASE WHEN label = c THEN 0.125::DOUBLE ELSE 0 END)) * 128) / 128::DOUBLE p
  FROM embeddings, range(0, 64) r(c))"""
APS = f"""{SCORED},
rk AS (SELECT *, row_number() OVER (PARTITION BY class_idx ORDER BY p DESC, row_id) r,
  sum(y::INT) OVER (PARTITION BY class_idx ORDER BY p DESC, row_id ROWS UNBOUNDED PRECEDING) h FROM sc),
ap AS (SELECT class_idx, sum(h / r::DOUBLE) FILTER (y) / nullif(count(*) FILTER (y), 0) ap, count(*) FILTER (y) pos FROM rk GROUP BY 1),
mi AS (SELECT sum(h / r::DOUBLE) FILTER (y) / count(*) FILTER (y) m FROM (SELECT y, row_number() OVER (ORDER BY p DESC, row_id, class_idx) r,
  sum(y::INT) OVER (ORDER BY p DESC, row_id, class_idx ROWS UNBOUNDED PRECEDING) h FROM sc)),
f1 AS (SELECT class_idx, count(*) FILTER (p >= 0.5 AND y) tp, count(*) FILTER (p >= 0.5 AND NOT y) fp, count(*) FILTER (p < 0.5 AND y) fn FROM sc GROUP BY 1),
mf AS (SELECT avg(coalesce(2::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)) m FROM f1 WHERE tp + fn > 0),
ma AS (SELECT {whole_mean('a')} m FROM (SELECT {rnd('ap', 4)} a FROM ap))"""


def _mapped(tail: str) -> str:
    """One full pass over the pixels per tau."""
    return change_sql(f""", mp AS (SELECT pair_id area, CASE ca WHEN 0 THEN 'water' WHEN 1 THEN 'built_up' WHEN 2 THEN 'vegetation' ELSE 'other' END rule_class,
  CASE ("row" // 4 + col // 4 + pair_id) % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'vegetation' WHEN 2 THEN 'built_up' ELSE CASE WHEN col % 9 = 0 THEN NULL ELSE 'other' END END ref_class,
  (("row" * 31 + col * 17) % 100) / 100::DOUBLE score FROM runs WHERE main),
taus AS (SELECT round(0.05 * i, 2)::DOUBLE tau FROM range(0, 20) t(i)),
pr AS (SELECT area, tau, ref_class, CASE WHEN rule_class = 'built_up' AND score < tau THEN 'other' ELSE rule_class END pred FROM mp, taus WHERE ref_class IS NOT NULL),
cn AS (SELECT area, tau, count(*) n, count(*) FILTER (pred = 'built_up') p, count(*) FILTER (ref_class = 'built_up') r,
  count(*) FILTER (pred = 'built_up' AND ref_class = 'built_up') tp, count(*) FILTER (pred = ref_class) same FROM pr GROUP BY ALL),
rt AS (SELECT *, tp / greatest(1, p)::DOUBLE prec, tp / greatest(1, r)::DOUBLE rec FROM cn),
acc AS (SELECT area, tau, {rnd('2::DOUBLE * prec * rec / greatest(1e-9::DOUBLE, prec + rec)', 4)} built_f1, {rnd('prec', 4)} built_precision, {rnd('rec', 4)} built_recall,
  {rnd('same / n::DOUBLE', 4)} overall_accuracy, {rnd('p / n::DOUBLE * 100::DOUBLE', 2)} built_percent_pred, {rnd('r / n::DOUBLE * 100::DOUBLE', 2)} built_percent_ref FROM rt)
{tail}""")


BLOCKS = """bl AS (SELECT concat('part-', o_custkey % 7) file, o_orderkey // 50 row_group, CASE WHEN o_orderkey % 3 = 0 THEN '9-LARGE' ELSE o_orderpriority END country,
  count(*) "rows", sum(floor(o_totalprice)::BIGINT)::BIGINT bytes FROM orders GROUP BY ALL),
w AS (SELECT country, sum("rows")::BIGINT w FROM bl GROUP BY 1),
"""
# Quotas by repeated hand-out, as a recursive query.
BLOCKS += """q AS (
  WITH RECURSIVE it(i, country, w, q) AS (
    SELECT 0, country, w, least(500::DOUBLE, 2000 * w / (SELECT sum(w) FROM w)::DOUBLE) FROM w
    UNION ALL
    SELECT i + 1, country, w, CASE WHEN q < 500 - 1e-9 THEN least(500::DOUBLE, q + spare * q / nullif(open_, 0)) ELSE q END
    FROM (SELECT *, 2000 - sum(q) OVER () spare, sum(CASE WHEN q < 500 - 1e-9 THEN q ELSE 0 END) OVER () open_ FROM it) WHERE i < 40)
  SELECT country, w, q FROM it WHERE i = 40),
pk AS (SELECT bl.*, q.q, sum("rows") OVER (PARTITION BY country ORDER BY md5(concat(file, '|', row_group, '|0')), file, row_group ROWS UNBOUNDED PRECEDING) - "rows" before
  FROM bl JOIN q USING (country)),
smp AS (SELECT file, row_group, country, "rows", bytes FROM pk WHERE before < q)"""

_TONE = ("(CASE WHEN x <= 0.6 THEN x ELSE 0.6 + 0.4 * ((-(1 - s) + sqrt((1 - s) * (1 - s) + s * (4 * a))) / (2 * a)) END) * 3500")

ORACLE = {
    "qa_accuracy": f"WITH {REC}, {_accuracy('rec')}",
    "qa_type_accuracy": f"""WITH {REC}, t AS (SELECT "type", count(*) n, count(*) FILTER (predicted = answer) h FROM rec GROUP BY 1)
SELECT "type", n, {rnd('h / n::DOUBLE', 4)} accuracy FROM t""",
    "majority_baseline": f"""WITH {REC}, m AS (SELECT "type", answer predicted FROM (SELECT *, row_number() OVER (PARTITION BY "type"
  ORDER BY n DESC, f) r FROM (SELECT "type", answer, count(*) n, min(qid) f FROM rec WHERE qid % 3 <> 0 GROUP BY ALL)) WHERE r = 1),
r2 AS (SELECT rec."type", rec.answer, m.predicted FROM rec LEFT JOIN m USING ("type") WHERE qid % 3 = 0), {_accuracy('r2')}""",
    "qa_evaluation": f"""WITH {REC}, te AS (SELECT * FROM rec WHERE qid % 3 = 0), m AS (SELECT "type", answer predicted FROM (SELECT *, row_number() OVER (PARTITION BY "type"
  ORDER BY n DESC, f) r FROM (SELECT "type", answer, count(*) n, min(qid) f FROM rec WHERE qid % 3 <> 0 GROUP BY ALL)) WHERE r = 1),
ze AS (SELECT "type", answer, CASE "type" WHEN 'count' THEN NULL WHEN 'rural_urban' THEN 'rural' ELSE 'yes' END predicted FROM te),
ma AS (SELECT te."type", te.answer, m.predicted FROM te LEFT JOIN m USING ("type"))
SELECT 'head' AS "method", * FROM (WITH {_accuracy('te')}) UNION ALL SELECT 'zero-shot', * FROM (WITH {_accuracy('ze')}) UNION ALL SELECT 'majority', * FROM (WITH {_accuracy('ma')})""",
    "answer_vocab": f"WITH {REC}, {_vocab(2)} SELECT * FROM voc",
    "answers_by_type": f"""WITH {REC}, {_vocab(2)} SELECT "type", count(DISTINCT answer) answers, min(answer) first_answer FROM rec
WHERE answer IN (SELECT answer FROM voc) GROUP BY 1""",
    "label_index": f"""WITH {REC}, {_vocab(15)} SELECT qid, coalesce("index", -1) AS "index" FROM rec LEFT JOIN voc USING (answer)""",
    "average_precision": f"WITH {APS} SELECT class_idx, round(ap, 6) average_precision, pos positives FROM ap",
    "micro_map": f"WITH {APS} SELECT {rnd('m', 4)} micro_map FROM mi",
    "macro_f1": f"WITH {APS} SELECT {rnd('m', 4)} macro_f1 FROM mf",
    "multilabel_metrics": f"""WITH {APS} SELECT 'micro_map' metric, {rnd('m', 4)} AS "value" FROM mi UNION ALL
SELECT 'macro_map', {rnd('m', 4)} FROM ma UNION ALL SELECT 'macro_f1', {rnd('m', 4)} FROM mf""",
    "map_f1": _mapped("SELECT * FROM acc"),
    "tau_tuning": _mapped(f""", bt AS (SELECT tau FROM acc WHERE area IN (0, 1) AND tau > 0 GROUP BY tau ORDER BY {whole_mean('built_f1')} DESC, tau LIMIT 1),
ga AS (SELECT m.tau, m.built_f1 mf, r.built_f1 rf FROM acc m JOIN bt USING (tau) JOIN acc r ON r.area = m.area AND r.tau = 0 WHERE m.area IN (2, 3)),
gb AS (SELECT tau, {rnd('mf - rf', 4)} gain FROM ga),
gs AS (SELECT tau, {whole_mean('gain')} mg, min(gain) worst_gain FROM gb GROUP BY 1),
z AS (SELECT tau, {rnd('mg', 4)} mean_gain, worst_gain FROM gs) SELECT *, mean_gain >= 0.03 AND worst_gain >= 0 passes FROM z"""),
    "built_share": _mapped(f""", bs AS (SELECT area, count(*) n, count(*) FILTER (rule_class = 'built_up') r,
  count(*) FILTER (rule_class = 'built_up' AND score >= 0.35) m FROM mp GROUP BY 1)
SELECT area, {pct('r', 'n')} rules_percent, {pct('m', 'n')} model_percent FROM bs"""),
    "group_quotas": f"""WITH {BLOCKS} SELECT country, w AS "rows", round(q, 6) quota FROM q""",
    "capped_sample": f"WITH {BLOCKS} SELECT * FROM smp",
    "sample_summary": f"""WITH {BLOCKS} SELECT country, sum("rows")::BIGINT AS "rows", sum(bytes)::BIGINT bytes, count(*) blocks, count(DISTINCT file) shards FROM smp GROUP BY 1""",
    "band_stats": f"""WITH {obs()}, k AS (SELECT nir::DOUBLE nir, pow(j * 5 / 255::DOUBLE, 2.2) x FROM obs),
l AS (SELECT nir, x, greatest((x - 0.6) / 0.4, 0) s, 1 / pow((12000::DOUBLE / 3500 - 0.6) / 0.4, 2) a FROM k),
m AS (SELECT nir, {_TONE} red FROM l)
SELECT round(avg(red), 4) mean_red, round(stddev_pop(red), 4) std_red, round(avg(nir), 4) mean_nir, round(stddev_pop(nir), 4) std_nir FROM m""",
}

ORACLE["type_detection"] = f"""WITH {REC}, {LOG}, j AS (SELECT {_type('question')} t, "type" ty, (qid % 64) / 64::DOUBLE p FROM lg JOIN rec USING (qid)),
a AS (SELECT count(*) n, avg((t = ty)::INT::DOUBLE) f, avg(p) p FROM j) SELECT n, {rnd('f', 4)} type_detection_accuracy, {rnd('p', 4)} mean_confidence FROM a"""
