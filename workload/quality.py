"""Queries on predictions, labels, map accuracy and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import indices as ix
from pixelloom.operators import change as ch
from pixelloom.operators import evaluation as ev
from pixelloom.operators import sampling as sm
from pixelloom.session import stable
from workload import derived as d
from workload import language as lg

CLASSES = 64  # as many as an embedding has numbers


def _records(spark, sf):
    """Questions with answers and predictions, one per event."""
    return d.table(spark, sf, "events").selectExpr(
        "event_id qid",
        "case event_type when 'signup' then 'comp' when 'click' then 'count' when 'purchase' then 'rural_urban' else 'presence' end type",
        "case event_type when 'click' then cast(user_id * user_id % 1300 as string) when 'purchase' then if(user_id % 3 = 0, 'rural', 'urban') "
        "else if(user_id % 5 < 2, 'no', 'yes') end answer",
        "case when event_id % 9 = 0 then null when event_type = 'click' then cast(user_id * user_id % 1300 + event_id % 3 * 4 as string) "
        "when event_type = 'purchase' then if(event_id % 2 = 0, 'rural', 'urban') else if(event_id % 7 < 3, 'no', 'yes') end predicted")


def qa_accuracy(spark, sf):
    return ev.qa_accuracy(_records(spark, sf))


def qa_type_accuracy(spark, sf):
    return ev.qa_type_accuracy(_records(spark, sf))


def _majority(records):
    """The most frequent answers of two thirds of the questions, scored on the last third."""
    return ev.majority_baseline(records.where("qid % 3 <> 0"), records.where("qid % 3 = 0"))


def majority_baseline(spark, sf):
    return ev.qa_accuracy(_majority(_records(spark, sf)))


def qa_evaluation(spark, sf):
    """Three methods on the same held-out questions."""
    records = _records(spark, sf)
    test = records.where("qid % 3 = 0")
    zero = test.withColumn("predicted", F.expr("case type when 'count' then null when 'rural_urban' then 'rural' else 'yes' end"))
    return ev.qa_comparison({"head": test, "zero-shot": zero, "majority": _majority(records)})


def type_detection(spark, sf):
    """How often the wording gives the type of the event."""
    asked = lg._log(spark, sf).select("qid", "question").join(_records(spark, sf).select("qid", "type"), "qid")
    return ev.type_detection(asked.withColumn("probability", F.expr("(qid % 64) / 64D")))


def answer_vocab(spark, sf):
    return ev.answer_vocabulary(_records(spark, sf), 2)


def answers_by_type(spark, sf):
    records = _records(spark, sf)
    return ev.answers_by_type(records, ev.answer_vocabulary(records, 2)).groupBy("type").agg(
        F.count(F.lit(1)).alias("answers"), F.min("answer").alias("first_answer"))


def label_index(spark, sf):
    records = _records(spark, sf)
    return ev.label_index(records, ev.answer_vocabulary(records, 15)).select("qid", "index")


def _scored(spark, sf):
    """A label and a two-decimal score per (vector, class): ties are common."""
    return d.table(spark, sf, "embeddings").selectExpr(
        "vec_id row_id", "label", f"inline(transform(sequence(0, {CLASSES - 1}), c -> named_struct('class_idx', c, 'e', element_at(embedding, c + 1))))"
    ).selectExpr("row_id", "class_idx", "label = class_idx or (row_id + class_idx) % 17 = 0 y",
                 "cast(floor(greatest(0D, least(1D, 0.5D + cast(e as double) + if(label = class_idx, 0.125D, 0D))) * 128D) as double) / 128D p")


def average_precision(spark, sf):
    return ev.class_average_precision(_scored(spark, sf)).withColumn("average_precision", F.round("average_precision", 6))


def micro_map(spark, sf):
    return ev.micro_map(_scored(spark, sf), CLASSES)


def macro_f1(spark, sf):
    return ev.macro_f1(_scored(spark, sf))


def multilabel_metrics(spark, sf):
    return ev.multilabel_metrics(_scored(spark, sf), CLASSES)


def _mapped(spark, sf):
    """Rule class, reference class and model score of each compared pixel of the second date."""
    pixels = ch.compared_pixels(d.dated_pixels(spark, sf, False), d.dated_pixels(spark, sf, True), d.pair_catalogue(spark, sf))
    names = {code: name for name, code in ix.CLASS_CODES.items()}
    code = F.expr("case (row div 4 + col div 4 + pair_id) % 4 when 0 then 80 when 1 then 10 when 2 then 50 else if(col % 9 = 0, 70, 60) end")
    return ch.class_map(pixels).select(
        F.col("pair_id").alias("area"), ix.case_literal(F.col("after_code"), names).alias("rule_class"),
        ix.recode_cover_map(code).alias("ref_class"), F.expr("((row * 31 + col * 17) % 100) / 100D").alias("score"))


def map_f1(spark, sf):
    return ev.map_accuracy(ev.tau_counts(_mapped(spark, sf)))


def tau_tuning(spark, sf):
    accuracy = stable(ev.map_accuracy(ev.tau_counts(_mapped(spark, sf))))  # areas x 20 rows, read three times
    return ev.adopt_decision(accuracy, ev.best_tau(accuracy, [0, 1]), [2, 3])


def built_share(spark, sf):
    return ev.built_share(_mapped(spark, sf), 0.35)


def _blocks(spark, sf):
    """Row blocks; one country holds a third of the rows."""
    return d.table(spark, sf, "orders").selectExpr(
        "concat('part-', cast(o_custkey % 7 as string)) file", "o_orderkey div 50 row_group",
        "if(o_orderkey % 3 = 0, '9-LARGE', o_orderpriority) country", "o_totalprice"
    ).groupBy("file", "row_group", "country").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.floor("o_totalprice")).alias("bytes"))


def group_quotas(spark, sf):
    return sm.group_quotas(_blocks(spark, sf), 2000, 0.25).withColumn("quota", F.round("quota", 6))


def capped_sample(spark, sf):
    return sm.capped_sample(_blocks(spark, sf), 2000, 0.25)


def sample_summary(spark, sf):
    return sm.sample_summary(sm.capped_sample(_blocks(spark, sf), 2000, 0.25))


def row_block_inventory(spark, sf):
    blocks = sm.row_blocks(d.table(spark, sf, "orders"), "o_orderpriority", "8 + length(o_orderpriority)")
    return blocks.groupBy("country").agg(F.count(F.lit(1)).alias("blocks"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def band_stats(spark, sf):
    from pixelloom.functions.indices import inverse_tone_map

    df = d.observations(spark, sf).select(inverse_tone_map(F.col("j") * 5).alias("red"), F.col("nir").cast("double").alias("nir"))
    stats = sm.band_stats(df, ["red", "nir"])
    return stats.withColumns({c: F.round(c, 4) for c in stats.columns})


QUERIES = {f.__name__: f for f in (
    qa_accuracy, qa_type_accuracy, majority_baseline, qa_evaluation, type_detection, answer_vocab, answers_by_type, label_index, average_precision, micro_map,
    macro_f1, multilabel_metrics, map_f1, tau_tuning, built_share, group_quotas, capped_sample, sample_summary,
    row_block_inventory, band_stats)}
