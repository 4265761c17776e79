"""Accuracy jobs: question answering, multi-label scores, map accuracy and threshold tuning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import questions as q
from pixelloom.functions.questions import count_bin
from pixelloom.functions.semantics import percent, round_binary, rounded, steady_mean
from pixelloom.operators.ordered import magnitude_bin, running_totals

# Thresholds tried, gain needed to adopt the model.
TAUS = tuple(round(0.05 * i, 2) for i in range(1, 20))
MIN_GAIN = 0.03


# ------------------------------------------------------------------------------ question answering

def qa_type_totals(records: DataFrame) -> DataFrame:
    """Hits and counts per question type of ``(type, answer, predicted)``; a missing prediction is a miss."""
    binned = F.when(F.col("type") == "count", (F.col("predicted").isNotNull() & F.expr(
        f"{count_bin('predicted')} <=> {count_bin('answer')}")).cast("int"))
    return records.withColumn("__bin_hit", binned).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("answer")).alias("hits"),
        F.count("predicted").alias("answered"), F.sum("__bin_hit").alias("bin_hits"))


def qa_type_accuracy(records: DataFrame) -> DataFrame:
    return qa_type_totals(records).select("type", "n", round_binary("hits / cast(n as double)", 4).alias("accuracy"))


def qa_accuracy(records: DataFrame) -> DataFrame:
    """One row: overall accuracy, average of the rounded accuracies per type, binned count accuracy."""
    totals = qa_type_totals(records).withColumn("__acc", round_binary("hits / cast(n as double)", 4))
    sums = totals.agg(F.sum("hits").alias("h"), F.sum("n").alias("n"), F.expr(steady_mean("__acc", 4)).alias("aa"),
                      F.sum("bin_hits").alias("bh"), F.sum(F.when(F.col("type") == "count", F.col("n"))).alias("bn"),
                      F.sum("answered").alias("answered"))
    return sums.select(round_binary("try_divide(h, n)", 4).alias("overall_accuracy"),
                       round_binary("aa", 4).alias("average_accuracy"),
                       round_binary("try_divide(bh, bn)", 4).alias("count_binned_accuracy"), "answered", "n")


def qa_comparison(methods: dict[str, DataFrame]) -> DataFrame:
    """The accuracies of several methods on the same questions, one row each: ``method`` and the columns of ``qa_accuracy``."""
    rows = [qa_accuracy(records).select(F.lit(name).alias("method"), "*") for name, records in methods.items()]
    return reduce(DataFrame.unionByName, rows)


def type_detection(records: DataFrame, question: str = "question") -> DataFrame:
    """Share of questions whose type the wording gives, and the mean confidence where there is a ``probability``."""
    found = F.avg((q.question_type(F.col(question)) == F.col("type")).cast("double"))  # whole numbers, so exact in any order
    sure = F.expr(steady_mean("probability")) if "probability" in records.columns else F.lit(None).cast("double")
    return records.agg(F.count(F.lit(1)).alias("n"), found.alias("__f"), sure.alias("__p")).select(
        "n", round_binary("__f", 4).alias("type_detection_accuracy"), round_binary("__p", 4).alias("mean_confidence"))


def majority_answers(train: DataFrame) -> DataFrame:
    """Most frequent answer per type; the answer seen first wins a tie. Two combined aggregations, no window."""
    counts = train.groupBy("type", "answer").agg(F.count(F.lit(1)).alias("n"), F.min("qid").alias("first"))
    return counts.groupBy("type").agg(F.max_by("answer", F.struct(F.col("n"), -F.col("first"))).alias("predicted"))


def majority_baseline(train: DataFrame, records: DataFrame) -> DataFrame:
    return records.drop("predicted").join(majority_answers(train), "type", "left")


def answer_vocabulary(records: DataFrame, min_count: int = 1) -> DataFrame:
    """Answers with their index: most frequent first, then by text.

    The index is a running count over (count, leading letters) buckets, so the many answers that occur
    once are not sorted in one task.
    """
    counts = records.groupBy("answer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    ranked = counts.withColumns({"__bucket": F.struct((-F.col("n")).alias("n"), F.substring("answer", 1, 3).alias("p")),
                                 "__one": F.lit(1)})
    return running_totals(ranked, [], "__bucket", [F.col("answer")], {"__pos": "__one"}).select(
        "answer", "n", (F.col("__pos") - 1).alias("index"))


def answers_by_type(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct (type, answer) pairs of the vocabulary."""
    return records.select("type", "answer").distinct().join(vocabulary.select("answer"), "answer", "left_semi")


def label_index(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Index of each record's answer, -1 when it is not in the vocabulary."""
    return records.join(vocabulary.select("answer", "index"), "answer", "left").withColumn(
        "index", F.coalesce("index", F.lit(-1)))


# ------------------------------------------------------------------------------ multi-label scores

def average_precision(scored: DataFrame, keys: Sequence[str], order_id: str = "id", score: str = "p", label: str = "y",
                      id_block: int = 1 << 20) -> DataFrame:
    """Mean precision at the rank of each positive, by falling score; ties in order of ``order_id``.

    NULL when a key has no positives. A rank is the sum of three counts, each worked out in small
    pieces: rows in higher score bins, rows with a higher score in the same bin, and earlier rows
    with the very same score, by blocks of ``id_block`` ids. A score that a third of all rows share
    is therefore spread over its id blocks.
    """
    keys = list(keys)
    rows = scored.selectExpr(*keys, f"{order_id} __id", f"cast({score} as double) __p", f"cast({label} as int) __y",
                             f"cast(floor({order_id} / {id_block}D) as bigint) __block")
    here = Window.partitionBy(*keys, "__p", "__block").orderBy("__id")
    ranked = rows.withColumns({"__r": F.row_number().over(here), "__h": F.sum("__y").over(
        here.rowsBetween(Window.unboundedPreceding, Window.currentRow))})

    blocks = rows.groupBy(*keys, "__p", "__block").agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__k"))
    earlier = Window.partitionBy(*keys, "__p").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"__n_tie": F.coalesce(F.sum("__n").over(earlier), F.lit(0)),
                                 "__k_tie": F.coalesce(F.sum("__k").over(earlier), F.lit(0))})
    scores = blocks.groupBy(*keys, "__p").agg(F.sum("__n").alias("__sn"), F.sum("__k").alias("__sk")).withColumn(
        "__bin", -magnitude_bin(F.col("__p")))
    upto = running_totals(scores, keys, "__bin", [F.desc("__p")], {"__cn": "__sn", "__ck": "__sk"})
    offsets = blocks.join(upto, keys + ["__p"]).selectExpr(
        *keys, "__p", "__block", "__cn - __sn + __n_tie __n0", "__ck - __sk + __k_tie __k0")
    hits = ranked.where("__y = 1").join(offsets, keys + ["__p", "__block"])
    sums = hits.groupBy(*keys).agg(F.sum(F.expr("(__k0 + __h) / cast(__n0 + __r as double)")).alias("__precision"),
                                   F.count(F.lit(1)).alias("positives"))
    if not keys:
        return sums.selectExpr("try_divide(__precision, positives) average_precision", "positives")
    every = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return every.join(sums, keys, "left").selectExpr(
        *keys, "try_divide(__precision, positives) average_precision", "coalesce(positives, 0) positives")


def class_average_precision(scored: DataFrame) -> DataFrame:
    """Average precision per class of ``(row_id, class_idx, y, p)``."""
    return average_precision(scored, ["class_idx"], "row_id")


def micro_map(scored: DataFrame, classes: int) -> DataFrame:
    """Average precision over all (row, class) cells at once; ties in row order, then class order."""
    cells = scored.withColumn("__cell", F.col("row_id") * classes + F.col("class_idx"))
    return average_precision(cells, [], "__cell").select(round_binary("average_precision", 4).alias("micro_map"))


def class_f1(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    pred, y = F.col("p") >= threshold, F.col("y")
    counts = scored.groupBy("class_idx").agg(
        F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"), F.count_if(~pred & y).alias("fn"))
    return counts.withColumn("f1", F.expr("coalesce(try_divide(2D * tp, 2D * tp + fp + fn), 0D)"))


def macro_f1(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean F1 over the classes that have positives."""
    return class_f1(scored, threshold).where("tp + fn > 0").agg(F.expr(steady_mean("f1")).alias("f")).select(
        round_binary("f", 4).alias("macro_f1"))


def macro_map(scored: DataFrame) -> DataFrame:
    """Mean of the rounded average precisions of the classes that have one."""
    per_class = class_average_precision(scored).select(round_binary("average_precision", 4).alias("ap"))
    return per_class.agg(F.expr(steady_mean("ap", 4)).alias("m")).select(round_binary("m", 4).alias("macro_map"))


def multilabel_metrics(scored: DataFrame, classes: int, threshold: float = 0.5) -> DataFrame:
    """Rows (metric, value) for micro mAP, macro mAP and macro F1."""
    parts = [micro_map(scored, classes), macro_map(scored), macro_f1(scored, threshold)]
    out = None
    for part in parts:
        row = part.selectExpr(f"'{part.columns[0]}' metric", f"{part.columns[0]} value")
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------------------------ map accuracy

def tau_counts(pixels: DataFrame, taus: Sequence[float] = TAUS) -> DataFrame:
    """Pixels per (area, rule class, reference class, number of taus the score reaches). The only pixel pass."""
    reached = " + ".join(f"if(score >= {t!r}D, 1, 0)" for t in taus)
    return pixels.where("ref_class is not null").groupBy("area", "rule_class", "ref_class", F.expr(f"{reached} reached")).agg(
        F.count(F.lit(1)).alias("n"))


def map_accuracy(counts: DataFrame, taus: Sequence[float] = TAUS) -> DataFrame:
    """Built-up precision, recall, F1, overall accuracy and shares per area: the rules alone (``tau`` 0) and
    with the model veto at each tau. Built-up stays where the score reaches the tau."""
    runs = ", ".join(f"named_struct('i', {i}, 'tau', {t!r}D)" for i, t in enumerate((0.0, *taus)))
    runs_of = counts.selectExpr("*", f"inline(array({runs}))").withColumn(
        "pred", F.expr("if(rule_class = 'built_up' and reached < i, 'other', rule_class)"))
    sums = runs_of.groupBy("area", "tau").agg(
        F.sum("n").alias("n"), F.expr("sum(if(pred = 'built_up', n, 0)) p"), F.expr("sum(if(ref_class = 'built_up', n, 0)) r"),
        F.expr("sum(if(pred = 'built_up' and ref_class = 'built_up', n, 0)) tp"), F.expr("sum(if(pred = ref_class, n, 0)) same"))
    rates = sums.withColumns({"prec": F.expr("tp / cast(greatest(1, p) as double)"),
                              "rec": F.expr("tp / cast(greatest(1, r) as double)")})
    return rates.select(
        "area", "tau", round_binary("2D * prec * rec / greatest(1e-9D, prec + rec)", 4).alias("built_f1"),
        round_binary("prec", 4).alias("built_precision"), round_binary("rec", 4).alias("built_recall"),
        round_binary("same / cast(n as double)", 4).alias("overall_accuracy"),
        round_binary("p / cast(n as double) * 100D", 2).alias("built_percent_pred"),
        round_binary("r / cast(n as double) * 100D", 2).alias("built_percent_ref"))


def best_tau(accuracy: DataFrame, tune: Sequence) -> DataFrame:
    """The tau with the highest mean F1 on the tuning areas; the lowest one on a tie."""
    means = accuracy.where(F.col("area").isin(*tune) & (F.col("tau") > 0)).groupBy("tau").agg(F.expr(steady_mean("built_f1", 4)).alias("f1"))
    return means.agg(F.max_by("tau", F.struct(F.col("f1"), -F.col("tau"))).alias("tau"))


def adopt_decision(accuracy: DataFrame, tau: DataFrame, holdout: Sequence, min_gain: float = MIN_GAIN) -> DataFrame:
    """Gain of the veto at the chosen tau on the holdout areas, and whether it passes: mean gain reached, no area worse."""
    held = accuracy.where(F.col("area").isin(*holdout))
    rules = held.where("tau = 0").selectExpr("area", "built_f1 rules_f1")
    model = held.join(tau, "tau").selectExpr("area", "tau", "built_f1 model_f1")
    gains = rules.join(model, "area").withColumn("gain", round_binary("model_f1 - rules_f1", 4))
    return gains.groupBy("tau").agg(F.expr(steady_mean("gain", 4)).alias("__mean"), F.min("gain").alias("worst_gain")).selectExpr(
        "tau", f"{rounded('__mean', 4)} mean_gain", "worst_gain").withColumn(
        "passes", (F.col("mean_gain") >= min_gain) & (F.col("worst_gain") >= 0))


def built_share(pixels: DataFrame, tau: float) -> DataFrame:
    """Built-up share of an image by the rules alone and with the veto (the season case)."""
    sums = pixels.groupBy("area").agg(
        F.count(F.lit(1)).alias("n"), F.expr("count_if(rule_class = 'built_up') r"),
        F.expr(f"count_if(rule_class = 'built_up' and score >= {tau!r}D) m"))
    return sums.select("area", percent("r", "n").alias("rules_percent"), percent("m", "n").alias("model_percent"))


def compare_models(before: DataFrame, after: DataFrame, classes: int, threshold: float = 0.5) -> DataFrame:
    """Multi-label metrics of two models side by side, with the change."""
    b = multilabel_metrics(before, classes, threshold).withColumnRenamed("value", "before")
    a = multilabel_metrics(after, classes, threshold).withColumnRenamed("value", "after")
    return b.join(a, "metric").withColumn("change", round_binary("after - before", 4))
