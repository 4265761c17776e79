"""Question-log jobs: task classification with a typo-tolerant fallback, and routing to a mode."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import questions as q

#: A text with so many rows is classified beside the join of the others. What is above it changes speed and nothing else.
COMMON = 10_000


def _closest(words: pd.Series) -> pd.Series:
    """Closest vocabulary word per input word, or None. Similarity is difflib's ratio."""
    targets = [w for group in q.VOCABULARY.values() for w in group]

    def one(word):
        close = difflib.get_close_matches(word, targets, n=1, cutoff=q.FUZZY_CUTOFF)
        return close[0] if close else None

    return words.map(one)


def fuzzy_votes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Task with the most similar words per text, for texts no rule matches.

    Words are made distinct before they meet Python, so each spelling is compared once however often
    it occurs. Votes count occurrences; ties go to the task of higher priority.
    """
    words = texts.select(key, F.posexplode(F.regexp_extract_all(
        F.replace(F.lower(text), F.lit("-"), F.lit("")), F.lit("([a-z]+)"), 1)).alias("pos", "word")).where(F.length("word") >= 4)
    closest = F.pandas_udf(_closest, "string").asNondeterministic()  # else the filter on its result runs it again
    known = words.select("word").distinct().withColumn("target", closest("word")).where(F.col("target").isNotNull())
    task_of = {w: t for t, group in q.VOCABULARY.items() for w in group}
    priority = {t: i for i, t in enumerate(q.RULES)}
    matched = words.join(known, "word").withColumn("task", q.case_literal(F.col("target"), task_of))
    votes = matched.groupBy(key, "task").agg(
        F.count(F.lit(1)).alias("votes"),
        F.sort_array(F.collect_list(F.struct("pos", F.concat_ws("~", "word", "target").alias("m")))).alias("__m"))
    best = F.max_by(F.struct("task", F.col("__m.m").alias("matched")),
                    F.struct(F.col("votes"), -q.case_literal(F.col("task"), priority)))
    return votes.groupBy(key).agg(best.alias("__b")).select(key, "__b.task", "__b.matched")


def classify_questions(questions: DataFrame, text: str = "question", common: int = COMMON) -> DataFrame:
    """Adds task, method, matched words, confidence and the other tasks that matched.

    Equal texts are classified once: the log is reduced to distinct texts first and joined back. The distinct texts
    are kept on the executors with the tasks their rules match: a filter on these tasks would else move ahead of
    the reduction and run the rules on every row, once per branch. Texts with ``common`` rows or more are few and
    reach their rows as a broadcast, so no text has more rows in one task of the join than that.
    """
    log = questions.withColumn("__text", F.coalesce(text, F.lit("")))
    hits = log.groupBy("__text").agg(F.count(F.lit(1)).alias("__n")).withColumn("__hits", q.task_hits(F.col("__text"))).persist()
    often, seldom = hits.where(F.col("__n") >= common), hits.where(F.col("__n") < common)
    near = log.join(F.broadcast(_classified(often)), "__text")
    far = log.join(F.broadcast(often.select("__text")), "__text", "left_anti").join(_classified(seldom), "__text")
    return near.unionByName(far).drop("__text")


def _classified(hits: DataFrame) -> DataFrame:
    """The classification of distinct texts ``(__text, __hits)``."""
    ruled = hits.where(F.size("__hits") > 0).withColumn("task", F.col("__hits")[0]).withColumn(
        "also_matched", F.array_remove(F.slice(F.col("__hits"), F.lit(2), F.size("__hits")), "vqa"))
    ruled = ruled.select(
        "__text", "task", F.lit("rules").alias("method"), q.matched_terms(F.col("__text"), F.col("task")).alias("matched"),
        F.when(F.col("task") == "vqa", q.GENERIC_CONFIDENCE).when(F.size("also_matched") > 0, q.CONFLICT_CONFIDENCE)
        .otherwise(q.RULE_CONFIDENCE).alias("confidence"), "also_matched")
    rest = hits.where(F.size("__hits") == 0).select("__text")
    fuzzy = rest.join(fuzzy_votes(rest, "__text", "__text"), "__text", "left").select(
        "__text", F.coalesce("task", F.lit("unknown")).alias("task"),
        F.when(F.col("task").isNull(), "none").otherwise("fuzzy_keywords").alias("method"),
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
        F.when(F.col("task").isNull(), 0.0).otherwise(q.FUZZY_CONFIDENCE).alias("confidence"),
        F.array().cast("array<string>").alias("also_matched"))
    return ruled.unionByName(fuzzy)


def route_tasks(df: DataFrame, task: str = "task", mode: str = "mode") -> DataFrame:
    """Adds the task that runs on the upload mode (NULL: rejected) and the task it was rerouted from."""
    t, m = F.col(task), F.col(mode)
    return df.withColumns({"routed_task": q.routed(t, m), "rerouted_from": q.rerouted_from(t, m)})


def before_after_order(files: DataFrame) -> DataFrame:
    """1 for the earlier file of an upload, 2 for the later; missing dates first, then by slot."""
    order = Window.partitionBy("upload_id").orderBy(F.coalesce("date", F.lit("")), "slot")
    return files.withColumn("position", F.row_number().over(order))
