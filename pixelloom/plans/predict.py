"""Batch prediction: the manifest as one table through validation, classification, routing and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.catalogue import validate_pairs
from pixelloom.operators.questions import classify_questions, route_tasks

# What a prediction can be, and the mode of an item that names none.
STATUSES = ("OK", "REJECTED", "NOT_AVAILABLE", "ERROR")
ONE_IMAGE, TWO_IMAGES = "single", "optical_sar"


def canonical_answer(status: str = "status", short_answer: str = "short_answer", answer: str = "answer"):
    """NULL unless OK; the short answer where there is one, else the text."""
    return F.expr(f"if({status} = 'OK', coalesce({short_answer}, {answer}), null)")


def predict(items: DataFrame, validation: DataFrame, results: DataFrame, task: str = "auto") -> DataFrame:
    """One prediction per item ``(id, upload_id, mode, question)``.

    ``validation`` is ``(upload_id, ok)``; ``results`` is ``(upload_id, task, status, answer, short_answer,
    confidence)`` as the analysis jobs write it. Rejected uploads, unknown questions and questions that do
    not fit the mode are REJECTED; a task without a result is NOT_AVAILABLE.
    """
    classified = route_tasks(classify_questions(items))
    checked = classified.join(validation.select("upload_id", "ok"), "upload_id", "left")
    runs = checked.withColumn("__run", F.when(F.col("ok"), F.col("routed_task")))
    found = results.select("upload_id", F.col("task").alias("__run"), F.col("status").alias("__status"), "answer", "short_answer", "confidence")
    joined = runs.drop("confidence").join(found, ["upload_id", "__run"], "left")
    status = F.when(~F.coalesce("ok", F.lit(False)) | F.col("routed_task").isNull(), "REJECTED").otherwise(
        F.coalesce("__status", F.lit("NOT_AVAILABLE")))
    shown = joined.withColumn("status", status)
    used = F.coalesce("routed_task", "task")
    mismatch = F.lit(None).cast("string") if task == "auto" else F.when(
        F.col("ok") & (used != task), F.concat(F.lit("routed to '"), used, F.lit(f"', not '{task}'")))
    return shown.select("id", "upload_id", "question", "status", canonical_answer().alias("answer"),
                        F.when(F.col("status") == "OK", F.col("confidence")).alias("confidence"),
                        F.when(F.col("ok"), used).alias("task"), mismatch.alias("task_mismatch"))


def manifest_files(items: DataFrame, files: DataFrame) -> DataFrame:
    """The catalogue rows of a manifest: one per item and image, in order, with the facts that ``files`` has by ``path``.

    ``items`` is as ``sources.readers`` gives it: ``id``, ``images``, and where given ``mode``, ``dates`` and ``band_roles``.
    Without a mode one image is ``single`` and two are a pair of optical and radar. An image that ``files`` lacks has NULL facts.
    """
    mode = F.coalesce("mode", F.when(F.size("images") == 1, ONE_IMAGE).otherwise(TWO_IMAGES))
    each = items.select(F.col("id").alias("upload_id"), mode.alias("mode"), "dates", "band_roles", F.posexplode("images").alias("__i", "path"))
    known = files.drop("upload_id", "slot", "mode", "date", "band_roles")
    return each.withColumns({"slot": F.col("__i") + 1, "date": F.get("dates", F.col("__i")), "band_roles": F.get("band_roles", F.col("__i")),
                             "filename": F.regexp_extract("path", r"[^/\\]*$", 0)}).drop("dates", "__i").join(
        known.drop("filename"), "path", "left")


def run_manifest(items: DataFrame, files: DataFrame, results: DataFrame, today: str, task: str = "auto") -> DataFrame:
    """Batch prediction from the manifest on: files are validated as uploads are, questions classified and routed, answers looked up.

    ``files`` has the facts of every image by ``path``. ``results`` is ``(upload_id, task, status, answer, short_answer, confidence,
    tool, tool_version, answered_by)``. One row per item: id, question, status, answer, confidence, task, tool, tool_version,
    answered_by, ``reasons`` of a rejected upload (codes and messages), ``reason`` why an accepted one has no answer, task_mismatch.
    A rejected upload has no task, tool or answer.
    """
    checked = validate_pairs(manifest_files(items, files), today).select("upload_id", "ok", "reasons", F.col("mode").alias("__mode"))
    asked = items.select("id", F.col("id").alias("upload_id"), "question").join(checked, "upload_id", "left")
    routed = route_tasks(classify_questions(asked.withColumnRenamed("__mode", "mode")))
    ok = F.coalesce("ok", F.lit(False))
    runs = routed.withColumn("__run", F.when(ok, F.col("routed_task"))).drop("confidence")
    found = results.select("upload_id", F.col("task").alias("__run"), F.col("status").alias("__status"), "answer", "short_answer", "confidence",
                           "tool", "tool_version", "answered_by")
    done = runs.join(found, ["upload_id", "__run"], "left").withColumn("status", F.when(~ok | F.col("__run").isNull(), "REJECTED").otherwise(
        F.coalesce("__status", F.lit("NOT_AVAILABLE"))))
    used = F.coalesce("__run", F.when(ok, F.col("task")))
    why = (F.when(~ok | (F.col("status") == "OK"), F.lit(None).cast("string")).when(F.col("__run").isNull(), "the question does not fit the images")
           .otherwise(F.coalesce("answer", F.lit("no result for this task"))))
    mismatch = F.lit(None).cast("string") if task == "auto" else F.when(ok & (used != task), F.concat(F.lit("routed to '"), used, F.lit(f"', not '{task}'")))
    return done.select("id", "question", "status", canonical_answer().alias("answer"), F.when(ok, F.col("confidence")).alias("confidence"), used.alias("task"),
                       "tool", "tool_version", "answered_by", F.when(~ok, F.col("reasons")).alias("reasons"), why.alias("reason"), mismatch.alias("task_mismatch"))


def status_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
