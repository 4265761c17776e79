"""Queries on answers, predictions, fetch plans and clipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import wording as wd
from pixelloom.operators import change as ch
from pixelloom.operators import cover as cv
from pixelloom.operators import fusion as fu
from pixelloom.plans import answers as an
from pixelloom.plans import fetch as ft
from pixelloom.plans import predict as pr
from workload import derived as d
from workload import language as lg


def _change(spark, sf):
    return ch.analyse_change(d.dated_pixels(spark, sf, False), d.dated_pixels(spark, sf, True), d.pair_catalogue(spark, sf))


def change_lines(spark, sf):
    return an.change_lines(_change(spark, sf).classes, d.pair_catalogue(spark, sf)).select("pair_id", "class", "line")


def change_answers(spark, sf):
    df = an.change_answers(_change(spark, sf), d.pair_catalogue(spark, sf))
    return df.select("pair_id", "answer", "headline", F.concat_ws("|", "caveats").alias("caveats"),
                     F.concat_ws(",", wd.banned_terms(F.concat_ws(" ", "headline", "caveats"))).alias("banned"))


def class_headlines(spark, sf):
    return an.class_headlines(_change(spark, sf).classes)


def fusion_answers(spark, sf):
    pairs, optical, radar = d.pair_catalogue(spark, sf), d.dated_pixels(spark, sf, True), d.radar_pixels(spark, sf)
    df = an.fusion_answers(fu.map_water_builtup(optical, radar, pairs), fu.radar_profile(radar, pairs), pairs)
    return df.select("pair_id", "answer", "headline", "worst_agreement", F.concat_ws("|", "caveats").alias("caveats"))


def _kept_pixels(spark, sf):
    """Pixels of both dates, kept on the executors for those who read them as pixels and as scenes."""
    return d.pixels_of_dates(spark, sf).select(*ch.KEY, "late", "green", "red", "nir", "swir1").persist()


def _kept_change(pixels, pairs):
    return ch.analyse_change(d.one_date(pixels, False), d.one_date(pixels, True), pairs)


def _model(pixels):
    """Scene scores of both dates (mean brightness of the red band); one pair's later image is unlike the training data."""
    scores = pixels.groupBy("pair_id", "late").agg((F.avg("red") / 1000.0).alias("score")).withColumns(
        {"date": F.expr("if(late, 'after', 'before')"), "in_distribution": (F.col("pair_id") != 2) | ~F.col("late")})
    return ch.model_direction(scores)


def built_up_verdict(spark, sf):
    """Rules against the model."""
    pixels, pairs = _kept_pixels(spark, sf), d.pair_catalogue(spark, sf)
    result = _kept_change(pixels, pairs)
    verdict = ch.built_up_verdict(result.classes, result.confidence, _model(pixels))
    return verdict.join(an.model_line(verdict, pairs), "pair_id", "left").drop("in_distribution", "rules_delta_pp")


def asked_answers(spark, sf):
    """Each pair is asked about other classes."""
    pixels, pairs = _kept_pixels(spark, sf), d.pair_catalogue(spark, sf)
    asked = pairs.select("pair_id", F.expr(
        "case pair_id when 0 then array('built_up') when 1 then array('water', 'vegetation') when 2 then array('vegetation', 'built_up', 'water', 'other') "
        "else array('built_up', 'other') end classes"))
    return an.asked_answers(_kept_change(pixels, pairs), pairs, asked, _model(pixels)).withColumn("confidence", F.round("confidence", 6))


def captions(spark, sf):
    from pixelloom.operators import scoring as sc

    ranking = sc.scene_ranking(lg._images(spark, sf).select("image_id", "vec"), lg._prompts(spark, sf), 3, 10.0)
    return an.captions(ranking).select("image_id", "caption", "level")


def qa_headlines(spark, sf):
    answers = d.table(spark, sf, "events").selectExpr(
        "event_id qid", "case event_type when 'click' then 'count' when 'purchase' then 'rural_urban' when 'signup' then 'comp' else 'presence' end type",
        "if(event_id % 3 = 0, null, 'a lake') object",
        "case event_type when 'click' then cast(user_id as string) when 'purchase' then if(user_id % 2 = 0, 'rural', 'urban') "
        "when 'error' then 'maybe' else if(user_id % 2 = 0, 'yes', 'no') end answer", "if(event_id % 5 = 0, null, (event_id % 101) / 100D) probability")
    return an.qa_headlines(answers).select("qid", "headline", "level", "certainty")


def status_counts(spark, sf):
    return pr.status_counts(_predictions(spark, sf))


def _predictions(spark, sf):
    """Every event as a batch item; uploads from consecutive users, results for some tasks."""
    items = lg._log(spark, sf).select(F.col("qid").alias("id"), F.col("user_id").alias("upload_id"), "mode", "question")
    users = d.table(spark, sf, "customer").selectExpr("c_custkey upload_id", "c_custkey")
    validation = users.selectExpr("upload_id", "c_custkey % 7 <> 0 ok")
    results = users.selectExpr("upload_id", "inline(array("
                               "named_struct('task', 'change', 'status', 'OK', 'answer', 'long text', 'short_answer', 'increased', 'confidence', 0.5D), "
                               "named_struct('task', 'vqa', 'status', if(c_custkey % 5 = 0, 'ERROR', 'OK'), 'answer', 'yes', 'short_answer', null, 'confidence', 0.25D)))")
    return pr.predict(items, validation, results, "vqa")


def predictions(spark, sf):
    return _predictions(spark, sf)


def fetch_plan(spark, sf):
    orders = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey request_id", "case o_orderkey % 7 when 0 then 'other' when 1 then 'single' when 2 then 'single' when 3 then 'optical_sar' else 'bi_temporal' end mode",
        "named_struct('w', 77.5D + o_custkey % 9 / 100D, 's', 12.9D, 'e', 77.55D + o_custkey % 9 / 100D + if(o_custkey % 8 = 0, 0.2D, 0D), 'n', 12.95D) box",
        "date_format(o_orderdate, 'yyyy-MM-dd') a", "date_format(date_add(o_orderdate, cast(o_custkey % 60 - 5 as int)), 'yyyy-MM-dd') b")
    requests = orders.selectExpr("request_id", "mode", "box", "if(request_id % 10 = 0, array(named_struct('start', a, 'end', b)), "
                                 "array(named_struct('start', a, 'end', b), named_struct('start', a, 'end', b))) ranges")
    return ft.fetch_plan(requests, "2001-05-01").select("request_id", "mode", "slot", "product", "start", "end", "mid_date", "grid.epsg")


def aoi_clip(spark, sf):
    """Pixels inside a diamond that touches the middle of each side of the image."""
    images = d.wide_observations(spark, sf).groupBy(F.col("pair_id").alias("aoi")).agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    edges = images.selectExpr("aoi", "inline(array(named_struct('x1', w / 2D, 'y1', 0D, 'x2', cast(w as double), 'y2', h / 2D), "
                              "named_struct('x1', cast(w as double), 'y1', h / 2D, 'x2', w / 2D, 'y2', cast(h as double)), "
                              "named_struct('x1', w / 2D, 'y1', cast(h as double), 'x2', 0D, 'y2', h / 2D), "
                              "named_struct('x1', 0D, 'y1', h / 2D, 'x2', w / 2D, 'y2', 0D)))")
    pixels = d.dated_pixels(spark, sf, False).selectExpr("pair_id aoi", "row", "col", "col + 0.5D x", "row + 0.5D y")
    return cv.clip_to_polygon(pixels, edges).select("aoi", "row", "col")


QUERIES = {f.__name__: f for f in (
    change_lines, change_answers, class_headlines, fusion_answers, built_up_verdict, asked_answers, captions, qa_headlines, predictions, status_counts,
    fetch_plan, aoi_clip)}
