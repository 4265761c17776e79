"""Queries on question logs, embeddings and administrative areas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelloom.functions import questions as q
from pixelloom.functions import vectors as vec
from pixelloom.operators import areas as ar
from pixelloom.operators import questions as qs
from pixelloom.operators import scoring as sc
from pixelloom.operators import shapes as sh
from pixelloom.session import stable
from workload import derived as d

# Question wordings of the derived log; %d becomes the event's user, so the log has many distinct texts.
WORDINGS = (
    "What changed between the two dates?", "Has built-up area increased, decreased or remained unchanged?",
    "How many bands does this image have?", "What is the resolution of each image?", "Map water and built-up areas",
    "Where is the water near lake %d?", "Describe this image", "Give me a summary of scene %d",
    "Is it a rural or an urban area?", "Are there more buildings than %d roads?", "How many buildings are there?",
    "Is there a small water area in the image?", "Are there any roads present in block %d?",
    "Does the image contain a large residential area?", "Is the number of lakes equal to %d?", "watr and bilt up",
    "descrbe the pictur", "chnage in vegetaton", "hello %d", "", "What is the acquisition date?",
    "Show me vegetation and crop health", "flooded farms near river %d", "Which satellite took this and what is the CRS?",
    "Do the two images remain the same?", "Is there a forest ?", "metadta of file %d", "Is a bridge present in this scene?")
MODES = ("single", "optical_sar", "bi_temporal")


def _log(spark, sf):
    texts = F.array(*[F.lit(w) for w in WORDINGS])
    modes = F.array(*[F.lit(m) for m in MODES])
    return d.table(spark, sf, "events").select(
        F.col("event_id").alias("qid"), "user_id", F.get(modes, F.expr("cast(user_id % 3 as int)")).alias("mode"),
        F.replace(F.get(texts, F.expr(f"cast(event_id * 7 % {len(WORDINGS)} as int)")), F.lit("%d"),
                  F.col("user_id").cast("string")).alias("question"))


def task_rules(spark, sf):
    df = _log(spark, sf).withColumn("hits", q.task_hits(F.col("question")))
    return df.select("qid", F.concat_ws(",", "hits").alias("hits"),
                     F.concat_ws("|", q.matched_terms(F.col("question"), F.get("hits", F.lit(0)))).alias("matched"))


def task_classified(spark, sf):
    df = qs.classify_questions(_log(spark, sf))
    return df.select("qid", "task", "method", F.concat_ws("|", "matched").alias("matched"), "confidence",
                     F.concat_ws(",", "also_matched").alias("also_matched"))


def route(spark, sf):
    tasks = F.array(*[F.lit(t) for t in (*q.TASKS, "unknown")])
    df = _log(spark, sf).withColumn("task", F.get(tasks, F.expr("cast(qid % 6 as int)")))
    return qs.route_tasks(df).select("qid", "task", "mode", "routed_task", "rerouted_from")


def intent(spark, sf):
    return _log(spark, sf).select("qid", q.intent(F.col("question")).alias("intent"))


def classes_mentioned(spark, sf):
    t = F.col("question")
    return _log(spark, sf).select("qid", F.concat_ws(",", q.classes_in(t, tuple(q.CLASS_PATTERNS))).alias("classes"),
                                  F.concat_ws(",", q.fields_in(t)).alias("fields"))


def question_type(spark, sf):
    return _log(spark, sf).select("qid", q.question_type(F.col("question")).alias("type"))


def presence_object(spark, sf):
    return _log(spark, sf).select("qid", q.presence_object(F.col("question")).alias("object"))


def conversation_wording(spark, sf):
    """Task rules and question types over whole conversation texts."""
    df = d.table(spark, sf, "conversations")
    return df.groupBy("role", F.concat_ws(",", q.task_hits(F.col("text"))).alias("hits"),
                      q.question_type(F.col("text")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def count_bins(spark, sf):
    answers = d.table(spark, sf, "events").selectExpr(
        "event_id", "case event_id % 6 when 0 then cast(user_id * user_id as string) when 1 then concat(' ', user_id, ' ') "
        "when 2 then concat('-', user_id) when 3 then cast(value as string) when 4 then concat('9999999999999999999', user_id) else event_type end answer")
    return answers.select("event_id", F.expr(q.count_bin("answer")).alias("bin"))


def pair_order(spark, sf):
    files = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey div 2 upload_id", "cast(o_orderkey % 2 + 1 as int) slot",
        "if(o_custkey % 10 = 0, null, date_format(o_orderdate, 'yyyy-MM-dd')) date")
    return qs.before_after_order(files)


# ------------------------------------------------------------------------------ embeddings

def _images(spark, sf):
    return d.table(spark, sf, "embeddings").selectExpr("vec_id image_id", "embedding vec", "label")


def _prompts(spark, sf):
    best = d.table(spark, sf, "embeddings").groupBy(F.col("label").alias("label_idx")).agg(
        F.min_by("embedding", "vec_id").alias("prompt_vec"))
    return best.select("label_idx", F.concat(F.lit("label "), F.col("label_idx").cast("string")).alias("label"), "prompt_vec")


def _f(df, *columns):
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


def l2_normalised(spark, sf):
    df = _images(spark, sf).withColumn("v", vec.l2_normalised("vec"))
    return _f(df.select("image_id", F.expr("aggregate(v, 0D, (s, x) -> s + x * x)").alias("norm"), F.expr("v[5]").alias("v5")), "norm", "v5")


def zero_shot_topk(spark, sf):
    df = sc.scene_ranking(_images(spark, sf).select("image_id", "vec"), _prompts(spark, sf), 3, 10.0)
    return df.withColumn("probability", F.round("probability", 5))


def two_prompt_answers(spark, sf):
    images = _images(spark, sf).select("image_id", "vec")
    size = d.table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    asked = _log(spark, sf).select("qid", (F.col("qid") % size).alias("image_id"), "question")
    typed = asked.select(q.question_type(F.col("question")).alias("t"), q.presence_object(F.col("question")).alias("o")).distinct()
    texts = typed.select(F.explode(F.when(F.col("t") == "rural_urban", F.array(*[F.lit(p) for p in sc.RURAL_URBAN_PROMPTS.values()]))
                                   .when(F.col("o").isNotNull(), F.array(*[F.format_string(p, F.col("o")) for p in sc.PRESENCE_PROMPTS.values()])))
                         .alias("text")).distinct()
    stored = texts.withColumn("image_id", F.expr("cast(length(text) * 37 as bigint)") % size).join(images, "image_id").select("text", "vec")
    df = sc.two_prompt_answers(asked, images, stored, 5.0)
    return df.withColumn("probability", F.round("probability", 5))


def _answers(spark, sf):
    """The vocabulary: an answer per embedding dimension; three of the four types allow a third of it."""
    answers = d.table(spark, sf, "embeddings").selectExpr("explode(sequence(0, size(embedding) - 1)) answer_idx").distinct().selectExpr(
        "answer_idx", "concat('a', answer_idx) answer")
    allowed = answers.selectExpr("answer", "answer_idx", "explode(array('t0', 't1', 't2')) type").where("answer_idx % 3 = cast(substr(type, 2) as int)")
    return answers, allowed.select("type", "answer")


def masked_softmax(spark, sf):
    logits = d.table(spark, sf, "embeddings").selectExpr(
        "vec_id qid", "concat('t', vec_id % 4) type", "transform(embedding, x -> cast(x as double) * 10D) logits")
    return sc.masked_answers(logits, *_answers(spark, sf)).withColumn("probability", F.round("probability", 5))


def mlp_scores(spark, sf):
    """Answers of a head on the vectors of an image and of another row as its question, masked by type."""
    rng = np.random.default_rng(7)
    layers = [(rng.normal(0, 0.1, (32, 192)), np.zeros(32)), (rng.normal(0, 0.2, (32, 32)), np.zeros(32)), (rng.normal(0, 0.2, (64, 32)), np.zeros(64))]
    images = _images(spark, sf)
    size = images.agg(F.count(F.lit(1))).scalar()
    asked = images.select(F.col("image_id").alias("qid"), F.col("vec").alias("image_vec"), ((F.col("image_id") * 7 + 1) % size).alias("q"))
    pairs = asked.join(images.select(F.col("image_id").alias("q"), F.col("vec").alias("question_vec")), "q").select("qid", "image_vec", "question_vec")
    logits = sc.mlp_logits(pairs, layers).withColumn("type", F.concat(F.lit("t"), (F.col("qid") % 4).cast("string")))
    return sc.masked_answers(logits, *_answers(spark, sf)).select("qid", "type", "rank", "answer", F.round("probability", 5).alias("probability"))


def multi_hot(spark, sf):
    df = _images(spark, sf).withColumn("y", vec.multi_hot("array(label, (label + 3) % 19)", 19))
    return df.select("image_id", F.expr("aggregate(y, 0D, (s, v) -> s + v)").alias("ones"), F.expr("y[label]").alias("own"))


def qa_split_join(spark, sf):
    events = d.table(spark, sf, "events")
    images = d.table(spark, sf, "customer").selectExpr("c_custkey id", "c_mktsegment <> 'MACHINERY' active")
    questions = events.selectExpr("event_id id", "user_id img_id", "event_type type", "concat('question ', event_id % 50) question", "value > 5 active")
    answers = events.selectExpr("event_id id", "event_id - event_id % 2 question_id", "cast(floor(value) as string) answer", "event_type <> 'error' active")
    return sc.qa_records(images, questions, answers)


def embedding_gap(spark, sf):
    keys = d.table(spark, sf, "events").selectExpr("cast(user_id as string) key")
    store = d.table(spark, sf, "embeddings").selectExpr("cast(vec_id * 3 as string) key", "if(label < 8, 'm1', 'm2') model_id")
    return sc.missing_embeddings(keys, store, "m1")


def answer_choice(spark, sf):
    base = d.table(spark, sf, "events").selectExpr("event_id qid", "if(event_type = 'click', 'count', 'presence') type", "user_id % 4 <> 0 georeferenced")
    head = d.table(spark, sf, "events").where("event_type = 'click'").selectExpr("event_id qid", "cast(user_id as string) answer", "0.5D probability")
    zero = d.table(spark, sf, "events").where("event_type <> 'error'").selectExpr("event_id qid", "'yes' answer", "0.75D probability")
    return sc.answer_source(base, head, zero)


def linear_probe(spark, sf):
    """All labels, fitted on three quarters of the rows and scored on the last quarter."""
    features = d.table(spark, sf, "embeddings").selectExpr("vec_id row_id", "embedding vec", "array(label) labels")
    labels = sorted(r[0] for r in features.select(F.explode("labels")).distinct().collect())  # the classes of the task
    return sc.linear_probe(features, labels, 20, "row_id % 4 = 0").groupBy("class_idx").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("y").alias("positives"), F.count_if(F.col("y") & (F.col("p") > 0.2)).alias("found"))


def probe_best(spark, sf):
    """One head for all classes from a fixed start; its state of the best step on a quarter of the rows."""
    features = d.table(spark, sf, "embeddings").selectExpr(
        "vec_id row_id", "embedding vec", "filter(sequence(0, 9), c -> c = label or (vec_id + c) % 17 = 0) labels")
    probe = sc.multilabel_probe(features, range(10), "row_id % 4 = 0", steps=3, rate=4.0, decay=0.01)
    return probe.scores.groupBy("class_idx").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("y").alias("positives"), F.round(F.avg("p"), 6).alias("mean_p")).withColumns(
        {"step": F.lit(probe.step), "micro_map": F.lit(probe.history[probe.step - 1])})


# ------------------------------------------------------------------------------ areas

def _states(spark, sf):
    return d.table(spark, sf, "region").selectExpr(
        "r_regionkey state_id", "r_name state_name",
        "named_struct('w', r_regionkey * 10D, 's', 0D, 'e', r_regionkey * 10D + 10D, 'n', 10D) box")


def _districts(spark, sf):
    """Suppliers as districts, each made of two boxes."""
    return d.table(spark, sf, "supplier").selectExpr(
        "s_suppkey district_id", "s_name name", "s_nationkey", "s_acctbal",
        "explode(array(named_struct('w', (s_suppkey * 37 % 480) / 10D, 's', (s_suppkey * 11 % 90) / 10D, "
        "'e', (s_suppkey * 37 % 480) / 10D + (5 + s_suppkey % 13) / 10D, 'n', (s_suppkey * 11 % 90) / 10D + 0.5D), "
        "named_struct('w', (s_suppkey * 37 % 480) / 10D + 0.75D, 's', (s_suppkey * 11 % 90) / 10D + 0.5D, "
        "'e', (s_suppkey * 37 % 480) / 10D + 1.75D, 'n', (s_suppkey * 11 % 90) / 10D + 0.75D))) box")


def district_to_state(spark, sf):
    return _f(ar.largest_overlap(_districts(spark, sf), _states(spark, sf)), "overlap")


def _outline(*corners):
    return "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in corners) + ")"


def district_shapes(spark, sf):
    """Angled districts with a hole, some in two parts, in states with a lake and a bay: by the largest common area."""
    x, y, w, h = "(s_suppkey * 37 % 190) / 4D", "(s_suppkey * 11 % 36) / 4D", "(3 + s_suppkey % 9) / 4D", "(3 + s_suppkey % 5) / 4D"
    angle = _outline((x, y), (f"{x} + {w}", y), (f"{x} + {w}", f"{y} + 0.5D"), (f"{x} + 0.5D", f"{y} + 0.5D"), (f"{x} + 0.5D", f"{y} + {h}"), (x, f"{y} + {h}"))
    hole = _outline(*[(f"{x} + {a}D", f"{y} + {b}D") for a, b in ((0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5))])
    isle = _outline(*[(f"{x} + {a}D", f"{y} + {b}D") for a, b in ((3, 0), (3.5, 0), (3.5, 0.25), (3, 0.25))])
    districts = d.table(spark, sf, "supplier").selectExpr(
        "s_suppkey district_id", f"explode(if(s_suppkey % 3 = 0, array(array({angle}, {hole}), array({isle})), array(array({angle}, {hole})))) rings")
    at = lambda a, b: (f"r_regionkey * 10D + {a}D", f"{b}D")
    land = _outline(*[at(a, b) for a, b in ((0, 0), (10, 0), (10, 4), (7, 4), (7, 6), (10, 6), (10, 10), (0, 10))])
    lake = _outline(*[at(a, b) for a, b in ((2, 2), (4, 2), (4, 5), (2, 5))])
    states = d.table(spark, sf, "region").selectExpr("r_regionkey state_id", f"array({land}, {lake}) rings")
    return _f(sh.largest_shape_overlap(districts, states), "overlap")


def _named(spark, sf):
    suppliers = d.table(spark, sf, "supplier")
    forced = suppliers.where("s_nationkey = 3").selectExpr("s_name name", "4 state_id")
    dropped = suppliers.where("s_nationkey = 11").selectExpr("s_name name")
    assigned = stable(ar.assign(_districts(spark, sf), _states(spark, sf), forced, dropped))
    renames = suppliers.where("s_nationkey < 6").selectExpr("inline(transform(sequence(0, 2), s -> named_struct('state_id', s, 'old_name', s_name, 'new_name', concat('District ', s_suppkey))))")
    return ar.rename(assigned, renames)


def district_names(spark, sf):
    return _named(spark, sf)


def alias_resolve(spark, sf):
    named = _named(spark, sf)
    legacy = d.table(spark, sf, "supplier").where("s_nationkey = 8").selectExpr("2 state_id", "concat('Old ', s_name) alias", "s_name district")
    aliases = ar.alias_rows(named, legacy)
    requests = d.table(spark, sf, "customer").selectExpr(
        "c_custkey", "cast(c_custkey % 5 as int) state_id",
        "concat(if(c_custkey % 7 = 0, 'Old ', ''), 'Supplier#', lpad(cast(c_custkey * 13 % 100 as string), 9, '0')) area")
    return ar.resolve_areas(requests, named, aliases)


def boundary_boxes(spark, sf):
    vertices = d.table(spark, sf, "orders").selectExpr("o_custkey district_id", "(o_orderkey * 37 % 3600) / 10D x", "(o_orderkey * 53 % 1800) / 10D y")
    return ar.boundary_boxes(vertices).selectExpr("district_id", "box.w", "box.s", "box.e", "box.n")


def city_check(spark, sf):
    """Curated cities whose district does not exist."""
    cities = d.table(spark, sf, "supplier").selectExpr("s_nationkey % 5 state_id", "s_name district", "s_suppkey position")
    return ar.dangling(cities, _named(spark, sf)).groupBy("state_id").agg(F.count(F.lit(1)).alias("missing"))


QUERIES = {f.__name__: f for f in (
    task_rules, task_classified, route, intent, classes_mentioned, question_type, presence_object, conversation_wording, count_bins,
    pair_order, l2_normalised, zero_shot_topk, two_prompt_answers, masked_softmax, mlp_scores, multi_hot, qa_split_join,
    embedding_gap, answer_choice, linear_probe, probe_best, district_to_state, district_shapes, district_names, alias_resolve, boundary_boxes, city_check)}
