"""Scoring embeddings: prompts, masked answers, a user-supplied network, and answer selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.functions import questions as q
from pixelloom.functions.vectors import dot
from pixelloom.session import stable

# Scene labels and prompt texts.
SCENE_LABELS = (
    "an airport", "bare land", "a beach", "a bridge", "a commercial area",
    "a dense residential area", "a desert", "farmland", "a forest", "an industrial area",
    "a meadow", "a medium residential area", "mountains", "a park", "a parking lot",
    "a playground", "a pond", "a port", "a railway station", "a river",
    "a sparse residential area", "a stadium", "storage tanks", "a viaduct", "a lake",
    "a wetland", "a highway", "a golf course", "snow", "clouds")
SCENE_TEMPLATE = "a satellite image of %s."
RURAL_URBAN_PROMPTS = {"rural": "a satellite image of a rural area.", "urban": "a satellite image of an urban area."}
PRESENCE_PROMPTS = {"yes": "a satellite image containing %s.", "no": "a satellite image with no %s."}
MIN_ALTERNATIVE = 0.05
PROMPTS_IN_ROW, PROMPTS_PER_BLOCK, SALTS = 4096, 64, 32


def softmax(df: DataFrame, keys: Sequence[str], logit: str) -> DataFrame:
    """Adds ``probability`` within ``keys``. A group is one image's labels or answers."""
    w = Window.partitionBy(*keys)
    shifted = df.withColumn("__e", F.exp(F.col(logit) - F.max(logit).over(w)))
    return shifted.withColumn("probability", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def _probabilities(scores: Column) -> Column:
    """An array of structs with ``logit`` as structs with ``logit`` and ``probability``, by softmax within the array."""
    def of(pair: Column) -> Column:
        weighed = F.transform(pair["s"], lambda s: F.struct(s.alias("s"), F.exp(s["logit"] - pair["top"]).alias("e")))
        return F.transform(F.array(weighed), lambda w: F.transform(w, lambda x: F.struct(
            x["s"].alias("s"), (x["e"] / F.aggregate(w, F.lit(0.0), lambda a, y: a + y["e"])).alias("probability"))))[0]

    top = F.array_max(F.transform(scores, lambda s: s["logit"]))
    return F.transform(F.array(F.struct(scores.alias("s"), top.alias("top"))), of)[0]


def _logits(prompts: Column, scale: float) -> Column:
    return F.transform(prompts, lambda p: F.struct(
        p["label_idx"].alias("label_idx"), p["label"].alias("label"), (F.lit(scale) * F.aggregate(
            F.zip_with("vec", p["prompt_vec"], lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)).alias("logit")))


def prompt_scores(images: DataFrame, prompts: DataFrame, scale: float = 100.0) -> DataFrame:
    """(image_id, scores): per image an array of (label_idx, label, logit, probability) over all prompts.

    ``prompts`` is ``(label_idx, label, prompt_vec)``. Up to ``PROMPTS_IN_ROW`` of them (counted) reach every
    image as one constant array, so images are not shuffled. More are cut into blocks; images meet a block by
    its number and a salt, so no task gets all images, and the blocks of an image are put together again.
    """
    item = F.struct("label_idx", "label", "prompt_vec")
    if prompts.limit(PROMPTS_IN_ROW + 1).count() <= PROMPTS_IN_ROW:
        every = prompts.agg(F.array_sort(F.collect_list(item))).scalar()
        scored = images.select("image_id", "vec", every.alias("__prompts")).select("image_id", _logits(F.col("__prompts"), scale).alias("scores"))
    else:
        blocks = prompts.groupBy(F.floor(F.col("label_idx") / PROMPTS_PER_BLOCK).alias("__block")).agg(
            F.collect_list(item).alias("__prompts")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        last = prompts.agg(F.floor(F.max("label_idx") / PROMPTS_PER_BLOCK)).scalar()
        spread = images.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(
            "__salt", F.pmod(F.xxhash64("image_id"), F.lit(SALTS)).cast("int"))
        parts = spread.join(blocks, ["__block", "__salt"]).select("image_id", _logits(F.col("__prompts"), scale).alias("part"))
        scored = parts.groupBy("image_id").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("scores"))
    return scored.select("image_id", F.transform(_probabilities(F.col("scores")), lambda x: F.struct(
        x["s"]["label_idx"].alias("label_idx"), x["s"]["label"].alias("label"), x["s"]["logit"].alias("logit"),
        x["probability"].alias("probability"))).alias("scores"))


def scene_ranking(images: DataFrame, prompts: DataFrame, top_k: int = 3, scale: float = 100.0) -> DataFrame:
    """Best labels per image; alternatives need a probability of at least 0.05."""
    order = F.sort_array(F.transform("scores", lambda s: F.struct(
        (-s["probability"]).alias("p"), s["label_idx"].alias("i"), s["label"].alias("label"))))
    ranked = prompt_scores(images, prompts, scale).select("image_id", F.posexplode(F.slice(order, 1, top_k)))
    return ranked.select("image_id", (F.col("pos") + 1).alias("rank"), "col.label", (-F.col("col.p")).alias("probability")).where(
        (F.col("rank") == 1) | (F.col("probability") >= MIN_ALTERNATIVE))


def two_prompt_answers(questions: DataFrame, images: DataFrame, texts: DataFrame, scale: float = 100.0) -> DataFrame:
    """Yes/no and rural/urban answers from two prompts per question; other types stay unsupported (NULL).

    ``questions`` is ``(qid, image_id, question)``, ``texts`` is ``(text, vec)``, the stored prompt embeddings.
    """
    typed = questions.withColumns({"type": q.question_type(F.col("question")), "object": q.presence_object(F.col("question"))})
    options = F.when(F.col("type") == "rural_urban", F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(a).alias("answer"), F.lit(p).alias("text"))
        for i, (a, p) in enumerate(RURAL_URBAN_PROMPTS.items())])).when(
        (F.col("type") == "presence") & F.col("object").isNotNull(), F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(a).alias("answer"), F.format_string(p, F.col("object")).alias("text"))
            for i, (a, p) in enumerate(PRESENCE_PROMPTS.items())]))
    asked = typed.withColumn("__o", F.explode(options)).select("qid", "image_id", "type", "__o.*")
    vectors = texts.select("text", F.col("vec").alias("__t"))
    scored = asked.join(vectors, "text").join(images.select("image_id", F.col("vec").alias("__v")), "image_id").withColumn(
        "logit", F.lit(scale) * dot("__v", "__t"))
    best = softmax(scored, ["qid"], "logit").groupBy("qid").agg(
        F.max_by(F.struct("answer", "probability"), F.struct(F.col("probability"), -F.col("i"))).alias("__b"))
    return typed.select("qid", "type").join(best, "qid", "left").select(
        "qid", "type", "__b.answer", "__b.probability")


def masked_answers(logits: DataFrame, answers: DataFrame, allowed: DataFrame, top_k: int = 3) -> DataFrame:
    """Ranked answers of ``(qid, type, logits)`` among those seen for the type, worked out within the row.

    ``answers`` is the vocabulary ``(answer_idx, answer)`` that the logits follow, ``allowed`` the answers
    ``(type, answer)`` seen per type; both are the size of the model's head and reach every row as a constant.
    A type that was never seen allows every answer. A disallowed answer has a logit of minus infinity.
    """
    names = answers.agg(F.map_from_entries(F.collect_list(F.struct(F.col("answer_idx").cast("int"), "answer")))).scalar()
    masks = allowed.join(answers, "answer").groupBy("type").agg(F.collect_set(F.col("answer_idx").cast("int")).alias("ids"))
    masks = masks.agg(F.map_from_entries(F.collect_list(F.struct("type", "ids")))).scalar()
    rows = logits.select("qid", "type", "logits", names.alias("__names"), F.try_element_at(masks, F.col("type")).alias("__mask"))
    open_ = F.filter(F.transform("logits", lambda x, i: F.struct(x.cast("double").alias("logit"), i.alias("i"))),
                     lambda s: F.col("__mask").isNull() | F.array_contains(F.col("__mask"), s["i"]))
    order = F.sort_array(F.transform(F.filter(_probabilities(open_), lambda x: x["probability"] > 0), lambda x: F.struct(
        (-x["probability"]).alias("p"), x["s"]["i"].alias("i"))))
    return rows.select("qid", "type", "__names", F.posexplode(F.slice(order, 1, top_k))).select(
        "qid", "type", (F.col("pos") + 1).alias("rank"), F.try_element_at("__names", F.col("col.i")).alias("answer"), (-F.col("col.p")).alias("probability"))


def _gelu(x: np.ndarray) -> np.ndarray:
    """Exact-form GELU; erf by the published rational approximation (absolute error below 1.5e-7)."""
    z = np.abs(x) / np.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = np.sign(x) * (1.0 - poly * np.exp(-z * z))
    return 0.5 * x * (1.0 + erf)


def mlp_logits(pairs: DataFrame, weights: Sequence[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Logits of a feed-forward head on [image, question, image * question] for ``(qid, image_vec, question_vec)``.

    ``weights`` are (matrix, bias) per layer; they are the model, so their size does not grow with the
    data, and they go to the executors as one broadcast variable.
    """
    shared = pairs.sparkSession.sparkContext.broadcast([(np.asarray(w, "float32"), np.asarray(b, "float32")) for w, b in weights])

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            image, question = (np.stack(pdf[c].to_numpy()).astype("float32") for c in ("image_vec", "question_vec"))
            x = np.concatenate([image, question, image * question], axis=1)
            for i, (w, b) in enumerate(shared.value):
                x = x @ w.T + b
                if i < len(shared.value) - 1:
                    x = _gelu(x)
            yield pd.DataFrame({"qid": pdf["qid"], "logits": list(x.astype("float64"))})

    schema = T.StructType([T.StructField("qid", pairs.schema["qid"].dataType), T.StructField("logits", T.ArrayType(T.DoubleType()))])
    return pairs.select("qid", "image_vec", "question_vec").mapInPandas(run, schema)


def answer_source(questions: DataFrame, head: DataFrame, zero_shot: DataFrame) -> DataFrame:
    """Trained head's answer where there is one, else the zero-shot answer, else none; records which one answered.

    Also warns where a count was asked of an image without map scale.
    """
    h = head.select("qid", F.col("answer").alias("__ha"), F.col("probability").alias("__hp"))
    z = zero_shot.select("qid", F.col("answer").alias("__za"), F.col("probability").alias("__zp"))
    return questions.join(h, "qid", "left").join(z, "qid", "left").select(
        *questions.columns, F.coalesce("__ha", "__za").alias("answer"),
        F.when(F.col("__ha").isNotNull(), F.col("__hp")).otherwise(F.col("__zp")).alias("probability"),
        F.when(F.col("__ha").isNotNull(), "trained_head").when(F.col("__za").isNotNull(), "zero_shot").alias("answered_by"),
        ((F.col("type") == "count") & ~F.col("georeferenced")).alias("count_is_rough"))


def missing_embeddings(keys: DataFrame, store: DataFrame, model_id: str) -> DataFrame:
    """Distinct keys the store has no vector for."""
    known = store.where(F.col("model_id") == model_id).select("key")
    return keys.select("key").distinct().join(known, "key", "left_anti")


def qa_records(images: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Active questions of active images with their answers; of several active answers the last one counts."""
    last = answers.where("active").groupBy("question_id").agg(F.max_by("answer", "id").alias("answer"))
    live = images.where("active").select(F.col("id").alias("img_id"))
    asked = questions.where("active").select(F.col("id").alias("qid"), "img_id", "question", "type")
    return asked.join(live, "img_id", "left_semi").join(
        last.withColumnRenamed("question_id", "qid"), "qid").select("qid", "img_id", "question", "answer", "type")


def with_embeddings(records: DataFrame, image_vectors: DataFrame, question_vectors: DataFrame) -> DataFrame:
    """Image and question vector of each record: ``(img_id, vec)`` and ``(question, vec)``."""
    return records.join(image_vectors.select("img_id", F.col("vec").alias("image_vec")), "img_id").join(
        question_vectors.select("question", F.col("vec").alias("question_vec")), "question")


def linear_probe(features: DataFrame, classes: Sequence[int], max_iter: int = 20, held_out: str = "false") -> DataFrame:
    """One logistic head per class on frozen features ``(row_id, vec, labels)``; runs one training job per class.

    Rows for which ``held_out`` (SQL text) holds are not fitted on, and only they are scored; without any, all rows
    are. Returns probabilities ``(row_id, class_idx, y, p)`` in the form the multi-label metrics take. The
    features are written out once, as every class reads them.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vector = array_to_vector(F.expr("transform(vec, x -> cast(x as double))")).alias("features")
    base = stable(features.select("row_id", "labels", F.expr(held_out).alias("__out"), vector))
    out, scored = None, base if held_out == "false" else base.where("__out")
    for c in classes:
        label = F.array_contains("labels", c).cast("double").alias("label")
        model = LogisticRegression(maxIter=max_iter, regParam=0.01).fit(base.where("not __out").select("features", label))
        part = model.transform(scored.select("row_id", "features", label)).select(
            "row_id", F.lit(c).alias("class_idx"), (F.col("label") == 1).alias("y"), vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Probe:
    """The kept state of a probe: a row of weights and a bias per class; micro mAP of the held-out rows after each step."""

    weights: np.ndarray
    step: int
    history: list[float]
    scores: DataFrame


def _rows_of(column: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _sigmoid(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(x @ weights[:, :-1].T + weights[:, -1])))


def _gradient(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(weights)
        for batch in batches:
            if batch.num_rows:
                x, y = _rows_of(batch.column(0)), _rows_of(batch.column(1))
                off = _sigmoid(x, weights) - y
                total[:, :-1] += off.T @ x
                total[:, -1] += off.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "g"])
    return run


def _probed(weights: np.ndarray, classes: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, y, n = _sigmoid(_rows_of(batch.column(1)), weights), _rows_of(batch.column(2)) > 0, len(classes)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n))), pa.array(np.tile(np.asarray(classes, np.int32), batch.num_rows)),
                    pa.array(y.ravel()), pa.array(p.ravel())], names=["row_id", "class_idx", "y", "p"])
    return run


def multilabel_probe(features: DataFrame, classes: Sequence[int], held_out: str, steps: int = 30, rate: float = 2.0, decay: float = 0.0) -> Probe:
    """A linear head for all classes at once on frozen features ``(row_id, vec, labels)``, kept at its best step.

    Every step is one aggregation: tasks add up the gradients of all classes over the rows that are not ``held_out`` (SQL
    text), and as many numbers as the head has reach the driver. After each step the held-out rows are scored, and the
    state of highest micro mAP on them, the earliest of equal ones, is the result. ``scores`` has the held-out rows
    ``(row_id, class_idx, y, p)``. Without a held-out positive the last state is kept.
    """
    from pixelloom.operators.evaluation import micro_map

    wanted = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains("labels", c).cast("double"))
    base = stable(features.select("row_id", F.expr("transform(vec, x -> cast(x as double))").alias("x"), wanted.alias("y"), F.expr(held_out).alias("__out")))
    fitted, held = base.where("not __out").select("x", "y"), base.where("__out").select("row_id", "x", "y")
    n, width = fitted.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no rows to fit on")
    kind = features.schema["row_id"].dataType.simpleString()
    scored = lambda w: held.mapInArrow(_probed(w, classes), f"row_id {kind}, class_idx int, y boolean, p double")
    weights, best, history = np.zeros((len(classes), width + 1)), None, []
    for step in range(1, steps + 1):
        sums = fitted.mapInArrow(_gradient(weights), "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
        gradient = np.zeros(weights.size)
        gradient[[r["i"] for r in sums]] = [r["g"] for r in sums]
        weights = weights - rate * (gradient.reshape(weights.shape) / n + decay * weights)
        reached = micro_map(scored(weights), len(classes)).first()
        history.append(reached["micro_map"] if reached else None)
        if best is None or history[-1] is None or (history[best - 1] is not None and history[-1] > history[best - 1]):
            best, kept = step, weights
    return Probe(kept, best, history, scored(kept))
