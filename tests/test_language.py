import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import questions as q
from pixelloom.functions import vectors as vec
from pixelloom.operators import areas as ar
from pixelloom.operators import questions as qs
from pixelloom.operators import scoring as sc
from pixelloom.plans import answers as an
from pixelloom.plans import predict as pr

CASES = [  # question, task, method, confidence
    ("What changed between the two dates?", "change", "rules", 0.95),
    ("Has the built-up area increased?", "change", "rules", 0.8),
    ("How many bands does it have?", "metadata", "rules", 0.95),
    ("What is the CRS of this image?", "metadata", "rules", 0.95),
    ("Map water and built-up areas", "water_builtup", "rules", 0.95),
    ("Describe this image", "caption", "rules", 0.95),
    ("Is it a rural area?", "vqa", "rules", 0.6),
    ("metadta please", "metadata", "fuzzy_keywords", 0.6),
    ("chnage", "change", "fuzzy_keywords", 0.6),
    ("hello", "unknown", "none", 0.0),
    ("", "unknown", "none", 0.0),
    (None, "unknown", "none", 0.0),
]


def test_classify(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "qid int, question string")
    got = {r.qid: (r.task, r.method, r.confidence) for r in qs.classify_questions(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}


def test_fuzzy_equals_brute_force(spark):
    texts = ["watr watr descrbe", "resolutn of floodd", "bilt up ubran", "sumary overvew", "zzzz qqqq", "caption metadat", "growth-rate expansio"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.task, r.matched) for r in qs.fuzzy_votes(df, "t", "t").collect()}
    words = {w: t for t, group in q.VOCABULARY.items() for w in group}
    for text in texts:
        votes = {}
        for word in "".join(c if c.isalpha() else " " for c in text.lower().replace("-", "")).split():
            close = difflib.get_close_matches(word, words, n=1, cutoff=0.8) if len(word) >= 4 else []
            if close:
                votes.setdefault(words[close[0]], []).append(f"{word}~{close[0]}")
        if not votes:
            assert text not in got
            continue
        task = min(votes, key=lambda t: (-len(votes[t]), list(q.RULES).index(t)))
        assert got[text] == (task, votes[task])


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr).first()[0]


@pytest.mark.parametrize("text,kind,thing", [
    ("Is there a small  water area?", "presence", "small water area"),
    ("Are there any roads in the image?", "presence", "roads"),
    ("Is a bridge present in the scene?", "presence", "bridge"),
    ("Does the image contain a café ?", "presence", "café"),
    ("Are there more roads than buildings?", "comp", "more roads than buildings"),
    ("How many lakes are there?", "count", None), ("Is it a rural or an urban area?", "rural_urban", None), ("Describe it", "other", None)])
def test_types_and_objects(spark, text, kind, thing):
    assert one(spark, text, q.question_type(F.col("t"))) == kind
    assert one(spark, text, q.presence_object(F.col("t"))) == thing


@pytest.mark.parametrize("answer,want", [("0", "0"), ("-3", "0"), ("10", "1-10"), ("100", "11-100"), ("1000", "101-1000"), ("1001", ">1000"),
                                         (" 7 ", "1-10"), ("7.0", None), ("x", None), (None, None), ("9" * 30, ">1000")])
def test_count_bin(spark, answer, want):
    assert one(spark, answer, F.expr(q.count_bin("t"))) == want


def test_intent_classes_fields_routes(spark):
    assert [one(spark, t, q.intent(F.col("t"))) for t in ("crop health", "flooded lake", "river", "roads")] == ["vegetation", "flood", "water", "unknown"]
    assert one(spark, "trees near the river", q.classes_in(F.col("t"), tuple(q.CLASS_PATTERNS))) == ["water", "vegetation"]
    assert one(spark, "anything", q.classes_in(F.col("t"), ("water", "built_up"))) == ["water", "built_up"]
    assert one(spark, "which sensor and when?", q.fields_in(F.col("t"))) == ["date", "sensor"]
    df = spark.createDataFrame([("water_builtup", "single"), ("change", "single"), ("metadata", "single")], "task string, mode string")
    got = [(r.routed_task, r.rerouted_from) for r in qs.route_tasks(df).collect()]
    assert got == [("vqa", "water_builtup"), (None, None), ("metadata", None)]


def unit(rng, n):
    v = rng.normal(size=n)
    return [float(x) for x in v / np.linalg.norm(v)]


def test_prompt_scores_in_one_and_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    images = [(i, unit(rng, 8)) for i in range(5)]
    prompts = [(j, f"l{j}", unit(rng, 8)) for j in range(7)]
    a = spark.createDataFrame(images, "image_id int, vec array<float>")
    b = spark.createDataFrame(prompts, "label_idx int, label string, prompt_vec array<float>")
    for in_row, per_block in ((64, 64), (4, 3)):
        monkeypatch.setattr(sc, "PROMPTS_IN_ROW", in_row)
        monkeypatch.setattr(sc, "PROMPTS_PER_BLOCK", per_block)
        got = {(r.image_id, x.label_idx): x.probability for r in sc.prompt_scores(a, b, 20.0).collect() for x in r.scores}
        for i, v in images:
            logits = 20.0 * np.array([np.dot(np.float32(v).astype(float), np.float32(p).astype(float)) for *_, p in prompts])
            want = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            assert np.allclose([got[i, j] for j in range(7)], want, atol=1e-9)


def test_masked_answers(spark):
    logits = spark.createDataFrame([(1, "count", [9.0, 1.0, 2.0]), (2, "new", [1.0, 0.0, -900.0])], "qid int, type string, logits array<double>")
    answers = spark.createDataFrame([(0, "yes"), (1, "3"), (2, "4")], "answer_idx int, answer string")
    allowed = spark.createDataFrame([("count", "3"), ("count", "4")], "type string, answer string")
    got = {(r.qid, r["rank"]): (r.answer, round(r.probability, 6)) for r in sc.masked_answers(logits, answers, allowed).collect()}
    e = np.exp(1.0)
    assert got[1, 1] == ("4", round(e / (1 + e), 6)) and got[2, 1] == ("yes", round(e / (1 + e), 6)) and (1, 3) not in got


def test_mlp_equals_numpy(spark):
    import math

    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(5, 12)), rng.normal(size=5)), (rng.normal(size=(3, 5)), rng.normal(size=3))]
    rows = [(i, unit(rng, 4), unit(rng, 4)) for i in range(6)]
    got = {r.qid: r.logits for r in sc.mlp_logits(spark.createDataFrame(rows, "qid int, image_vec array<float>, question_vec array<float>"), layers).collect()}
    for qid, a, b in rows:
        x = np.concatenate([a, b, np.multiply(a, b)])
        h = layers[0][0] @ x + layers[0][1]
        h = np.array([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in h])
        assert np.allclose(got[qid], layers[1][0] @ h + layers[1][1], atol=1e-5)


def test_vectors_and_caption(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1, 2])], "v array<float>, l array<int>")
    assert df.select(vec.l2_normalised("v")).first()[0] == [0.6, 0.8]
    assert df.select(vec.multi_hot("l", 4)).first()[0] == [0.0, 1.0, 1.0, 0.0]
    ranking = spark.createDataFrame([(1, 1, "a lake", 0.8), (1, 2, "a park", 0.125)], "image_id int, rank int, label string, probability double")
    assert an.captions(ranking).first().caption == "A satellite image of a lake (80%). Also possible: a park (12%)."


def test_qa_records_keep_the_last_active_answer(spark):
    images = spark.createDataFrame([(1, True), (2, False)], "id long, active boolean")
    questions = spark.createDataFrame([(10, 1, "count", "q", True), (11, 2, "count", "q", True), (12, 1, "count", "q", False)],
                                      "id long, img_id long, type string, question string, active boolean")
    answers = spark.createDataFrame([(1, 10, "a", True), (2, 10, "b", True), (3, 10, "c", False), (4, 11, "d", True)],
                                    "id long, question_id long, answer string, active boolean")
    assert [(r.qid, r.answer) for r in sc.qa_records(images, questions, answers).collect()] == [(10, "b")]


def test_areas(spark):
    box = "struct<w:double,s:double,e:double,n:double>"
    states = spark.createDataFrame([(1, (0.0, 0.0, 10.0, 10.0)), (2, (10.0, 0.0, 20.0, 10.0))], f"state_id int, box {box}")
    districts = spark.createDataFrame([(1, "Alpha ", (8.0, 1.0, 11.0, 2.0)), (2, "Beta", (9.0, 1.0, 13.0, 2.0)), (3, "Enclave", (2.0, 2.0, 3.0, 3.0)),
                                       (4, "NONE", (2.0, 2.0, 3.0, 3.0))], f"district_id int, name string, box {box}")
    forced = spark.createDataFrame([("Enclave", 2)], "name string, state_id int")
    dropped = spark.createDataFrame([("NONE",)], "name string")
    assigned = ar.assign(districts, states, forced, dropped)
    assert {r.name: (r.state_id, r.forced) for r in assigned.collect()} == {"Alpha ": (1, False), "Beta": (2, False), "Enclave": (2, True)}
    named = ar.rename(assigned, spark.createDataFrame([(1, "Alpha", "Alfa")], "state_id int, old_name string, new_name string"))
    assert {r.district for r in named.collect()} == {"Alfa", "Beta", "Enclave"}
    aliases = ar.alias_rows(named, spark.createDataFrame([(2, "Old B", "Beta")], "state_id int, alias string, district string"))
    requests = spark.createDataFrame([(1, "Alpha"), (2, "Old B"), (2, "Beta"), (1, "Beta")], "state_id int, area string")
    got = {(r.state_id, r.area): r.district for r in ar.resolve_areas(requests, named, aliases).collect()}
    assert got == {(1, "Alpha"): "Alfa", (2, "Old B"): "Beta", (2, "Beta"): "Beta", (1, "Beta"): None}
    assert ar.duplicates(named).count() == 0
    majors = spark.createDataFrame([(1, 0, "City", "Alfa"), (2, 0, "Town", "Gone")], "state_id int, position int, label string, district string")
    assert [r.district for r in ar.dangling(majors, named).collect()] == ["Gone"]
    records = ar.state_records(spark.createDataFrame([(1, "One"), (2, "Two")], "state_id int, state_name string"), named, aliases, majors)
    one_state = {r.state_name: r for r in records.collect()}["One"]
    assert one_state.districts == ["Alfa"] and one_state.aliases == {"Alpha": "Alfa"} and one_state.major_cities[0].label == "City"


def test_predict(spark):
    items = spark.createDataFrame([("1", "u1", "single", "Describe this image"), ("2", "u2", "single", "Describe this image"), ("3", "u1", "single", "What changed?"),
                                   ("4", "u1", "single", "xyz"), ("5", "u1", "single", "Is there water?")], "id string, upload_id string, mode string, question string")
    validation = spark.createDataFrame([("u1", True), ("u2", False)], "upload_id string, ok boolean")
    results = spark.createDataFrame([("u1", "caption", "OK", "long", None, 0.5)],
                                    "upload_id string, task string, status string, answer string, short_answer string, confidence double")
    got = {r.id: (r.status, r.answer, r.task, r.task_mismatch) for r in pr.predict(items, validation, results, "caption").collect()}
    assert got["1"] == ("OK", "long", "caption", None)
    assert got["2"][0] == "REJECTED" and got["3"][:2] == ("REJECTED", None) and got["4"][0] == "REJECTED"
    assert got["5"][:3] == ("NOT_AVAILABLE", None, "vqa") and got["5"][3] == "routed to 'vqa', not 'caption'"


def test_common_texts_are_classified_beside_the_join(spark):
    texts = ["What changed between the dates?", "watr and bilt up", "hello", None, ""]
    log = spark.createDataFrame([(i, texts[i % 5 if i < 40 else 1]) for i in range(60)] + [(60, "descrbe the pictur")], "qid int, question string")
    wanted = [tuple(r) for r in qs.classify_questions(log).orderBy("qid").collect()]
    assert len(wanted) == 61
    assert [tuple(r) for r in qs.classify_questions(log, common=10).orderBy("qid").collect()] == wanted
    assert [tuple(r) for r in qs.classify_questions(log, common=1).orderBy("qid").collect()] == wanted


def test_rules_run_once_per_text_and_not_as_a_filter_on_rows(spark):
    log = spark.createDataFrame([(1, "hello"), (2, "Describe this image")], "qid int, question string")
    plan = qs.classify_questions(log)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "RLIKE" in line]
