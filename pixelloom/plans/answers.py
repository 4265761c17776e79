"""Answer sentences built only from computed result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import wording as wd
from pixelloom.functions.indices import CLASS_LABELS
from pixelloom.functions.semantics import fixed_text, general_text, steady_mean, whole_percent_text
from pixelloom.operators import change as ch
from pixelloom.operators import fusion as fu

# Words of the sentences.
VERBS = {"increased": "increased", "decreased": "decreased", "unchanged": "remained essentially unchanged"}
SHORT_NAMES = {"water": "Water", "built_up": "Built-up", "vegetation": "Vegetation", "other": "Other land"}
LONG_NAMES = {"water": "water", "built_up": "built-up area", "vegetation": "vegetation", "other": "other land"}


def _words(key: str, table: dict) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def _joined(line: str, order: str, separator: str):
    """Lines of a group in order. A group is the four classes or at most twelve transitions of a pair."""
    return F.expr(f"concat_ws('{separator}', transform(array_sort(collect_list(named_struct('k', {order}, 'l', {line}))), x -> x.l))")


def change_lines(classes: DataFrame, pairs: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """One sentence per pair and class."""
    dated = classes.join(pairs.select("pair_id", "date_before", "date_after"), "pair_id")
    areas = (f"coalesce(concat(', ', {general_text('before_km2')}, ' -> ', {general_text('after_km2')}, ' km², ', "
             f"{general_text('delta_km2', True)}, ' km²'), '')")
    relative = f"if(direction <> 'unchanged', coalesce(concat(', ', {fixed_text('relative_change_percent', 1, True)}, '% relative'), ''), '')"
    line = (f"concat({_words('class', CLASS_LABELS)}, ' ', {_words('direction', VERBS)}, ': ', {fixed_text('before_percent', 2)}, '% on ', date_before, "
            f"' -> ', {fixed_text('after_percent', 2)}, '% on ', date_after, ' (', {fixed_text('delta_pp', 2, True)}, ' percentage points', "
            f"{areas}, {relative}, ')', if(direction = 'unchanged', '; the change is within the ±{tolerance:g} pp tolerance', ''), '.')")
    return dated.withColumn("line", F.expr(line))


def change_warnings(season: DataFrame, pairs: DataFrame) -> DataFrame:
    """Warnings of a pair in order: missing SWIR, ignored bands, season."""
    bands = ch.pair_profile(pairs).select("pair_id", "band_warnings")
    return bands.join(season, "pair_id", "left").select("pair_id", F.array_compact(F.concat("band_warnings", F.array(
        ch.season_warning(F.col("season_gap"), "season_before", "season_after")))).alias("warnings"))


def change_answers(result: ch.ChangeResult, pairs: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The full answer of each pair: what changed, every class, the largest transitions, notes."""
    lines = change_lines(result.classes, pairs, tolerance).withColumn("__line", F.col("line")).groupBy("pair_id").agg(
        _joined("__line", "struct(-abs(delta_pp), class_code)", "\\n").alias("__lines"))
    tops = result.transitions.where("rank <= 3").withColumn("__line", F.expr(
        f"concat({_words('from_class', CLASS_LABELS)}, ' -> ', {_words('to_class', CLASS_LABELS)}, ' ', {fixed_text('percent', 2)}, '%')")).groupBy(
        "pair_id").agg(_joined("__line", "rank", "; ").alias("__tops"))
    notes = change_warnings(result.season, pairs)
    summary = result.summary.where("status = 'OK'").select("pair_id", "changed_percent")
    joined = (summary.join(pairs.select("pair_id", "date_before", "date_after"), "pair_id").join(lines, "pair_id")
              .join(tops, "pair_id", "left").join(notes, "pair_id", "left"))
    answer = (f"concat_ws('\\n', concat('Between ', date_before, ' and ', date_after, ', ', {fixed_text('changed_percent', 2)}, "
              "'% of the compared area changed land-cover class.'), __lines, concat('Largest transitions: ', __tops, '.'), "
              "transform(warnings, w -> concat('Note: ', w)))")
    headline = (f"concat('About ', {fixed_text('changed_percent', 1)}, '% of the area changed between ', {wd.date_text('date_before')}, "
                f"' and ', {wd.date_text('date_after')}, '.')")
    return joined.select("pair_id", F.expr(answer).alias("answer"), F.expr(headline).alias("headline"),
                         wd.caveats("warnings", wd.CHANGE_CAVEATS).alias("caveats"))


def class_headlines(classes: DataFrame) -> DataFrame:
    """Short answer and headline per pair and class, for questions about one class."""
    name = _words("class", LONG_NAMES)
    head = (f"if(direction = 'unchanged', concat('No — the ', {name}, ' has stayed about the same.'), "
            f"concat('Yes — the ', {name}, ' has ', direction, '.'))")
    number = f"concat({_words('class', SHORT_NAMES)}, ': ', {fixed_text('before_percent', 2)}, '% → ', {fixed_text('after_percent', 2)}, '% of the area')"
    return classes.select("pair_id", "class", F.col("direction").alias("short_answer"), F.expr(head).alias("headline"),
                          F.expr(number).alias("key_number"))


def model_line(verdict: DataFrame, pairs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Leading sentence where a model decided the built-up direction.

    Says how the pixel rules differ, and where ``in_distribution`` is given and false, that the image is unlike
    what the model was trained on.
    """
    apart = "'Input is not Sentinel-2-like reflectance, so the model is out of its training distribution. '"
    unlike = f"if(not coalesce(in_distribution, true), {apart}, '')" if "in_distribution" in verdict.columns else "''"
    text = (f"concat('Built-up ', {_words('model_direction', VERBS)}, ' according to the land-cover model: scene score ', {fixed_text('score_before', 2)}, ' on ', "
            f"date_before, ' -> ', {fixed_text('score_after', 2)}, ' on ', date_after, ' (', {fixed_text('score_delta', 2, True)}, '; unchanged within ±{tolerance:g}). ', {unlike}, "
            f"if(agree, 'The pixel rules agree.', concat('Disagreement: the pixel rules say built-up ', {_words('rules_direction', VERBS)}, ' (', "
            f"{fixed_text('rules_delta_pp', 2, True)}, ' percentage points, area table below); confidence lowered.')))")
    return verdict.where("model_direction is not null").join(pairs.select("pair_id", "date_before", "date_after"), "pair_id").select(
        "pair_id", F.expr(text).alias("lead"))


def asked_answers(result: ch.ChangeResult, pairs: DataFrame, asked: DataFrame, model: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """The answer to a question about some classes: ``asked`` is ``(pair_id, classes ARRAY)``, ``model`` as of ``model_direction``.

    Fewer than four classes get a line each, in the order asked; all four get the full answer. A model's
    direction leads the answer about built-up, decides the short answer where only built-up is asked, and
    halves the confidence where the rules disagree. The confidence is the mean over the asked classes.
    """
    verdict = ch.built_up_verdict(result.classes, result.confidence, model)
    every = len(CLASS_LABELS)
    each = asked.select("pair_id", F.posexplode("classes").alias("i", "class"))
    lines = change_lines(result.classes, pairs, tolerance).select("pair_id", "class", "line", "direction")
    found = each.join(lines, ["pair_id", "class"]).join(result.confidence.select("pair_id", "class", "confidence"), ["pair_id", "class"], "left")
    some = found.withColumn("__line", F.col("line")).groupBy("pair_id").agg(
        _joined("__line", "i", "\n").alias("__some"), F.expr(steady_mean("confidence", 4)).alias("__mean"), F.count(F.lit(1)).alias("__n"),
        F.max(F.when(F.col("class") == "built_up", F.lit(True))).alias("__built"), F.max("direction").alias("__only"))
    whole = change_answers(result, pairs, tolerance).select("pair_id", F.col("answer").alias("__whole"))
    notes = change_warnings(result.season, pairs).select("pair_id", "warnings")
    leads = model_line(verdict, pairs).join(verdict.select("pair_id", "agree", "model_direction"), "pair_id")
    joined = some.join(whole, "pair_id", "left").join(notes, "pair_id", "left").join(leads, "pair_id", "left")
    led = F.col("__built") & F.col("lead").isNotNull()
    body = F.when(F.col("__n") < every, F.expr("concat_ws('\n', __some, transform(warnings, w -> concat('Note: ', w)))")).otherwise(F.col("__whole"))
    short = F.when(F.col("__n") == 1, F.when(led, F.col("model_direction")).otherwise(F.col("__only")))
    sure = F.col("__mean") * F.when(led & ~F.col("agree"), F.lit(ch.DISAGREEMENT)).otherwise(F.lit(1.0))
    return joined.select("pair_id", F.when(led, F.concat_ws("\n", "lead", body)).otherwise(body).alias("answer"), short.alias("short_answer"),
                         sure.alias("confidence"))


def fusion_answers(stats: DataFrame, profile: DataFrame, pairs: DataFrame, params: fu.FusionParams = fu.FusionParams()) -> DataFrame:
    """The answer of each optical + radar pair, class by class, and a headline."""
    methods = fu.fusion_methods(pairs, params).select("pair_id", "optical_water", "optical_built_up", "warnings")
    joined = stats.join(methods, "pair_id").join(profile.select("pair_id", "sar_band", "was_linear"), "pair_id")
    scope = (f"coalesce(concat('the ', {general_text('valid_area_km2')}, ' km² both images cover'), concat('the ', valid_pixels, ' pixels both images cover'))")
    radar = "concat(upper(sar_band), if(was_linear, ' (linear, converted to dB)', ' (dB)'))"
    rule = (f"if(class = 'water', concat({radar}, ' < {params.sar_water_db:g} dB'), concat({radar}, ' > {params.sar_builtup_db:g} dB'))")
    method = "if(class = 'water', optical_water, optical_built_up)"
    detail = (f"case when both_percent is not null then concat('Optical (', {method}, ') flagged ', {fixed_text('optical_percent', 2)}, '%, SAR (', {rule}, ') flagged ', "
              f"{fixed_text('sar_percent', 2)}, '%; they agree on ', {fixed_text('both_percent', 2)}, '% (optical only ', {fixed_text('optical_only_percent', 2)}, "
              f"'%, SAR only ', {fixed_text('sar_only_percent', 2)}, '%, agreement ', {whole_percent_text('agreement')}, ').') "
              f"when optical_percent is not null then concat('Detected by optical only (', {method}, '); SAR could not be used.') "
              f"else concat('Detected by SAR only (', {rule}, '); optical bands were missing.') end")
    line = (f"concat({_words('class', CLASS_LABELS)}, if(percent is null, ': not computed (neither modality has the needed bands).', "
            f"concat(': ', {fixed_text('percent', 2)}, '% of ', {scope}, coalesce(concat(' (', {general_text('area_km2')}, ' km²)'), ''), '. ', {detail})))")
    words = {"water": "water", "built_up": "built-up (buildings and roads)"}
    part = f"concat({fixed_text('percent', 1)}, '% of the area is ', {_words('class', words)})"
    rows = joined.withColumns({"__line": F.expr(line), "__part": F.expr(part), "__i": F.expr("if(class = 'water', 0, 1)")})
    end = "both modalities must agree" if params.fusion == "and" else "either modality is enough"
    grouped = rows.groupBy("pair_id").agg(
        _joined("__line", "__i", "\\n").alias("__lines"), _joined("__part", "__i", " and ").alias("__parts"),
        F.expr("min_by(class, named_struct('a', agreement, 'i', __i)) filter (where agreement is not null)").alias("worst_agreement"),
        F.any_value("warnings").alias("warnings"))
    return grouped.select(
        "pair_id", F.expr(f"concat(__lines, '\\nFinal masks: {end}.')").alias("answer"),
        F.expr("if(__parts = '', 'We couldn\\'t measure water or buildings with these two images.', concat('About ', __parts, '.'))").alias("headline"),
        "worst_agreement", wd.caveats("warnings", wd.FUSION_CAVEATS).alias("caveats"))


def captions(ranking: DataFrame) -> DataFrame:
    """Caption per image from its ranked scene labels."""
    named = ranking.withColumn("__line", F.expr(f"concat(label, ' (', {wd.chance_text('probability')}, ')')"))
    grouped = named.groupBy("image_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("__line"))).alias("__first"),
        F.expr("concat_ws(', ', transform(array_sort(collect_list(if(rank > 1, named_struct('k', rank, 'l', __line), null))), x -> x.l))").alias("__others"),
        F.max(F.when(F.col("rank") == 1, F.col("probability"))).alias("confidence"))
    text = "concat('A satellite image of ', __first, '.', if(__others = '', '', concat(' Also possible: ', __others, '.')))"
    return grouped.select("image_id", F.expr(text).alias("caption"), "confidence", wd.confidence_level("confidence").alias("level"))


def qa_headlines(answers: DataFrame) -> DataFrame:
    """Headline of each short answer ``(qid, type, object, answer, probability)``."""
    text = """case
      when type = 'rural_urban' then concat('This looks like ', if(answer = 'rural', 'a rural area (countryside)', 'an urban area (a town or city)'), '.')
      when type = 'presence' and answer = 'yes' and object is not null then concat('Yes — the model found ', object, ' in this image.')
      when type = 'presence' and answer = 'no' and object is not null then concat('No — the model did not find ', object, ' in this image.')
      when type = 'count' then concat('The model estimates a count of about ', answer, '.')
      when answer in ('yes', 'no') then concat(initcap(answer), ' — that is the model\\'s answer to your question.')
      else concat('The model\\'s answer is "', answer, '".') end"""
    return answers.withColumns({"headline": F.expr(text), "level": wd.confidence_level("probability"),
                                "certainty": F.expr(wd.chance_text("probability"))})
