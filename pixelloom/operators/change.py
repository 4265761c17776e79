"""Land-cover change between two dates of the same place.

Each index meets three thresholds (the set one and the set one moved by 0.05 either way), so a pixel is
fully described by how many of the three it passes, for water, vegetation and built-up, on both dates: at
most 4^6 combinations per pair. One aggregation of the compared pixels counts these combinations and the
NDVI values of both dates. Everything reported (class areas, transitions, the 27 threshold runs, the season
check) is worked out from that table.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import indices as ix
from pixelloom.functions.geodesy import pixel_area
from pixelloom.functions.semantics import (
    all_present, case_literal, fixed_text, holds, percent, percent_text, round_binary, rounded)
from pixelloom.operators.ordered import counted_percentiles

KEY = ("pair_id", "row", "col")
REQUIRED = ("green", "red", "nir")
SHIFT = 0.05
DATES = ("before", "after")
#: What is left of the confidence where model and rules disagree.
DISAGREEMENT = 0.5


@dataclass(frozen=True)
class ChangeParams:
    water_threshold: float = 0.0
    vegetation_ndvi: float = 0.3
    builtup_threshold: float = 0.0
    ndvi_max_builtup: float = 0.2
    unchanged_tolerance_pp: float = 1.0

    def __post_init__(self):
        for name in ("water_threshold", "vegetation_ndvi", "builtup_threshold", "ndvi_max_builtup"):
            if not -1 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between -1 and 1")
        if not 0 <= self.unchanged_tolerance_pp <= 20:
            raise ValueError("unchanged_tolerance_pp must be between 0 and 20")


def pair_profile(pairs: DataFrame) -> DataFrame:
    """What two dates can be compared on: shared roles, ignored bands, missing bands, methods, warnings."""
    shared = F.array_sort(F.array_intersect("roles_before", "roles_after"))
    every = F.array_union("roles_before", "roles_after")
    profile = pairs.withColumn("shared", shared).withColumn(
        "ignored", F.array_sort(F.array_except(every, F.col("shared")))).withColumn(
        "missing", F.array_except(F.array(*[F.lit(r) for r in REQUIRED]), F.col("shared")))
    swir = F.array_contains("shared", "swir1")
    return (profile.withColumn("has_swir", swir).withColumn("comparable", F.size("missing") == 0)
            .withColumn("water_method", F.when(swir, "MNDWI (green, SWIR1)").otherwise("NDWI (green, NIR)"))
            .withColumn("built_method", F.when(swir, "NDBI (SWIR1, NIR)").otherwise("low-NDVI proxy (no SWIR)"))
            .withColumn("band_warnings", F.array_compact(F.array(
                F.when(~swir, "No SWIR band on both dates: built-up uses a low-NDVI proxy, which also counts bare "
                       "soil as built-up."),
                F.when(F.size("ignored") > 0, F.concat(F.lit("Bands only present on one date were ignored: "),
                                                       F.concat_ws(", ", "ignored"), F.lit(".")))))))


def compared_pixels(before: DataFrame, after: DataFrame, pairs: DataFrame,
                    params: ChangeParams = ChangeParams()) -> DataFrame:
    """Pixels valid on both dates, with NDVI and the number of thresholds passed per index and date."""
    bands = ("green", "red", "nir", "swir1")

    def side(df, date):
        return df.selectExpr(*KEY, *[f"{b if b in df.columns else 'cast(null as double)'} {b}_{date}" for b in bands])

    profile = pair_profile(pairs).where("comparable").select("pair_id", "has_swir", "units", "a", "e", "f")
    joined = side(before, "before").join(side(after, "after"), list(KEY)).join(
        F.broadcast(profile), "pair_id")  # a shuffle by pair would bring all its pixels to one task
    needed = " and ".join(f"{b}_{d} is not null" for d in DATES for b in REQUIRED)
    valid = joined.where(f"{needed} and (not has_swir or (swir1_before is not null and swir1_after is not null))")

    def index(x, y):
        return f"try_divide(cast({x} as double) - {y}, cast({x} as double) + {y})"

    valid = valid.selectExpr(*KEY, "has_swir", "units", "a", "e", "f", *[e for d in DATES for e in (
        f"{index(f'nir_{d}', f'red_{d}')} ndvi_{d}",
        f"if(has_swir, {index(f'green_{d}', f'swir1_{d}')}, {index(f'green_{d}', f'nir_{d}')}) __w_{d}",
        f"if(has_swir, {index(f'swir1_{d}', f'nir_{d}')}, null) __b_{d}")])

    def passed(name, op, threshold):
        """How many of the three thresholds are passed; a missing index passes none."""
        tests = [f"if({name} {op} {threshold + s!r}D, 1, 0)" for s in (-SHIFT, 0.0, SHIFT)]
        return " + ".join(tests)

    codes = []
    for d in DATES:
        codes += [
            f"ndvi_{d}", f"{passed(f'__w_{d}', '>', params.water_threshold)} water_{d}",
            f"{passed(f'ndvi_{d}', '>', params.vegetation_ndvi)} veg_{d}",
            f"if(has_swir, {passed(f'__b_{d}', '>', params.builtup_threshold)}, "
            f"{passed(f'ndvi_{d}', '<', params.ndvi_max_builtup)}) built_{d}"]
    area = pixel_area(F.col("units"), F.col("a"), F.col("e"), F.col("f"), F.col("row"))
    return valid.withColumn("area_m2", area).selectExpr(*KEY, "area_m2", *codes)


CODES = tuple(f"{i}_{d}" for d in DATES for i in ("water", "veg", "built"))


def counted_pixels(pixels: DataFrame) -> DataFrame:
    """The one pass over compared pixels: counts per pair of code combinations and of NDVI values.

    Rows of ``kind`` "codes" have a combination with its area; rows of kind "before" and "after" have an NDVI
    value of that date. Rows are counted by one number in place of kind and six codes, each of which is 0 to 3.
    """
    packed = " + ".join(f"{4 ** i} * {c}" for i, c in enumerate(CODES))
    rows = [f"named_struct('__key', {packed}, 'value', cast(null as double), 'area_m2', area_m2)"]
    rows += [f"named_struct('__key', {-1 - i}, 'value', ndvi_{d}, 'area_m2', cast(null as double))" for i, d in enumerate(DATES)]
    counted = pixels.selectExpr("pair_id", f"inline(array({', '.join(rows)}))").groupBy("pair_id", "__key", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("area_m2").alias("area_m2"))
    kinds = " ".join(f"when {-1 - i} then '{d}'" for i, d in enumerate(DATES))
    return counted.selectExpr("pair_id", f"case __key {kinds} else 'codes' end kind", *[
        f"if(__key >= 0, cast(__key div {4 ** i} % 4 as int), null) {c}" for i, c in enumerate(CODES)], "value", "n", "area_m2")


def threshold_counts(counted: DataFrame) -> DataFrame:
    """Pixel count and area per pair and combination of passed thresholds (at most 4,096 rows a pair)."""
    return counted.where("kind = 'codes'").select("pair_id", *CODES, "n", "area_m2")


def _class_at(date: str, water="2", veg="2", built="2") -> str:
    """SQL text of the class when an index must pass that many of its three thresholds."""
    code = ix.CLASS_CODES
    return (f"case when water_{date} >= {water} then {code['water']} when veg_{date} >= {veg} then {code['vegetation']} "
            f"when built_{date} >= {built} then {code['built_up']} else {code['other']} end")


def mapped_counts(counts: DataFrame) -> DataFrame:
    """Counts per pair, class before and class after at the set thresholds (the middle of the three)."""
    return (counts.selectExpr("pair_id", f"{_class_at('before')} from_code", f"{_class_at('after')} to_code", "n", "area_m2")
            .groupBy("pair_id", "from_code", "to_code").agg(F.sum("n").alias("n"), F.sum("area_m2").alias("area_m2")))


def change_classes(counts: DataFrame, params: ChangeParams = ChangeParams()) -> DataFrame:
    """Per pair and class: shares and areas of both dates, difference, relative change and direction.

    Differences come from the rounded shares, so text, numbers and direction always agree.
    """
    sums = ["sum(n) valid_pixels"]
    for code in ix.CLASS_CODES.values():
        for d, col in (("before", "from_code"), ("after", "to_code")):
            sums += [f"sum(if({col} = {code}, n, 0)) {d}_n_{code}",
                     f"sum(case when {col} = {code} then area_m2 when area_m2 is not null then 0D end) {d}_m2_{code}"]
    structs = ", ".join(
        f"named_struct('class_code', {code}, 'class', '{name}', "
        + ", ".join(f"'{d}_{m}', {d}_{m}_{code}" for d in DATES for m in ("n", "m2")) + ")"
        for name, code in ix.CLASS_CODES.items())
    wide = mapped_counts(counts).groupBy("pair_id").agg(*[F.expr(t) for t in sums])
    long = wide.selectExpr("pair_id", "valid_pixels", f"inline(array({structs}))")
    shares = long.selectExpr(
        "pair_id", "class_code", "class", "valid_pixels", "before_n before_pixels", "after_n after_pixels",
        *[f"{percent_text(f'{d}_n', 'valid_pixels')} {d}_percent" for d in DATES],
        *[f"{rounded(f'{d}_m2 / 1e6D', 4)} {d}_km2" for d in DATES])
    deltas = shares.selectExpr("*", f"{rounded('after_percent - before_percent', 2)} delta_pp",
                               f"{rounded('after_km2 - before_km2', 4)} delta_km2")
    return deltas.withColumn(
        "relative_change_percent", round_binary("try_divide(100D * delta_pp, before_percent)", 1)).withColumn("direction", ix.direction(F.col("delta_pp"), params.unchanged_tolerance_pp))


def change_transitions(counts: DataFrame) -> DataFrame:
    """Off-diagonal class changes per pair, largest first (``rank``); ties in class order."""
    mapped = mapped_counts(counts)
    total = mapped.withColumn("__total", F.sum("n").over(Window.partitionBy("pair_id")))
    moved = total.where(F.col("from_code") != F.col("to_code"))
    names = {code: name for name, code in ix.CLASS_CODES.items()}
    order = Window.partitionBy("pair_id").orderBy(F.desc("n"), "from_code", "to_code")
    return moved.select(
        "pair_id", F.row_number().over(order).alias("rank"), case_literal(F.col("from_code"), names).alias("from_class"),
        case_literal(F.col("to_code"), names).alias("to_class"), percent("n", "__total").alias("percent"),
        F.col("n").alias("pixels"))


def change_robustness(counts: DataFrame, classes: DataFrame, params: ChangeParams = ChangeParams()) -> DataFrame:
    """Share of the 27 threshold runs that give each class the same direction as the main run.

    A threshold moved to its easy side needs one pass of three, unmoved two, to its hard side three.
    The runs multiply only the combination counts, never the pixels.
    """
    runs = ", ".join(f"named_struct('run', {i}, 'w', {w}, 'v', {v}, 'b', {b})"
                     for i, (w, v, b) in enumerate(itertools.product((1, 2, 3), repeat=3)))
    per_run = counts.selectExpr("*", f"inline(array({runs}))").selectExpr(
        "pair_id", "run", "n", *[f"{_class_at(d, 'w', 'v', 'b')} {d}_code" for d in DATES])
    sums = [F.expr(f"sum(if({d}_code = {code}, n, 0)) {d}_{code}") for d in DATES for code in ix.CLASS_CODES.values()]
    totals = per_run.groupBy("pair_id", "run").agg(F.sum("n").alias("__valid"), *sums)
    structs = ", ".join(f"named_struct('class', '{name}', 'b', before_{code}, 'a', after_{code})"
                        for name, code in ix.CLASS_CODES.items())
    long = totals.selectExpr("pair_id", "run", "__valid", f"inline(array({structs}))")
    shares = long.withColumns({s: percent(s, "__valid") for s in ("a", "b")})
    turned = shares.withColumn("delta", round_binary("a - b", 2)).withColumn(
        "run_direction", ix.direction(F.col("delta"), params.unchanged_tolerance_pp))
    main = classes.select("pair_id", "class", "direction")
    return turned.join(main, ["pair_id", "class"]).groupBy("pair_id", "class").agg(
        F.avg((F.col("run_direction") == F.col("direction")).cast("double")).alias("__same"),
        F.count(F.lit(1)).alias("runs")).select("pair_id", "class", round_binary("__same", 4).alias("robustness"), "runs")


def season_check(counted: DataFrame) -> DataFrame:
    """90th percentile NDVI of both dates, their gap and the confidence factor it leaves.

    A row for every compared pair: without an NDVI on both dates the gap is NULL and the factor 0.
    """
    values = counted.where("kind <> 'codes' and value is not null").select(
        "pair_id", "kind", F.col("value").alias("__value"), F.col("n").alias("__n"))
    tops = counted_percentiles(values, ["pair_id", "kind"], {"p90": 0.9}).groupBy("pair_id").agg(
        *[F.max(F.when(F.col("kind") == d, F.col("p90"))).alias(f"ndvi_{d}_p90") for d in DATES])
    every = counted.where("kind = 'codes'").select("pair_id").distinct()
    return every.join(tops, "pair_id", "left").select(
        "pair_id", round_binary("ndvi_before_p90", 4).alias("season_before"),
        round_binary("ndvi_after_p90", 4).alias("season_after"),
        round_binary("abs(ndvi_after_p90 - ndvi_before_p90)", 4).alias("season_gap")).withColumn(
        "season_factor", F.when(F.col("season_gap").isNull(), F.lit(0.0)).otherwise(ix.season_factor("season_gap")))


def season_warning(gap, before: str, after: str):
    return F.when(gap >= ix.SEASON_WARNING_GAP, F.concat(
        F.lit("The dates differ in overall greenness (NDVI p90 "), F.expr(fixed_text(before, 2)), F.lit(" vs "),
        F.expr(fixed_text(after, 2)),
        F.lit("). Index rules count dry bare fields as built-up, so built-up / vegetation / other changes may reflect "
              "season or rainfall rather than real land-cover change. Compare images from the same season.")))


def class_confidence(robustness: DataFrame, season: DataFrame) -> DataFrame:
    """Robustness, times the season factor for the classes that greenness affects."""
    sensitive = ", ".join(f"'{c}'" for c in ix.SEASON_SENSITIVE)
    return robustness.join(season, "pair_id", "left").withColumn(
        "confidence", round_binary(f"robustness * if(class in ({sensitive}), coalesce(season_factor, 0D), 1D)", 4))


def change_summary(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: status, compared pixels and area, changed share. Pairs that cannot be compared say why."""
    mapped = mapped_counts(counts).groupBy("pair_id").agg(
        F.sum("n").alias("valid_pixels"), F.sum("area_m2").alias("__m2"),
        F.sum(F.when(F.col("from_code") != F.col("to_code"), F.col("n")).otherwise(0)).alias("__changed"))
    profile = pair_profile(pairs)
    status = (F.when(~F.col("comparable"), "NOT_AVAILABLE").when(F.col("valid_pixels").isNull(), "ERROR").otherwise("OK"))
    return profile.join(mapped, "pair_id", "left").select(
        "pair_id", status.alias("status"), F.concat_ws(",", "missing").alias("missing_bands"),
        F.concat_ws(",", "shared").alias("bands_used"), F.concat_ws(",", "ignored").alias("ignored_bands"),
        "water_method", "built_method", "valid_pixels",
        round_binary("__m2 / 1e6D", 4).alias("valid_area_km2"),
        percent("__changed", "valid_pixels").alias("changed_percent"))


@dataclass
class ChangeResult:
    """Result tables of one change analysis. All but ``pixels`` read ``counted``, which is kept on the executors.

    Nothing runs before a table is asked for; the first one fills ``counted``. ``counted.unpersist()`` frees it.
    """

    pixels: DataFrame
    counted: DataFrame
    classes: DataFrame
    transitions: DataFrame
    robustness: DataFrame
    season: DataFrame
    confidence: DataFrame
    summary: DataFrame


def analyse_change(before: DataFrame, after: DataFrame, pairs: DataFrame,
                   params: ChangeParams = ChangeParams()) -> ChangeResult:
    """All result tables from one lazy pass over the pixels of both dates."""
    pixels = compared_pixels(before, after, pairs, params)
    counted = counted_pixels(pixels).persist()
    counts = threshold_counts(counted)
    classes = change_classes(counts, params)
    robustness = change_robustness(counts, classes, params)
    season = season_check(counted)
    return ChangeResult(pixels, counted, classes, change_transitions(counts), robustness, season,
                        class_confidence(robustness, season), change_summary(counts, pairs))


def class_map(pixels: DataFrame) -> DataFrame:
    """Class of every compared pixel on both dates, for overlays."""
    return pixels.selectExpr(*KEY, f"{_class_at('before')} before_code", f"{_class_at('after')} after_code")


def model_direction(scene_scores: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Built-up direction from scene scores ``(pair_id, date, score)`` of both dates; ``in_distribution`` is carried if it is there."""
    known = [F.min("in_distribution").alias("in_distribution")] if "in_distribution" in scene_scores.columns else []
    sides = scene_scores.groupBy("pair_id").agg(*known, *[
        F.max(F.when(F.col("date") == d, F.col("score"))).alias(f"score_{d}") for d in DATES]).withColumns(
        {f"score_{d}": round_binary(f"score_{d}", 4) for d in DATES})
    return sides.where(all_present(F.col("score_before"), F.col("score_after"))).withColumn(
        "score_delta", round_binary("score_after - score_before", 4)).withColumn(
        "model_direction", ix.direction(F.col("score_delta"), tolerance))


def built_up_verdict(classes: DataFrame, confidence: DataFrame, model: DataFrame, penalty: float = DISAGREEMENT) -> DataFrame:
    """Built-up direction: the model's where there is one; disagreement with the rules halves the confidence."""
    rules = classes.where(F.col("class") == "built_up").select(
        "pair_id", F.col("direction").alias("rules_direction"), F.col("delta_pp").alias("rules_delta_pp"))
    sure = confidence.where(F.col("class") == "built_up").select("pair_id", "confidence")
    joined = rules.join(sure, "pair_id", "left").join(model, "pair_id", "left")
    agree = F.col("model_direction") == F.col("rules_direction")
    return joined.select(
        "pair_id", "rules_direction", "rules_delta_pp", "model_direction", *(c for c in model.columns if c == "in_distribution"), "score_before", "score_after", "score_delta", agree.alias("agree"),
        F.coalesce("model_direction", "rules_direction").alias("direction"),
        F.when(holds(~agree), F.col("confidence") * penalty).otherwise(F.col("confidence")).alias("confidence"))
