"""Water and built-up mapping from an optical and a radar image of the same place."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import indices as ix
from pixelloom.functions.geodesy import pixel_area
from pixelloom.functions.semantics import holds, percent_text, round_binary, rounded, steady_mean
from pixelloom.operators.ordered import exact_percentiles

KEY = ("pair_id", "row", "col")
CLASSES = ("water", "built_up")


@dataclass(frozen=True)
class FusionParams:
    """Thresholds of the two votes. The ranges are part of the feature and are checked."""

    sar_water_db: float = -18.0
    sar_builtup_db: float = -6.0
    optical_water_threshold: float = 0.0
    optical_builtup_threshold: float = 0.0
    ndvi_max_builtup: float = 0.2
    fusion: str = "and"

    def __post_init__(self):
        def within(name, low, high):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")

        within("sar_water_db", -35, -5)
        within("sar_builtup_db", -15, 10)
        for name in ("optical_water_threshold", "optical_builtup_threshold", "ndvi_max_builtup"):
            within(name, -1, 1)
        if self.fusion not in ("and", "or"):
            raise ValueError("fusion must be 'and' or 'or'")
        if self.sar_builtup_db <= self.sar_water_db:
            raise ValueError("sar_builtup_db must be higher than sar_water_db")


def radar_profile(radar: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: the polarisation used, whether its values are linear power, and if they look calibrated.

    The choice comes from the catalogue row. Minimum and count are partial sums; the median takes
    the two-pass percentile, as one image can hold most of the pixels.
    """
    values = _radar_values(radar, pairs)
    lows = values.groupBy("pair_id").agg(F.min("value").alias("__min"))
    linear = holds(F.col("__min") >= 0)
    in_db = values.join(lows, "pair_id").select(
        "pair_id", F.when(linear, ix.db_from_linear(F.col("value"))).otherwise(F.col("value")).alias("db"))
    middle = exact_percentiles(in_db, ["pair_id"], ["db"], {"median": 0.5})
    return (pairs.select("pair_id", ix.radar_band(F.col("roles_radar")).alias("sar_band"))
            .join(lows, "pair_id", "left").join(middle, "pair_id", "left")
            .select("pair_id", "sar_band", linear.alias("was_linear"), F.col("db_median").alias("median_db"),
                    F.when(F.col("sar_band").isNotNull(), ix.looks_calibrated(F.col("db_median")))
                    .alias("sar_calibrated")))


def _radar_values(radar: DataFrame, pairs: DataFrame) -> DataFrame:
    choice = pairs.select("pair_id", ix.radar_band(F.col("roles_radar")).alias("__choice"))
    pixel = {p: F.col(p) for p in ix.RADAR_CHOICE if p in radar.columns}
    return radar.join(choice, "pair_id").select(*KEY, ix.radar_value(F.col("__choice"), pixel).alias("value"))


def fused_pixels(optical: DataFrame, radar: DataFrame, pairs: DataFrame,
                 params: FusionParams = FusionParams()) -> DataFrame:
    """Pixels valid in both images with the votes and the final mask of each class.

    Masks are NULL where the pair lacks the bands for that modality. One shuffle by pixel joins the
    two images. The radar minimum, which decides linear or dB, is aggregated first and is one row
    per pair.
    """
    values = _radar_values(radar, pairs)
    lows = values.groupBy("pair_id").agg(F.min("value").alias("__min"))
    has = {r: F.array_contains("roles_optical", r) for r in ("green", "red", "nir", "swir1")}
    flags = pairs.select(
        "pair_id", "units", "a", "e", "f", ix.radar_band(F.col("roles_radar")).alias("__band"),
        *[has[r].alias(f"__has_{r}") for r in has]).join(lows, "pair_id", "left")
    joined = optical.join(values, list(KEY)).join(flags, "pair_id")

    present = F.lit(True)
    for r in has:
        value = F.col(r) if r in optical.columns else F.lit(None).cast("double")
        joined = joined.withColumn(f"__{r}", F.when(F.col(f"__has_{r}"), value))
        present = present & (~F.col(f"__has_{r}") | F.col(f"__{r}").isNotNull())
    green, red, nir, swir1 = (F.col(f"__{r}") for r in has)
    db = F.when(holds(F.col("__min") >= 0), ix.db_from_linear(F.col("value"))).otherwise(F.col("value"))
    with_water = F.col("__has_green") & (F.col("__has_swir1") | F.col("__has_nir"))
    with_built = F.col("__has_nir") & (F.col("__has_swir1") | F.col("__has_red"))
    optical_water = holds(ix.water_index(F.col("__has_swir1"), green, nir, swir1) > params.optical_water_threshold)
    optical_built = F.when(F.col("__has_swir1"), holds(ix.ndbi(swir1, nir) > params.optical_builtup_threshold)
                           ).otherwise(holds(ix.ndvi(nir, red) < params.ndvi_max_builtup))
    radar_used = F.col("__band").isNotNull()
    voted = joined.withColumn("__db", db).where(present & (~radar_used | F.col("__db").isNotNull())).select(
        *KEY, pixel_area(F.col("units"), F.col("a"), F.col("e"), F.col("f"), F.col("row")).alias("area_m2"),
        F.when(with_water, optical_water).alias("water_optical"),
        F.when(radar_used, F.col("__db") < params.sar_water_db).alias("water_sar"),
        F.when(with_built, optical_built & ~(with_water & optical_water)).alias("__built_optical"),
        F.when(radar_used, F.col("__db") > params.sar_builtup_db).alias("__built_sar"))
    voted = voted.withColumn("water", ix.fuse(F.col("water_optical"), F.col("water_sar"), params.fusion))
    free = F.coalesce(~F.col("water"), F.lit(True))
    voted = (voted.withColumn("built_up_optical", F.col("__built_optical") & free)
             .withColumn("built_up_sar", F.col("__built_sar") & free).drop("__built_optical", "__built_sar"))
    return voted.withColumn("built_up", ix.fuse(F.col("built_up_optical"), F.col("built_up_sar"), params.fusion))


def map_water_builtup(optical: DataFrame, radar: DataFrame, pairs: DataFrame,
                      params: FusionParams = FusionParams(), classes: Sequence[str] = CLASSES) -> DataFrame:
    """Statistics per pair and class: shares, areas, votes and agreement. One pass over the fused pixels."""
    pixels = fused_pixels(optical, radar, pairs, params)
    sums = ["count(1) valid_pixels", "sum(area_m2) __valid_m2"]
    parts = ("has_optical", "has_sar", "final", "m2", "optical", "sar", "both", "optical_only", "sar_only")
    for c in classes:
        o, s = f"{c}_optical", f"{c}_sar"
        for name, total in zip(parts, (
                f"count({o})", f"count({s})", f"count_if({c})",
                f"sum(case when {c} then area_m2 when area_m2 is not null then 0D end)",
                f"count_if({o})", f"count_if({s})", f"count_if({o} and {s})",
                f"count_if({o} and not {s})", f"count_if({s} and not {o})")):
            sums.append(f"{total} __{c}_{name}")
    structs = ", ".join(f"named_struct('class', '{c}', " + ", ".join(f"'{p}', __{c}_{p}" for p in parts) + ")"
                        for c in classes)
    totals = pixels.groupBy("pair_id").agg(*[F.expr(t) for t in sums])
    long = totals.selectExpr("pair_id", "valid_pixels", "__valid_m2", f"inline(array({structs}))")
    either = "(both + optical_only + sar_only)"
    return long.withColumns({
        "optical_used": F.expr("has_optical > 0"), "sar_used": F.expr("has_sar > 0")}).selectExpr(
        "pair_id", "class", "valid_pixels", f"{rounded('__valid_m2 / 1e6D', 4)} valid_area_km2",
        f"if(optical_used or sar_used, {percent_text('final', 'valid_pixels')}, null) percent",
        "if(optical_used or sar_used, final, null) pixels",
        f"if(optical_used or sar_used, {rounded('m2 / 1e6D', 4)}, null) area_km2",
        *[f"if(optical_used and sar_used, {percent_text(c, 'valid_pixels')}, null) {c}_percent"
          for c in ("both", "optical_only", "sar_only")],
        f"if(optical_used, {percent_text('optical', 'valid_pixels')}, null) optical_percent",
        f"if(sar_used, {percent_text('sar', 'valid_pixels')}, null) sar_percent",
        f"if(optical_used and sar_used, coalesce({rounded(f'try_divide(both, {either})', 4)}, 1D), null) agreement")


def fusion_methods(pairs: DataFrame, params: FusionParams = FusionParams()) -> DataFrame:
    """Per pair: which rule each modality used, and warnings about missing bands. From the catalogue alone."""
    roles = F.col("roles_optical")
    has = {r: F.array_contains(roles, r) for r in ("green", "red", "nir", "swir1")}
    water = (F.when(has["green"] & has["swir1"], "MNDWI (green, SWIR1)")
             .when(has["green"] & has["nir"], "NDWI (green, NIR)"))
    built = (F.when(has["swir1"] & has["nir"], "NDBI (SWIR1, NIR)")
             .when(has["nir"] & has["red"], f"low NDVI (< {params.ndvi_max_builtup:g}) proxy, no SWIR band"))
    band = ix.radar_band(F.col("roles_radar"))
    warnings = F.array_compact(F.array(
        F.when(water.isNull(), "Optical image has no green+NIR/SWIR bands; water is detected by SAR only."),
        F.when(built.isNull(), "Optical image has no NIR/red bands; built-up is detected by SAR only.")
        .when(~has["swir1"], "Optical image has no SWIR band, so optical built-up uses a low-NDVI proxy, which also "
              "flags bare soil; SAR agreement matters more here."),
        F.when(band.isNull(), "SAR image has no recognised polarisation band; SAR is not used.")))
    return pairs.select("pair_id", water.alias("optical_water"), built.alias("optical_built_up"),
                        band.alias("sar_band"), warnings.alias("warnings"))


def mean_agreement(stats: DataFrame) -> DataFrame:
    """Confidence of a pair: agreement averaged over the classes that have one."""
    return stats.groupBy("pair_id").agg(F.expr(steady_mean("agreement", 4)).alias("__mean")).select(
        "pair_id", round_binary("__mean", 4).alias("confidence"))


def unusable_reasons(sar_driver, optical_driver, sar_calibrated, optical_water, optical_built_up):
    """Array of reason codes why a pair cannot give meaningful numbers (empty when it can)."""
    photo = ("PNG", "JPEG", "WEBP")
    return F.array_compact(F.array(
        F.when(sar_driver.isin(*photo), "sar_is_photo").when(~sar_calibrated, "sar_not_calibrated"),
        F.when(optical_driver.isin(*photo) & optical_water.isNull() & optical_built_up.isNull(), "optical_is_photo")))
