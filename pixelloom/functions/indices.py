"""Spectral indices, radar scaling and the small decisions made on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.semantics import case_literal, holds, ratio, round_binary

# Roles, class names and codes, map codes.
OPTICAL_ROLES = ("blue", "green", "red", "nir", "swir1", "swir2")
RADAR_ROLES = ("vv", "vh", "hh", "hv")
RADAR_CHOICE = ("vv", "hh", "vh", "hv")
CLASSES = ("water", "built_up", "vegetation", "other")
CLASS_CODES = {"water": 0, "built_up": 1, "vegetation": 2, "other": 3}
CLASS_LABELS = {"water": "Water", "built_up": "Built-up", "vegetation": "Vegetation", "other": "Other"}
NODATA_CODE = 255
COVER_MAP_CLASSES = {10: "Trees", 20: "Shrubland", 30: "Grassland", 40: "Cropland",
                     50: "Built-up", 60: "Bare", 80: "Water"}
COVER_MAP_TO_CLASS = {80: "water", 50: "built_up", 10: "vegetation", 20: "vegetation", 30: "vegetation",
                      40: "vegetation", 90: "vegetation", 95: "vegetation", 100: "vegetation", 60: "other"}
SEASON_ZERO_GAP = 0.15
SEASON_WARNING_GAP = 0.05
SEASON_SENSITIVE = ("built_up", "vegetation", "other")


def normalized_difference(a: Column, b: Column) -> Column:
    return ratio(a.cast("double") - b.cast("double"), a.cast("double") + b.cast("double"))


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def mndwi(green: Column, swir1: Column) -> Column:
    return normalized_difference(green, swir1)


def ndbi(swir1: Column, nir: Column) -> Column:
    return normalized_difference(swir1, nir)


def water_index(has_swir: Column, green: Column, nir: Column, swir1: Column) -> Column:
    """MNDWI where the image has SWIR, NDWI where it has not. Decided per image, not per pixel."""
    return F.when(has_swir, mndwi(green, swir1)).otherwise(ndwi(green, nir))


def db_from_linear(power: Column) -> Column:
    """Linear power to dB; zero (border nodata) and missing stay NULL."""
    return F.when(power > 0, F.lit(10.0) * F.log10(power.cast("double")))


def db_for_display(power: Column) -> Column:
    """Display variant: values are floored at 1e-6 in place of being dropped."""
    return F.when(power.isNotNull(), F.lit(10.0) * F.log10(F.greatest(power.cast("double"), F.lit(1e-6))))


def looks_calibrated(median_db: Column) -> Column:
    return holds(median_db.between(-40.0, 10.0))


def radar_band(roles: Column) -> Column:
    """The polarisation to use: first of vv, hh, vh, hv that the image has."""
    return F.coalesce(*[F.when(F.array_contains(roles, p), F.lit(p)) for p in RADAR_CHOICE])


def radar_value(choice: Column, pixel: dict[str, Column]) -> Column:
    """The chosen polarisation's value. A per-pixel coalesce would mix polarisations."""
    expr = None
    for name, value in pixel.items():
        expr = F.when(choice == name, value) if expr is None else expr.when(choice == name, value)
    return expr


def fuse(optical: Column, radar: Column, rule: str) -> Column:
    """Combine two votes; a missing (NULL) side leaves the decision to the other one."""
    both = (optical & radar) if rule == "and" else (optical | radar)
    return F.when(optical.isNull(), radar).when(radar.isNull(), optical).otherwise(both)


def direction(delta: Column, tolerance: float) -> Column:
    return (F.when(F.abs(delta) < tolerance, "unchanged")
            .when(delta > 0, "increased").otherwise("decreased"))


def season_factor(gap: str) -> Column:
    return round_binary(f"greatest(0D, 1D - {gap} / {SEASON_ZERO_GAP}D)", 4)


def recode_cover_map(code: Column) -> Column:
    """Reference-map code to class name; other codes are nodata (NULL)."""
    return case_literal(code, COVER_MAP_TO_CLASS)


def reflectance_scale(p99: Column) -> Column:
    """Input scale from the 99th percentile of an image."""
    return (F.when((p99 > 0) & (p99 <= 2.0), "reflectance 0-1")
            .when((p99 >= 100) & (p99 <= 12000), "reflectance x10000")
            .otherwise("unknown"))


def reflectance_factor(scale: Column) -> Column:
    return F.when(scale == "reflectance 0-1", F.lit(10000.0)).otherwise(F.lit(1.0))


def inverse_tone_map(value: Column) -> Column:
    """8-bit tone-mapped value to approximate reflectance x 10000 (gamma with a soft knee)."""
    # Scale, white point, knee and gamma of the published tone map.
    scale, white, knee, gamma = 3500.0, 12000.0, 0.6, 2.2
    reach = (white / scale - knee) / (1 - knee)
    a = 1 / reach**2
    x = F.pow(value.cast("double") / 255.0, F.lit(gamma))
    s = F.greatest((x - knee) / (1 - knee), F.lit(0.0))
    lifted = (-(F.lit(1.0) - s) + F.sqrt((F.lit(1.0) - s) * (F.lit(1.0) - s) + s * (4 * a))) / (2 * a)
    return F.when(x <= knee, x).when(x > knee, F.lit(knee) + lifted * (1 - knee)) * scale


def area_display(area_m2: str, total_m2: str) -> tuple[Column, Column, Column]:
    """(area, unit, total) in km2 above 10,000 ha in total, in ha otherwise."""
    large = f"{total_m2} / 10000D > 10000D"
    per = f"if({large}, 1e6D, 1e4D)"
    return (round_binary(f"{area_m2} / {per}", 2), F.expr(f"if({large}, 'km²', 'ha')"),
            round_binary(f"{total_m2} / {per}", 2))


def normalised_channel(band: str, mean: float, std: float) -> Column:
    """A band as a model takes it: centred and scaled in single precision, a missing value 0."""
    return F.coalesce(F.nanvl((F.col(band).cast("double") - F.lit(mean)) / F.lit(std), F.lit(0.0)), F.lit(0.0)).cast("float")
