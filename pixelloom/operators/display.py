"""Display values: contrast stretch, band choice, overlay colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.indices import RADAR_CHOICE
from pixelloom.operators.ordered import exact_percentiles

# Overlay colours and opacities.
CHANGE_COLOURS = {"water": "#1f6feb", "built_up": "#d73a49", "vegetation": "#2da44e", "other": "#bf8700"}
CHANGE_ALPHA = 170
FUSION_COLOURS = {
    "water": {"both": "#1f6feb", "optical_only": "#79c0ff", "sar_only": "#a371f7"},
    "built_up": {"both": "#d73a49", "optical_only": "#f9a36b", "sar_only": "#e3b341"},
}
FUSION_ALPHA = {"both": 210, "optical_only": 160, "sar_only": 160}


def display_bands(kind: Column, roles: Column) -> Column:
    """Roles to show and how: first polarisation of a radar image, true colour, or band 1 in grey."""
    first = F.coalesce(*[F.when(F.map_contains_key(roles, p), F.lit(p)) for p in RADAR_CHOICE])
    rgb = F.map_contains_key(roles, "red") & F.map_contains_key(roles, "green") & F.map_contains_key(roles, "blue")

    def index(role):
        return F.try_element_at(roles, role)

    radar_index = F.coalesce(index(first), F.lit(1))
    return (F.when(kind == "sar", F.struct(F.array(radar_index).alias("bands"), F.lit("sar_db").alias("rendering")))
            .when(rgb, F.struct(F.array(index(F.lit("red")), index(F.lit("green")), index(F.lit("blue"))).alias("bands"),
                                F.lit("rgb").alias("rendering")))
            .otherwise(F.struct(F.array(F.lit(1)).alias("bands"), F.lit("gray").alias("rendering"))))


def stretch(pixels: DataFrame, bands: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """0..255 values between the 2nd and 98th percentile per image and band, over pixels valid in every band."""
    bands = list(bands)
    valid = " and ".join(f"{b} is not null" for b in bands)
    shown = pixels.where(valid)
    limits = exact_percentiles(shown, ["image_id"], bands, {"lo": low, "hi": high})
    out = []
    for b in bands:
        lo, hi = f"{b}_lo", f"if({b}_hi <= {b}_lo, {b}_lo + 1D, {b}_hi)"
        out.append(f"cast(rint(greatest(0D, least(1D, ({b} - {lo}) / ({hi} - {lo}))) * 255D) as int) {b}")
    return shown.join(limits, "image_id").selectExpr("image_id", "row", "col", *out)


def rgba(hex_colour: str, alpha: int) -> str:
    """SQL text of a colour struct."""
    r, g, b = (int(hex_colour[i:i + 2], 16) for i in (1, 3, 5))
    return f"named_struct('r', {r}, 'g', {g}, 'b', {b}, 'a', {alpha})"


def overlay(pixels: DataFrame, layers: Sequence[tuple[str, str, int]]) -> DataFrame:
    """RGBA per pixel from ``(mask as SQL text, colour, alpha)`` layers; later layers paint over earlier ones."""
    cases = " ".join(f"when {mask} then {rgba(colour, alpha)}" for mask, colour, alpha in reversed(list(layers)))
    return pixels.withColumn("__c", F.expr(f"case {cases} else named_struct('r', 0, 'g', 0, 'b', 0, 'a', 0) end")).select(
        *pixels.columns, "__c.r", "__c.g", "__c.b", "__c.a").drop("__c")


def change_layers(code: str) -> list[tuple[str, str, int]]:
    return [(f"{code} = {i}", colour, CHANGE_ALPHA) for i, colour in enumerate(CHANGE_COLOURS.values())]


def fusion_layers(name: str) -> list[tuple[str, str, int]]:
    """Layers of one class; with a single modality its mask alone is painted."""
    o, s, colours = f"{name}_optical", f"{name}_sar", FUSION_COLOURS[name]
    parts = {"both": f"{o} and {s}", "optical_only": f"{o} and not coalesce({s}, false)",
             "sar_only": f"{s} and not coalesce({o}, false)"}
    return [(mask, colours[k], FUSION_ALPHA[k]) for k, mask in parts.items()]
