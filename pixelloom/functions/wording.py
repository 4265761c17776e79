"""Everyday wording of numbers: confidence levels, areas, dates, jargon scan. SQL text over named columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.semantics import fixed_text, rounded, whole_percent_text

# Cut-offs, words that plain text must not contain, and wording of warnings.
HIGH_FROM, MEDIUM_FROM = 0.75, 0.4
BANNED_TERMS = (
    "dB", "P(urban)", "pp", "percentage point", "VV", "VH", "HH", "HV", "NDWI", "MNDWI", "NDBI", "NDVI",
    "SWIR", "SWIR1", "SWIR2", "NIR", "sigma0", "backscatter", "softmax", "EPSG", "CRS", "p90", "dtype",
    "rs_vqa", "rs_caption", "optical_sar_mapper", "landcover_change", "image_metadata", "trained_head",
    "zero_shot", "RemoteCLIP", "resnet18", "BigEarthNet", "RSVQA", "threshold", "modality", "modalities")
FUSION_CAVEATS = {
    "do not look like calibrated": "The radar image may not be properly calibrated, so its results may be off.",
    "low-NDVI proxy": "The normal image is missing one infrared layer, so bare soil may be counted as buildings. "
                      "The radar image matters more here.",
    "water is detected by SAR only": "The normal image lacks the colours needed for water, so only the radar image was used for water.",
    "built-up is detected by SAR only": "The normal image lacks the colours needed for buildings, so only the radar image was used for buildings.",
    "SAR is not used": "The radar image has no usable radar layer, so only the normal image was used.",
}
CHANGE_CAVEATS = {
    "differ in overall greenness": "The two images differ in how green the land is (for example a dry year versus a wet year). Dry bare "
                                   "fields can look like buildings, so some of this change may be season or rainfall rather than real "
                                   "change. Images from the same season give a fairer comparison.",
    "No SWIR band": "One infrared layer is missing on at least one date, so bare soil may be counted as buildings.",
    "only present on one date": "Some image layers exist on only one of the dates and were not used.",
}
OTHER_CAVEAT = "There is an extra technical note about this result; see 'Technical details'."


def confidence_level(value: str) -> Column:
    return F.expr(f"case when {value} is null then 'Not rated' when {value} >= {HIGH_FROM}D then 'High' "
                  f"when {value} >= {MEDIUM_FROM}D then 'Medium' else 'Low' end")


def chance_text(value: str) -> str:
    """A probability as a whole percentage."""
    return whole_percent_text(value)


def area_text(km2: str) -> str:
    """km² with two decimals, m² below 0.1 km²; NULL stays NULL."""
    return (f"if(abs({km2}) < 0.1D, concat(format_number({rounded(f'({km2}) * 1e6D', 0)}, 0), ' m²'), "
            f"concat({fixed_text(km2, 2)}, ' km²'))")


def date_text(iso: str) -> str:
    """'2021-02-05' as '5 Feb 2021'; other text is kept."""
    return f"coalesce(date_format(try_to_date({iso}, 'yyyy-MM-dd'), 'd MMM yyyy'), {iso})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def caveats(warnings: str, table: dict[str, str]) -> Column:
    """Plain wording of technical warnings: the first needle found decides, equal sentences once."""
    cases = " ".join(f"when contains(w, {_quoted(n)}) then {_quoted(t)}" for n, t in table.items())
    return F.expr(f"array_distinct(transform({warnings}, w -> case {cases} else {_quoted(OTHER_CAVEAT)} end))")


def banned_terms(text: Column) -> Column:
    """Jargon found as whole words; short terms and capitals are matched with their case."""
    found = []
    for term in BANNED_TERMS:
        flags = "" if len(term) <= 4 or term.isupper() else "(?i)"
        found.append(F.when(text.rlike(rf"{flags}(?<![A-Za-z0-9_]){re.escape(term)}(?![A-Za-z0-9_])"), F.lit(term)))
    return F.array_compact(F.array(*found))
