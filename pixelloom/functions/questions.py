"""Question wording: task rules, question types, objects asked about, classes and fields mentioned.

All rules are regular expressions on the JVM. Builders return SQL text or columns over a text column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelloom.functions.semantics import case_literal, stripped

TASKS = ("metadata", "caption", "vqa", "water_builtup", "change")

# Which modes a task runs on, reroutes, rule patterns in priority order, typo vocabulary,
# confidences, class and field patterns. They must equal the established ones for equal results.
TASK_MODES = {
    "metadata": ("single", "optical_sar", "bi_temporal"),
    "caption": ("single",),
    "vqa": ("single",),
    "water_builtup": ("optical_sar",),
    "change": ("bi_temporal",),
}
REROUTES = {("water_builtup", "single"): "vqa", ("water_builtup", "bi_temporal"): "change"}
RULES = {
    "change": (
        r"\bchang\w*", r"\b(increas|decreas)\w*", r"\b(grew|grow\w*|shr[iau]nk\w*|expan\w*)",
        r"\b(loss|lost|gain\w*)\b", r"\b(before|after)\b", r"\bcompar\w*", r"\bdifferen\w*",
        r"\bunchanged\b", r"\bremain\w* (the )?same\b", r"\bbetween (the )?(two )?(dates|images)\b"),
    "metadata": (
        r"\bhow many bands\b", r"\bband count\b", r"\bnumber of bands\b", r"\bwhich bands\b",
        r"\bcrs\b", r"\bprojection\b", r"\bepsg\b", r"\bcoordinate (reference )?system\b",
        r"\bresolution\b", r"\bpixel size\b", r"\bgsd\b", r"\bdimensions?\b",
        r"\b(extent|bounds|bounding box|footprint)\b", r"\bdata ?type\b", r"\bdtype\b",
        r"\bmetadata\b", r"\bacquisition date\b", r"\bwhich (sensor|satellite)\b"),
    "water_builtup": (
        r"\bwater\w*", r"\bflood\w*", r"\b(river|lake|reservoir|pond|tank)s?\b", r"\binundat\w*",
        r"\bbuilt[- ]?up\b", r"\burban\w*", r"\bbuildings?\b", r"\bsettlements?\b",
        r"\bimpervious\b", r"\bconcrete\b", r"\bcity\b"),
    "caption": (
        r"\bdescri(be|ption)\b", r"\bcaption\w*", r"\bsummar(y|i[sz]e)\b", r"\boverview\b",
        r"\bwhat (is|does) (this|the) (image|scene|picture) (show|contain)\w*",
        r"\bwhat('s| is) in (this|the) (image|scene|picture)\b"),
    "vqa": (r"^(is|are|does|do|can|how|what|which|where|why|who|when)\b", r"\?\s*$"),
}
VOCABULARY = {
    "change": ("change", "changed", "changes", "increase", "decrease", "compare", "difference",
               "growth", "expansion", "unchanged"),
    "metadata": ("bands", "projection", "resolution", "metadata", "crs", "epsg", "dimensions", "extent"),
    "water_builtup": ("water", "flood", "flooded", "river", "lake", "reservoir", "urban",
                      "buildings", "settlement", "builtup"),
    "caption": ("describe", "description", "caption", "summary", "summarize", "overview"),
}
FUZZY_CUTOFF = 0.8
RULE_CONFIDENCE, CONFLICT_CONFIDENCE, GENERIC_CONFIDENCE, FUZZY_CONFIDENCE = 0.95, 0.8, 0.6, 0.6
CLASS_PATTERNS = {
    "water": r"\b(water\w*|flood\w*|rivers?|lakes?|reservoirs?|ponds?|inundat\w*)",
    "built_up": r"\b(built[- ]?up|urban\w*|buildings?|settlements?|impervious|concrete|city)\b",
    "vegetation": r"\b(vegetat\w*|green\w*|forests?|trees?|crops?|farm\w*|agricultur\w*)",
}
FIELD_PATTERNS = {
    "bands": r"\bbands?\b",
    "dtype": r"\b(data ?type|dtype|bit depth|bits?)\b",
    "crs": r"\b(crs|projection|epsg|coordinate)",
    "resolution": r"\b(resolution|pixel size|gsd)\b",
    "size": r"\b(dimensions?|size|width|height|how many pixels)\b",
    "bounds": r"\b(extent|bounds|bounding box|footprint|where)\b",
    "date": r"\b(date|when)\b",
    "sensor": r"\b(sensor|satellite)\b",
}
TYPE_PATTERNS = {
    "rural_urban": r"\brural\b.*\burban\b|\burban\b.*\brural\b",
    "comp": r"\b(more|less|fewer|greater|smaller|larger)\b.*\bthan\b|\bequal to\b|\bas many\b|\bsame (number|amount)\b",
    "count": r"\b(how many|number of|amount of|count)\b",
    "presence": r"^\s*(is|are) there\b|\b(is|are)\b.+\bpresent\b|^\s*(does|do) .+\b(contain|have)\b",
}
OBJECT_PATTERNS = (
    r"^\s*(?:is|are) there\s+(?:(?:a|an|any|some)\s+)?(.+?)\s*(?:in the image)?\s*\??\s*$",
    r"^\s*(?:is|are)\s+(?:(?:a|an|any|some|the)\s+)?(.+?)\s+present\b.*$",
    r"^\s*(?:does|do) (?:the|this) (?:image|area|scene) (?:contain|have)\s+(?:(?:a|an|any|some)\s+)?(.+?)\s*\??\s*$",
)

# (?U): \w and \b take letters of every script, so 'café' is one word.
_FLAGS = "(?iU)"


def _any(text: Column, patterns) -> Column:
    return text.rlike(_FLAGS + "|".join(f"(?:{p})" for p in patterns))


def task_hits(text: Column) -> Column:
    """Tasks whose rules match, in priority order."""
    return F.array_compact(F.array(*[F.when(_any(stripped(text), p), F.lit(t)) for t, p in RULES.items()]))


def matched_terms(text: Column, task: Column) -> Column:
    """The matched words of each pattern of the chosen task."""
    expr = None
    for name, patterns in RULES.items():
        words = F.array_compact(F.array(*[
            F.when(stripped(text).rlike(_FLAGS + p), F.regexp_extract(stripped(text), _FLAGS + p, 0)) for p in patterns]))
        expr = F.when(task == name, words) if expr is None else expr.when(task == name, words)
    return expr


def intent(text: Column) -> Column:
    low = F.lower(text)

    def has(*words):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(low, F.lit(w))
        return found

    return (F.when(has("vegetation", "green", "crop"), "vegetation").when(has("flood"), "flood")
            .when(has("water", "lake", "river"), "water").otherwise("unknown"))


def classes_in(text: Column, allowed) -> Column:
    """Classes a question mentions; all allowed ones when it mentions none."""
    found = F.array_compact(F.array(*[
        F.when(text.rlike(_FLAGS + p), F.lit(c)) for c, p in CLASS_PATTERNS.items() if c in allowed]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(c) for c in allowed]))


def fields_in(text: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(text.rlike(_FLAGS + p), F.lit(f)) for f, p in FIELD_PATTERNS.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(f) for f in FIELD_PATTERNS]))


def question_type(text: Column) -> Column:
    expr = None
    for name, pattern in TYPE_PATTERNS.items():
        hit = text.rlike(_FLAGS + pattern)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("other")


def presence_object(text: Column) -> Column:
    """The thing a presence question asks about; NULL when no wording fits. The first wording that fits decides."""
    expr = None
    for pattern in OBJECT_PATTERNS:
        hit, raw = text.rlike(_FLAGS + pattern), F.regexp_extract(text, _FLAGS + pattern, 1)
        tidy = F.nullif(F.btrim(F.regexp_replace(raw, r"(?U)\s+", " "), F.lit(" ?.")), F.lit(""))
        expr = F.when(hit, tidy) if expr is None else expr.when(hit, tidy)
    return expr


def count_bin(answer: str) -> str:
    """SQL text: bin of a whole-number answer; NULL for other text. Numbers beyond BIGINT still get a bin."""
    whole = rf"{answer} rlike '^\\s*[+-]?[0-9]+\\s*$'"
    value = f"try_cast(trim({answer}) as bigint)"
    return (f"(case when {answer} is null or not ({whole}) then null when {value} is null then if({answer} like '%-%', '0', '>1000') "
            f"when {value} <= 0 then '0' when {value} <= 10 then '1-10' when {value} <= 100 then '11-100' "
            f"when {value} <= 1000 then '101-1000' else '>1000' end)")


def route_table() -> dict[str, tuple[str | None, str | None]]:
    """(task, mode) -> (task to run, task it was rerouted from), for every combination that can run."""
    table = {f"{t}|{m}": t for t, modes in TASK_MODES.items() for m in modes}
    return table | {f"{t}|{m}": to for (t, m), to in REROUTES.items()}


def routed(task: Column, mode: Column) -> Column:
    """Task that will run; NULL when none fits the mode."""
    return case_literal(F.concat_ws("|", task, mode), route_table())


def rerouted_from(task: Column, mode: Column) -> Column:
    return F.when(F.concat_ws("|", task, mode).isin(*[f"{t}|{m}" for t, m in REROUTES]), task)
