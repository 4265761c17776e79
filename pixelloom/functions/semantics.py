"""Value rules every operator shares: nulls, safe division, rounding, dates.

A missing pixel value is NULL. NaN and infinities become NULL where data enters, because Spark
sorts NaN as the largest value and treats NaN = NaN as true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The value as DOUBLE, with NaN and +/-infinity turned into NULL."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero denominator (a plain ``/`` throws in ANSI mode)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def holds(predicate: Column) -> Column:
    """A comparison with a missing value is false, never NULL."""
    return F.coalesce(predicate, F.lit(False))


def all_present(*values: Column) -> Column:
    """True when every value is there."""
    present = F.lit(True)
    for value in values:
        present = present & value.isNotNull()
    return present


def rounded(value: str, digits: int = 0) -> str:
    """SQL text: round half to even on the exact binary value of a double.

    Spark's ``round`` and ``bround`` look at the shortest decimal text of the double, so 2.675
    (in fact 2.67499999999999982...) goes to 2.68. Here the product ``value * 10^digits`` is
    split into its rounded value and its exact error, and the error settles the ties. The nested
    ``transform`` calls give names to the steps, so the text stays short however often it is nested.
    Good for magnitudes below 2^52 / 10^digits. Meant for results, not for every pixel.
    """
    scale = f"{10**digits}D"
    steps = (f"transform(array(cast(({value}) as double)), v -> named_struct('v', v, 'p', abs(v) * {scale}, "
             "'h', abs(v) * 134217729D - (abs(v) * 134217729D - abs(v))))")
    parts = (f"transform({steps}, s -> named_struct('v', s.v, 'w', cast(floor(s.p) as double), "
             f"'o', s.p - floor(s.p) - 0.5D, 'e', (s.h * {scale} - s.p) + (abs(s.v) - s.h) * {scale}))")
    up = "s.o > 0 or (s.o = 0 and (s.e > 0 or (s.e = 0 and s.w % 2 = 1)))"
    return f"transform({parts}, s -> if(s.v < 0, -1D, 1D) * (if({up}, s.w + 1D, s.w) / {scale}) + 0D)[0]"


def round_binary(value: str, digits: int = 0) -> Column:
    """:func:`rounded` as a column; ``value`` is SQL text over the columns at hand."""
    return F.expr(rounded(value, digits))


def steady_mean(value: str, digits: int | None = None) -> str:
    """SQL text: the mean of a group that comes out the same in whatever order its rows arrive.

    Values already rounded to ``digits`` are added as whole numbers of that size and divided once; others
    are added as decimals of 18 places, good for magnitudes below 10^11.
    """
    if digits is None:
        return f"cast(sum(cast(({value}) as decimal(29,18))) as double) / count({value})"
    return f"sum(cast(round(({value}) * {10**digits}D) as bigint)) / cast(count({value}) * {10**digits} as double)"


def percent_text(part: str, total: str, digits: int = 2) -> str:
    return rounded(f"try_divide(100D * ({part}), {total})", digits)


def percent(part: str, total: str, digits: int = 2) -> Column:
    """``100 * part / total`` rounded; NULL when the total is zero."""
    return F.expr(percent_text(part, total, digits))


def share_percent(part: str, total: str, digits: int = 2) -> Column:
    """``(part / total) * 100`` rounded: areas are divided first, counts are multiplied first."""
    return round_binary(f"try_divide({part}, {total}) * 100D", digits)


def stripped_text(text: str) -> str:
    """SQL text: ``text`` without white space of any kind at both ends."""
    return f"regexp_replace({text}, '(?U)^[\\\\s\\\\x1c-\\\\x1f]+|[\\\\s\\\\x1c-\\\\x1f]+$', '')"


def stripped(text: Column) -> Column:
    """``text`` without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` text as a date, NULL otherwise. A bare cast would accept '2021' and '2021-2-5'."""
    trimmed = stripped(text)
    return F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(trimmed, "yyyy-MM-dd"))


def general_text(value: str, sign: bool = False) -> str:
    """SQL text: six significant digits without trailing zeros: 25.0 -> '25', 0.0024 -> '0.0024', 1234567 -> '1.23457e+06'."""
    plus = "+" if sign else ""
    bounds = ("1e5", "1e4", "1e3", "1e2", "1e1", "1e0", "1e-1", "1e-2", "1e-3", "0")
    cases = " ".join(f"when abs(v) >= {b}D then format_string('%{plus}.{d}f', v)" for d, b in enumerate(bounds))
    plain = f"transform(array(case {cases} end), t -> if(contains(t, '.'), rtrim('.', rtrim('0', t)), t))[0]"
    large = f"regexp_replace(format_string('%{plus}.5e', v), '[.]?0+e', 'e')"
    return (f"transform(array(cast(({value}) as double)), v -> if(abs(v) >= 1e6D or (v <> 0 and abs(v) < 1e-4D), "
            f"{large}, {plain}))[0]")


def fixed_text(value: str, digits: int, sign: bool = False) -> str:
    """SQL text: a fixed number of decimals, from the value already rounded half to even."""
    text = f"format_string('%{'+' if sign else ''}.{digits}f', {rounded(value, digits)})"
    return f"if(({value}) is null, null, {text})"


def whole_percent_text(value: str) -> str:
    """SQL text: a share of one as a whole percentage, '67%'."""
    return f"concat({fixed_text(f'({value}) * 100D', 0)}, '%')"


def case_literal(key: Column, pairs: dict, default: Column | None = None) -> Column:
    """A fixed lookup table as one CASE expression."""
    expr = None
    for name, value in pairs.items():
        test = key == F.lit(name)
        expr = F.when(test, F.lit(value)) if expr is None else expr.when(test, F.lit(value))
    return expr if default is None else expr.otherwise(default)


def non_null(items: list[Column]) -> Column:
    """Array of the items that are not NULL, in order."""
    return F.array_compact(F.array(*items))
