"""Fetch planning: which product for which slot and period, on which grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.geodesy import box_problems, export_grid

# Product per slot and which date range it takes, by mode.
PRODUCTS = {"single": (("s2", 0),), "optical_sar": (("s2", 0), ("s1", 0)), "bi_temporal": (("s2", 0), ("s2", 1))}


def check_requests(requests: DataFrame, today: str) -> DataFrame:
    """Adds ``problems`` to ``(request_id, mode, box, ranges ARRAY<STRUCT<start, end>>)`` with text dates."""
    parsed = ("transform(ranges, r -> named_struct("
              "'s', if(r.start rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$', try_to_date(r.start, 'yyyy-MM-dd'), null), "
              "'e', if(r.end rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$', try_to_date(r.end, 'yyyy-MM-dd'), null)))")
    modes = ", ".join(f"'{m}'" for m in PRODUCTS)
    needed = "case mode when 'bi_temporal' then 2 else 1 end"
    df = requests.withColumn("periods", F.expr(parsed))
    return df.withColumn("problems", F.concat(box_problems(F.col("box")), F.expr(
        f"array_compact(array(if(mode not in ({modes}), 'unknown_mode', null), if(coalesce(size(ranges), 0) < {needed}, 'missing_range', null), "
        "if(exists(periods, p -> p.s is null or p.e is null), 'unreadable_date', null), if(exists(periods, p -> p.s >= p.e), 'start_not_before_end', null), "
        f"if(exists(periods, p -> p.s > date'{today}'), 'future_range', null)))")))


def fetch_plan(requests: DataFrame, today: str) -> DataFrame:
    """Rows (request, slot, product, start, end, mid date) with the export grid all slots of a request share."""
    good = export_grid(check_requests(requests, today).where(F.size("problems") == 0))
    steps = "case mode " + " ".join(
        f"when '{m}' then array(" + ", ".join(f"named_struct('slot', {i + 1}, 'product', '{p}', 'r', {r})" for i, (p, r) in enumerate(ps)) + ")"
        for m, ps in PRODUCTS.items()) + " end"
    rows = good.select("request_id", "mode", "periods", "grid", F.expr(f"inline({steps})")).withColumn("p", F.expr("periods[r]"))
    return rows.selectExpr("request_id", "mode", "slot", "product", "p.s start", "p.e end",
                           "date_add(p.s, cast(floor(datediff(p.e, p.s) / 2) as int)) mid_date", "grid")
