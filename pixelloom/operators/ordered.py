"""Running totals and percentiles that stay distributed when one group is most of the data.

A window over a group sorts the whole group in one task. The helpers here cut each group into
ordered buckets first, so a task never sorts more than one bucket, and the totals of the earlier
buckets come from a small table of bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    totals: dict[str, str],
) -> DataFrame:
    """Inclusive running totals within ``keys``, in order of ``bucket`` and then ``order``.

    ``totals`` maps an output column to the input column it adds up. ``bucket`` must not fall as the
    wanted order goes on. Rows with a unique ``order`` inside their bucket get a unique position. With
    no ``keys`` the totals run over everything; only the bucket totals then meet in one task.
    """
    keys = list(keys)
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"__{o}") for o, c in totals.items()])
    offsets = sums.select(*keys, bucket, *[
        F.coalesce(F.sum(f"__{o}").over(earlier), F.lit(0)).alias(f"__{o}_before") for o in totals])
    local = df
    for o, c in totals.items():
        local = local.withColumn(f"__{o}_local", F.sum(c).over(inner))
    joined = local.join(offsets, keys + [bucket])
    out = joined.select(*df.columns, *[
        (F.col(f"__{o}_local") + F.col(f"__{o}_before")).alias(o) for o in totals])
    return out


#: Groups with more rows than MANY keep a count per value instead of a list of their rows. They are found by counts of
#: BUCKETS hashes of the keys, so a few smaller groups may take that way too; the medians are the same.
MANY, BUCKETS = 4_096, 1 << 20


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], many: int = MANY, near: Sequence[str] = ()) -> DataFrame:
    """``median()`` of each value column per key, for many small groups. NULLs are left out.

    ``median()`` has a hash map per group and column, which costs most where a group has a few rows. Here rows are sorted by
    key once, and a window gives the lists of a group's values, so they are not built, written out and merged twice as in a
    partial and a final aggregation; a join on the keys needs no further sort. The window copies the lists to every row of
    the group, of which the first is kept, so only groups of at most ``many`` rows go this way. Larger ones have the maps,
    which hold one entry per distinct value. Groups that agree in ``near``, some of the keys, come to the same partition, so that
    a later join on these (of dates of a pixel, say) has its rows there already.
    """
    keys, values = list(keys), list(values)
    rows = df.select(*keys, *values).withColumn("__bucket", F.expr(f"pmod(xxhash64({', '.join(keys)}), {BUCKETS})"))
    crowded = F.broadcast(rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > many).select("__bucket"))
    place = Window.partitionBy(*keys).orderBy(keys[0])
    group = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    usual = rows.join(crowded, "__bucket", "left_anti").select(*keys, *values)
    lists = (usual.repartition(*near) if near else usual).select(
        *keys, *[F.collect_list(v).over(group).alias(v) for v in values], F.row_number().over(place).alias("__i"))
    lists = lists.where("__i = 1").select(*keys, *[F.sort_array(v).alias(v) for v in values])
    small = lists.select(*keys, *[F.expr(
        f"0.5D * get({v}, cast((size({v}) - 1) div 2 as int)) + 0.5D * get({v}, cast(size({v}) div 2 as int))").alias(v) for v in values])
    large = rows.join(crowded, "__bucket", "left_semi").groupBy(*keys).agg(*[F.median(v).alias(v) for v in values])
    return small.unionByName(large)


def magnitude_bin(value: Column, per_octave: int = 512) -> Column:
    """A BIGINT that never falls as ``value`` rises: sign and logarithm of the magnitude.

    Needs no minimum or maximum of the data, and has relative width 2^(1/per_octave).
    """
    size = F.abs(value)
    steps = F.floor(F.log2(F.greatest(size, F.lit(1e-300))) * per_octave) + F.lit(1000 * per_octave)
    return F.when(value == 0, F.lit(0)).when(value > 0, steps).otherwise(-steps).cast("long")


#: Bins per octave of the first count, and of further ones within the bins that hold a rank. One count leaves some
#: 1 / 20,000 of the values of a group; another entry, such as 1 << 20, costs one more reading and leaves a few.
PERCENTILE_BINS = (1 << 12,)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probabilities: dict[str, float],
    bins: Sequence[int] = PERCENTILE_BINS,
) -> DataFrame:
    """Percentiles with linear interpolation, per key and value column.

    Returns one row per key with the columns ``<value>_<name>`` for each entry of ``probabilities``
    and ``<value>_count``. NULLs are left out. The result equals ``percentile()``, whose state holds
    every distinct value of a group in one task. Here values are first counted per magnitude bin, so that many
    rows a task and group are shuffled as there are bins, whatever the size of the group. Bins that hold a wanted rank may
    be refined in the same way (``bins``), and only the values of the last ones are counted one by one and sorted.
    ``df`` is read once per count.
    """
    keys, values = list(keys), list(values)
    group = keys + ["__name"]
    items = ", ".join(f"named_struct('__name', '{v}', '__value', cast({v} as double))" for v in values)
    long = df.selectExpr(*keys, f"inline(array({items}))").where("__value is not null")
    picked, before = None, []
    for per_octave in bins:
        rows = long.withColumn("__bin", magnitude_bin(F.col("__value"), per_octave))
        if picked is not None:
            rows = rows.withColumn("__wide", magnitude_bin(F.col("__value"), before[-1])).join(picked.withColumnRenamed("__bin", "__wide"), [*group, "__wide"])
        picked = _picked_bins(rows, group, probabilities, picked is None)
        before.append(per_octave)
    narrow = long.withColumn("__bin", magnitude_bin(F.col("__value"), before[-1])).join(picked, [*group, "__bin"])
    counted = narrow.groupBy(*group, "__bin", "__size", "__start", "__value").agg(F.count(F.lit(1)).alias("__n"))
    per_value = _at_ranks(counted, group, probabilities)
    wide = [F.expr(f"max(if(__name = '{v}', {c}, null)) {v}_{n}")
            for v in values for n, c in [*[(n, n) for n in probabilities], ("count", "__size")]]
    return per_value.groupBy(*keys).agg(*wide)


def _low_ranks(probabilities: dict[str, float]) -> dict[str, str]:
    return {n: f"cast(floor({p!r}D * (__size - 1)) as bigint)" for n, p in probabilities.items()}


def _picked_bins(rows: DataFrame, group: list[str], probabilities: dict[str, float], first: bool) -> DataFrame:
    """(group, __bin, __size, __start) of the bins that hold a wanted rank; ``__start`` is how many values come before.

    Rows (group, __value, __bin) are all values, or later those of picked wider bins with the ``__wide``, ``__size`` and ``__start`` of these.
    """
    upper = [] if first else ["__wide", "__size", "__start"]
    bins = rows.groupBy(*group, *upper, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group, *upper[:1])
    upto = whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.sum("__n").over(upto) - F.col("__n")
    bins = bins.withColumns({"__size": F.sum("__n").over(whole), "__start": here} if first else {"__start": F.col("__start") + here})
    wanted = " or ".join(f"(__start <= {r} + 1 and __start + __n > {r})" for r in _low_ranks(probabilities).values())
    return bins.where(wanted).select(*group, "__bin", "__size", "__start")


def counted_percentiles(counted: DataFrame, group: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Percentiles of values that are already counted: (group, __value, __n), one row per value and no NULL value.

    Returns the group, ``__size`` (how many values) and a column per entry of ``probabilities``.
    """
    group = list(group)
    counted = counted.withColumn("__bin", magnitude_bin(F.col("__value")))
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = counted.groupBy(*group, "__bin").agg(F.sum("__n").alias("__n")).withColumns({
        "__size": F.sum("__n").over(whole), "__start": F.sum("__n").over(upto) - F.col("__n")})
    wanted = " or ".join(f"(__start <= {r} + 1 and __start + __n > {r})" for r in _low_ranks(probabilities).values())
    picked_bins = bins.where(wanted).select(*group, "__bin", "__size", "__start")
    return _at_ranks(counted.join(picked_bins, group + ["__bin"]), group, probabilities)


def _at_ranks(counted: DataFrame, group: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Percentiles from the counted values (group, __value, __n) of the bins that hold the ranks, with ``__size`` and ``__start``."""
    inside = Window.partitionBy(*group, "__bin").orderBy("__value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("__to", F.col("__start") + F.sum("__n").over(inside)).withColumn("__from", F.col("__to") - F.col("__n"))
    low = _low_ranks(probabilities)
    picks = []
    for n, r in low.items():
        for side, rank in (("lo", r), ("hi", f"least({r} + 1, __size - 1)")):
            picks.append(F.expr(f"max(if(__from <= {rank} and {rank} < __to, __value, null)) __{side}_{n}"))
    found = placed.groupBy(*group).agg(F.max("__size").alias("__size"), *picks)
    results = [f"__lo_{n} + (__hi_{n} - __lo_{n}) * ({p!r}D * (__size - 1) - floor({p!r}D * (__size - 1))) {n}"
               for n, p in probabilities.items()]
    return found.selectExpr(*group, "__size", *results)
