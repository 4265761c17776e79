"""Mixing sources to target weights with hash-threshold histograms.

Documents are ordered by a hash of their id, which nothing sorts: token sums per source and hash bucket
give, for a budget, the bucket in which it runs out; only the rows of that bucket are summed again by the
next bits. What lies below the final threshold is taken. Thresholds of larger budgets include those of
smaller ones, so mixes are nested.

Defined cases: NULL text has size 0; NULL source is a source of its own and ranks last; a source of size 0
has target 0. Rows of equal id share their fate. An empty table gives an empty mix. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.store import positions, small, written
from pixelloom.llm.text import digest_bits, fresh, words

BITS, STEP = 60, 12
SEED = "mix"
#: Weights in the order of the sources, share of all sizes, copies at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) with ``target``: ``share`` of all sizes by weight, capped at ``most`` times the size.

    What is over a cap is dealt again by weight until no source is above. Each round is one sum over the
    sources; a round fixes at least one source at its cap or is the last.
    """
    rank, = fresh(sources, "__rank")
    ranked = positions(sources, [F.col("source").asc_nulls_last()], rank)
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col(rank) % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", choice), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = (F.col("source_size") * most <= F.lit(level) * F.col("weight")) if capped >= 0 else F.lit(False)
        row = ranked.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("size"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.sum(F.when(full, 1).otherwise(0)).alias("n")).first()
        if not row["weight"] or row["n"] == capped:
            break
        level, capped = (share * total - most * (row["size"] or 0)) / row["weight"], row["n"]
    target = F.least(F.col("source_size") * F.lit(float(most)), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, rung, budget) with ``cut``: rows of the source with a hash below it add up to the budget.

    ``sizes`` has (source, size, h). The sum is within the budget, or over it by less than it would fall
    short without the last row. A source may have several rungs. Every step sums the rows of the boundary buckets only.
    """
    state = written(budgets.select(
        "source", "rung", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("used"),
        F.lit(None).cast("long").alias("cut")), "mix-state")
    rest, open_rows = BITS, sizes
    while rest and state.where("cut is null").limit(1).count():
        rest -= STEP
        asked = state.where("cut is null")
        near = open_rows.join(
            small(asked.select(F.col("source").alias("s"), "rung", "prefix")),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", rest + STEP) == F.col("prefix"))).drop("s")
        sums = near.groupBy("source", "rung", F.shiftright("h", rest).alias("bucket")).agg(
            F.sum("size").cast("double").alias("sum"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("source", "rung").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = sums.withColumn("upto", F.sum("sum").over(upto))  # at most 2^STEP rows a source and rung
        joined = asked.alias("a").join(
            running.alias("r"), F.expr("a.source <=> r.source and a.rung = r.rung"), "left").where(
            "r.bucket is null or a.used + r.upto > a.budget")
        first = joined.groupBy("a.source", "a.rung").agg(
            F.first("budget").alias("budget"), F.first("used").alias("used"), F.min(F.struct("bucket", "sum", "n", "upto")).alias("b"))
        # no row from the join: the budget covers the whole boundary bucket, which only happens at the top
        moved = first.select("source", "rung", "budget", "b.bucket", (F.col("used") + F.col("b.upto") - F.col("b.sum")).alias("used"),
                             F.col("b.sum").alias("sum"), F.col("b.n").alias("n"))
        short, over = F.col("budget") - F.col("used"), F.col("used") + F.col("sum") - F.col("budget")
        closed = (F.col("n") == 1) | F.lit(rest == 0)
        cut = F.when(closed, F.shiftleft(F.col("bucket") + F.when(over < short, 1).otherwise(0), rest))
        moved = moved.select("source", "rung", F.col("bucket").alias("prefix"), "used", cut.alias("cut"))
        kept = asked.select("source", "rung", "budget").alias("k").join(
            moved.alias("m"), F.expr("k.source <=> m.source and k.rung = m.rung"), "left")
        state = written(state.where("cut is not null").unionByName(kept.select(
            "k.source", "k.rung", "k.budget", F.coalesce("m.prefix", F.lit(0)).cast("long").alias("prefix"),
            F.coalesce("m.used", F.lit(0.0)).alias("used"),
            F.when(F.col("m.rung").isNull(), F.lit(1 << BITS)).otherwise(F.col("m.cut")).cast("long").alias("cut"))), "mix-state")
    return state.select("source", "rung", "budget", F.coalesce("cut", F.lit(0)).alias("cut"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target of its source, copies and ``taken`` (size times copies).

    ``size`` is the number of words unless given. Texts are read once; all else works on narrow rows.
    """
    counted = F.size(words(F.col(text_col))).cast("long") if size is None else size
    rows = written(docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("source"), counted.alias("size"),
                               digest_bits(F.col(id_col), seed=SEED).alias("h")), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(targets(sources, weights, share, most), "mix-targets")
    whole = F.coalesce(F.floor(F.expr("target / nullif(source_size, 0)")), F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole)
    cuts = thresholds(rows, plan.select("source", F.lit(0).alias("rung"), (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    full = plan.alias("p").join(cuts.alias("c"), F.expr("p.source <=> c.source")).select(
        F.col("p.source").alias("s"), "source_size", "target", "whole", "cut")
    extra = F.when((F.col("h") < F.col("cut")) & (F.col("whole") < most), 1).otherwise(0)
    out = rows.join(small(written(full, "mix-plan"), 100_000), F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", (F.col("whole") + extra).alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, with the columns of ``docs``. Rows of one id share their fate within a source."""
    copies, known, origin, turn = fresh(docs, "__copies", "__known", "__origin", "__turn")
    chosen = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    chosen = chosen.groupBy(F.col(id_col).alias(known), F.col("source").alias(origin)).agg(F.max("copies").alias(copies))
    chosen = written(chosen.where(F.col(copies) > 0), "mix-chosen")
    same = docs[id_col].eqNullSafe(chosen[known]) & docs[source_col].eqNullSafe(chosen[origin])
    return (docs.join(small(chosen), same).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies, known, origin, turn))
