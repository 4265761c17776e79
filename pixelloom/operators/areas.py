"""Administrative areas: assign, rename, alias, check and resolve."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.shapes import largest_shape_overlap


def _plain(names: pd.Series) -> pd.Series:
    def one(name):
        if name is None:
            return None
        letters = (c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        return " ".join("".join(letters).split())

    return names.map(one)


def plain_name(name: Column) -> Column:
    """Name without diacritics and with single spaces: 'Karnātaka' -> 'Karnataka'. Spark has no Unicode
    decomposition, so this is an Arrow-batched function; use it on distinct names."""
    return F.pandas_udf(_plain, "string")(name)


def largest_overlap(districts: DataFrame, states: DataFrame, cell: float = 0.25) -> DataFrame:
    """State of each district by largest common box area.

    ``districts`` is ``(district_id, box)``, ``states`` is ``(state_id, box)``; a shape may have several
    boxes (rows), so a shape cut into cells gives the overlap of the shapes at that resolution. Boxes
    meet through the cells they touch; a pair is counted in the cell of its lower left common corner.
    Areas are added up per pair before the largest is taken; ties go to the lower state id and are reported.
    """
    def cells(df, name):
        return (df.withColumnRenamed("box", name)
                .withColumn("__x", F.explode(F.expr(f"sequence(floor({name}.w / {cell}), floor({name}.e / {cell}))")))
                .withColumn("__y", F.explode(F.expr(f"sequence(floor({name}.s / {cell}), floor({name}.n / {cell}))"))))

    common = cells(districts, "__d").join(cells(states, "__s"), ["__x", "__y"]).withColumns({
        "__w": F.greatest("__d.w", "__s.w"), "__e": F.least("__d.e", "__s.e"),
        "__b": F.greatest("__d.s", "__s.s"), "__t": F.least("__d.n", "__s.n")}).where(
        f"__w < __e and __b < __t and floor(__w / {cell}) = __x and floor(__b / {cell}) = __y")
    areas = common.groupBy("district_id", "state_id").agg(F.sum(F.expr("(__e - __w) * (__t - __b)")).alias("overlap"))
    return areas.withColumn("__r", F.round("overlap", 9)).groupBy("district_id").agg(
        F.max_by("state_id", F.struct(F.col("__r"), -F.col("state_id"))).alias("state_id"), F.max("__r").alias("overlap"),
        F.count(F.lit(1)).alias("candidates"))


def assign(districts: DataFrame, states: DataFrame, forced: DataFrame, dropped: DataFrame) -> DataFrame:
    """State per district: drop listed names, use a forced state where there is one, else the largest overlap.

    Both tables have polygons in ``rings``, or else a ``box`` per row.
    """
    kept = districts.join(dropped.select("name"), "name", "left_anti")
    if "rings" in districts.columns:
        shape = largest_shape_overlap(kept.select("district_id", "rings"), states)
    else:
        shape = largest_overlap(kept.select("district_id", "box"), states)
    one = kept.select("district_id", "name").distinct()
    return (one.join(forced.select("name", F.col("state_id").alias("__forced")), "name", "left")
            .join(shape.select("district_id", F.col("state_id").alias("__best")), "district_id", "left")
            .select("district_id", "name", F.coalesce("__forced", "__best").alias("state_id"),
                    F.col("__forced").isNotNull().alias("forced")))


def rename(assigned: DataFrame, renames: DataFrame) -> DataFrame:
    """Official name: the rename of the raw name, else of the cleaned name, else the cleaned name itself.

    ``renames`` is ``(state_id, old_name, new_name)``. Adds ``source``, the cleaned source name.
    """
    table = renames.select("state_id", "old_name", "new_name")
    cleaned = assigned.withColumn("source", F.trim(F.regexp_replace("name", r"(?U)\s+", " ")))
    by_raw = table.select("state_id", F.col("old_name").alias("name"), F.col("new_name").alias("__raw"))
    by_clean = table.select("state_id", F.col("old_name").alias("source"), F.col("new_name").alias("__clean"))
    return cleaned.join(by_raw, ["state_id", "name"], "left").join(by_clean, ["state_id", "source"], "left").select(
        "district_id", "state_id", "source", F.coalesce("__raw", "__clean", "source").alias("district"))


def alias_rows(named: DataFrame, legacy: DataFrame) -> DataFrame:
    """Aliases per state: changed source names, overridden by the curated ones."""
    auto = named.where(F.col("source") != F.col("district")).select("state_id", F.col("source").alias("alias"), "district", F.lit(0).alias("__p"))
    return auto.unionByName(legacy.select("state_id", "alias", "district", F.lit(1).alias("__p"))).groupBy("state_id", "alias").agg(
        F.max_by("district", "__p").alias("district"))


def duplicates(named: DataFrame) -> DataFrame:
    """District names that occur more than once in a state; must be empty."""
    return named.groupBy("state_id", "district").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(references: DataFrame, named: DataFrame) -> DataFrame:
    """Major cities or aliases whose district does not exist in the state; must be empty."""
    return references.join(named.select("state_id", "district").distinct(), ["state_id", "district"], "left_anti")


def resolve_areas(requests: DataFrame, named: DataFrame, aliases: DataFrame) -> DataFrame:
    """District of each ``(state_id, area)`` request: the exact name, else an alias in the same state, else NULL."""
    exact = named.select("state_id", F.col("district").alias("area"), F.col("district").alias("__exact")).distinct()
    other = aliases.select("state_id", F.col("alias").alias("area"), F.col("district").alias("__alias"))
    return requests.join(exact, ["state_id", "area"], "left").join(other, ["state_id", "area"], "left").withColumn(
        "district", F.coalesce("__exact", "__alias")).drop("__exact", "__alias")


def boundary_boxes(vertices: DataFrame, keys=("district_id",)) -> DataFrame:
    """Box of each boundary from its vertices ``(…, x, y)``, 4 decimals."""
    b = vertices.groupBy(*keys).agg(*[F.round(f(c), 4).alias(n) for n, f, c in (
        ("w", F.min, "x"), ("s", F.min, "y"), ("e", F.max, "x"), ("n", F.max, "y"))])
    return b.select(*keys, F.struct("w", "s", "e", "n").alias("box"))


def menu_order(named: DataFrame, majors: DataFrame) -> DataFrame:
    """Districts of a state as a menu lists them: major cities first in given order, then the rest by name."""
    first = majors.select("state_id", "district", "position")
    return named.select("state_id", "district").distinct().join(first, ["state_id", "district"], "left").select(
        "state_id", "district", F.when(F.col("position").isNotNull(), 0).otherwise(1).alias("section"), "position")


def state_records(states: DataFrame, named: DataFrame, aliases: DataFrame, majors: DataFrame) -> DataFrame:
    """One nested record per state, as the area file holds it: districts and aliases sorted by name, cities in order."""
    d = named.groupBy("state_id").agg(F.sort_array(F.collect_list("district")).alias("districts"))
    a = aliases.groupBy("state_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("alias", "district")))).alias("aliases"))
    m = majors.groupBy("state_id").agg(F.sort_array(F.collect_list(F.struct("position", "label", "district"))).alias("__m"))
    return states.join(d, "state_id", "left").join(a, "state_id", "left").join(m, "state_id", "left").withColumn(
        "major_cities", F.expr("transform(__m, c -> named_struct('label', c.label, 'district', c.district))")).drop("__m")
