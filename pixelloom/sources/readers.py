"""Readers. All are lazy scans; columns and filters of later steps reach the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.semantics import finite

# Image file endings.
TIFF_EXTS = ("tif", "tiff")
PHOTO_EXTS = ("png", "jpg", "jpeg")
DEFAULT_QUESTIONS = {"caption": "Describe this image"}

CATALOGUE_SCHEMA = """upload_id STRING, slot INT, mode STRING, filename STRING, driver STRING, width INT, height INT, band_count INT,
  dtypes ARRAY<STRING>, band_descriptions ARRAY<STRING>, crs STRING, bounds STRUCT<left: DOUBLE, bottom: DOUBLE, right: DOUBLE, top: DOUBLE>,
  resolution STRUCT<x: DOUBLE, y: DOUBLE, units: STRING>, georeferenced BOOLEAN, nodata STRING, date STRING, sensor STRING,
  band_roles STRING, benchmark_mode BOOLEAN"""
MANIFEST_SCHEMA = """id STRING, mode STRING, image STRING, images ARRAY<STRING>, dates ARRAY<STRING>, sensors ARRAY<STRING>,
  band_roles ARRAY<STRING>, question STRING"""


def read_pixels(spark: SparkSession, path: str, roles: Sequence[str], keys: Sequence[str] = ("image_id", "row", "col"),
                nodata: float | None = None) -> DataFrame:
    """The listed bands of a pixel table; nodata, NaN and infinities as NULL. Other bands are not read."""
    df = spark.read.parquet(path).select(*keys, *roles)

    def value(role):
        v = finite(F.col(role))
        return (v if nodata is None else F.when(v != F.lit(nodata), v)).alias(role)

    return df.select(*keys, *[value(r) for r in roles])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Raster metadata records, one JSON object per line. ``nodata`` stays text: it can be "nan", "inf" or "-inf"."""
    return spark.read.schema(CATALOGUE_SCHEMA).json(path)


def read_manifest(spark: SparkSession, path: str, task: str = "auto", question: str | None = None, lines: bool = False) -> DataFrame:
    """Batch items of a JSON list, one row per item, with default id, question and mode; image paths made
    absolute against the manifest's folder.

    An item without an id gets its position in the list. With ``lines`` the file has one item per line and is
    read by many tasks; an item without an id then gets a digest of its content, as lines have no number there.
    """
    base = path.rsplit("/", 1)[0]
    ask = question or DEFAULT_QUESTIONS.get(task)
    if lines:
        raw = spark.read.schema(MANIFEST_SCHEMA).json(path)
        raw = raw.withColumn("__n", F.md5(F.to_json(F.struct(*raw.columns))))
    else:
        listed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"ARRAY<STRUCT<{MANIFEST_SCHEMA}>>").alias("items"))
        raw = listed.select(F.posexplode("items").alias("__n", "item")).select("__n", "item.*")
    images = F.coalesce("images", F.array("image"))
    return raw.withColumn("images", F.transform(images, lambda p: F.when(p.startswith("/") | p.contains("://"), p).otherwise(
        F.concat(F.lit(base + "/"), p)))).select(
        F.coalesce("id", F.col("__n").cast("string")).alias("id"), F.coalesce("question", F.lit(ask)).alias("question"),
        F.coalesce("mode", F.when(F.size("images") == 1, "single").otherwise("optical_sar")).alias("mode"),
        "images", "dates", "sensors", "band_roles")


def manifest_files(manifest: DataFrame) -> DataFrame:
    """One row per file of each item: (id, slot, path, date, band_roles)."""
    return manifest.select("id", "mode", F.posexplode("images").alias("__p", "path"), "dates", "band_roles").select(
        "id", "mode", (F.col("__p") + 1).alias("slot"), "path", F.get("dates", F.col("__p")).alias("date"),
        F.get("band_roles", F.col("__p")).alias("band_roles"))


def read_folder(spark: SparkSession, path: str, photos: bool = False) -> DataFrame:
    """Image files of a folder: (id, path, length). File contents are not read."""
    endings = "|".join(TIFF_EXTS + (PHOTO_EXTS if photos else ()))
    listing = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return listing.where(F.lower("path").rlike(rf"\.({endings})$")).select(
        F.regexp_replace(name, r"\.[^.]+$", "").alias("id"), "path", "length")


def read_qa_split(spark: SparkSession, folder: str, split: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, questions and answers of a split; each file is one JSON object with one array.

    With ``lines`` the files (``.jsonl``) have one record per line and are read by many tasks.
    """
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split!r}")

    def part(key, fields):
        if lines:
            return spark.read.schema(fields.replace(": ", " ")).json(f"{folder}/LR_split_{split}_{key}.jsonl")
        df = spark.read.schema(f"{key} ARRAY<STRUCT<{fields}>>").option("multiLine", True).json(f"{folder}/LR_split_{split}_{key}.json")
        return df.select(F.inline(key))

    return (part("images", "id: BIGINT, active: BOOLEAN"),
            part("questions", "id: BIGINT, img_id: BIGINT, type: STRING, question: STRING, active: BOOLEAN"),
            part("answers", "id: BIGINT, question_id: BIGINT, answer: STRING, active: BOOLEAN"))


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Labelled patches: only the five columns that are used."""
    return spark.read.parquet(path).select("image", "nir", "labels", "image_id", "country")


def read_boundaries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rings of GeoJSON features: (feature_id, iso, name, ring_id, ring ARRAY<ARRAY<DOUBLE>>).

    ``feature_id`` is the position in the collection. With ``lines`` the file has one feature per line and is
    read by many tasks; ``feature_id`` is then the feature's own shapeID.
    """
    item = ("properties STRUCT<shapeName: STRING, shapeISO: STRING, shapeID: STRING>, geometry STRUCT<type: STRING, coordinates: STRING>")
    if lines:
        feature = spark.read.schema(item).json(path).select(F.col("properties.shapeID").alias("feature_id"), F.struct("properties", "geometry").alias("f"))
    else:
        feature = spark.read.schema(f"features ARRAY<STRUCT<{item}>>").option("multiLine", True).json(path).select(
            F.posexplode("features").alias("feature_id", "f"))
    text = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(text, "ARRAY<ARRAY<ARRAY<DOUBLE>>>"))).otherwise(
        F.from_json(text, "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"))
    return feature.select("feature_id", F.col("f.properties.shapeISO").alias("iso"), F.col("f.properties.shapeName").alias("name"),
                          F.posexplode(F.flatten(polygons)).alias("ring_id", "ring"))


def ring_edges(rings: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Edges (x1, y1, x2, y2) of rings; an open ring is closed."""
    closed = F.expr("if(ring[0] = element_at(ring, -1), ring, concat(ring, array(ring[0])))")
    return rings.withColumn("r", closed).select(*keys, F.expr(
        "inline(transform(sequence(0, size(r) - 2), i -> named_struct('x1', r[i][0], 'y1', r[i][1], 'x2', r[i + 1][0], 'y2', r[i + 1][1])))"))


def read_areas(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Districts, aliases and major cities of the nested area file, flat: (state, …). With ``lines`` one state per line."""
    state = ("name STRING, iso STRING, type STRING, lat DOUBLE, lon DOUBLE, bbox ARRAY<DOUBLE>, zoom INT, "
             "major_cities ARRAY<STRUCT<label: STRING, district: STRING>>, districts ARRAY<STRUCT<name: STRING, lat: DOUBLE, lon: DOUBLE, "
             "bbox: ARRAY<DOUBLE>, zoom: INT>>, aliases MAP<STRING, STRING>")
    states = spark.read.schema(state).json(path) if lines else spark.read.schema(f"states ARRAY<STRUCT<{state}>>").option(
        "multiLine", True).json(path).select(F.inline("states"))
    state = F.col("name").alias("state")
    return (states.select(state, F.explode("districts").alias("d")).select("state", "d.*"),
            states.select(state, F.explode("aliases").alias("alias", "district")),
            states.select(state, F.posexplode("major_cities").alias("position", "c")).select("state", "position", "c.label", "c.district"))


def read_collection(spark: SparkSession, root: str, name: str, start: str, end: str) -> DataFrame:
    """Observations of a named collection stored by year and month, for ``[start, end)``.

    The period is given on the partition columns too, so only its months are listed and read.
    """
    first, last = start[:7].replace("-", ""), end[:7].replace("-", "")
    month = F.col("year") * 100 + F.col("month")
    return spark.read.parquet(f"{root}/{name}").where(
        (month >= int(first)) & (month <= int(last)) & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
