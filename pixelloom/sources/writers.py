"""Writers. Each runs one write job; committing is Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pixelloom.operators.scoring import missing_embeddings
from pixelloom.plans.predict import STATUSES


def write_predictions(predictions: DataFrame, path: str) -> dict[str, int]:
    """Predictions as JSON lines and, next to them, the counts per status, which are also returned.

    The counts come from the job that writes (an ``Observation``), so nothing is read again. A task that is
    repeated counts once.
    """
    seen = Observation("predictions")
    each = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    predictions.observe(seen, *each, F.count(F.lit(1)).alias("__all")).write.mode("overwrite").json(f"{path}/predictions")
    counts = {s: seen.get[s] for s in STATUSES if seen.get[s]}
    other = seen.get["__all"] - sum(counts.values())
    if other:
        raise ValueError(f"{other} predictions have a status other than {', '.join(STATUSES)}")
    spark = predictions.sparkSession
    spark.createDataFrame(list(counts.items()), "status string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/status_counts")
    return counts


def append_results(results: DataFrame, path: str) -> None:
    """Results with their nested trace, partitioned by day so that later reads prune."""
    results.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def report_records(uploads: DataFrame, results: DataFrame) -> DataFrame:
    """Downloadable report per result: the answer first, then upload facts and the query, as JSON text."""
    files = F.transform("files", lambda f: F.struct(
        f.slot.alias("slot"), f.filename.alias("filename"), f.kind.alias("kind"), f.date.alias("date"), f.band_count.alias("bands"),
        f.crs.alias("crs"), f.resolution.alias("resolution"), f.roles.alias("band_roles")))
    joined = results.join(uploads.select("upload_id", "mode", "files", "warnings"), "upload_id")
    record = F.struct(
        F.struct("question", "status", "headline").alias("answer"),
        F.struct("upload_id", "mode", files.alias("files"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings")).alias("upload"),
        F.struct(*[c for c in results.columns]).alias("query"))
    return joined.select("upload_id", F.to_json(record).alias("report"))


def write_areas(records: DataFrame, path: str) -> None:
    """Area file: one record per state, sorted by name."""
    records.orderBy("state_name").write.mode("overwrite").json(path)


def extend_embedding_store(keys: DataFrame, path: str, model_id: str, encode) -> None:
    """Adds vectors for keys the store lacks. ``encode`` maps a key table to ``(key, vec)``, for example a
    ``mapInPandas`` over the encoder; keys already stored are never encoded again."""
    store = keys.sparkSession.read.parquet(path)
    fresh = encode(missing_embeddings(keys, store, model_id)).withColumn("model_id", F.lit(model_id))
    fresh.select("key", "vec", "model_id").write.mode("append").parquet(path)
