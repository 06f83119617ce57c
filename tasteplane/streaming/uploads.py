"""Exports as a stream: rating rows that arrive in a folder are parsed and merged batch by batch.

Batches are only ever added: each writes a partition of its own, which running the batch again replaces.
Readers fold them, so an upload may arrive in any number of batches: of a title rated
again the last arrival counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tasteplane.sources.export import parse_ratings

INCOMING = "upload_id string, uri string, name string, year string, rating string, date string, arrived timestamp"


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(INCOMING).json(folder)


def merge_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Usable ratings go to ``path``/ratings, counts of unusable rows to ``path``/skips, both by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = parse_ratings(batch, "upload_id", "arrived")
        rows.filter("skip is null").drop("skip").write.mode("overwrite").parquet(f"{path}/ratings/batch={batch_id}")
        rows.filter("skip is not null").groupBy("skip").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/skips/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The ratings of all batches: per upload and title the last arrival (of the last batch, then the highest rating)."""
    rows = spark.read.parquet(f"{path}/ratings")
    order = F.struct("arrived", "batch", "rating", "logged_date", "name", "year")
    held = [c for c in rows.columns if c not in ("upload_id", "source_uri", "arrived", "batch")]
    return rows.groupBy("upload_id", "source_uri").agg(F.max_by(F.struct(*held), order).alias("r")).select("upload_id", "source_uri", "r.*")


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Arrivals a day and upload, finished when the watermark has passed."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", "1 day"), "upload_id").agg(F.count("*").alias("n"))

