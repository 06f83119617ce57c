"""Where results go: tables partitioned by upload, append-only runs, and the audit sheet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteplane.functions.scalar import finite

# fixed values: the audit sheet's columns
REVIEW_COLUMNS = ("match_method", "confidence", "name", "query_year", "title", "original_title", "year", "vote_count", "film_id", "source_uri", "reason", "link", "verdict", "notes")


def replace_upload(df: DataFrame, path: str) -> None:
    """Write an upload's rows so that doing it again changes nothing: only the partitions in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_id").parquet(path)


def append_run(spark: SparkSession, path: str, upload_id: str, model_version: str, config: DataFrame, metrics: DataFrame) -> str:
    """One row (run id, config and metrics as JSON) added to the run log; returns the run id."""
    run_id = uuid.uuid4().hex
    as_json = lambda df: df.select(F.to_json(F.struct("*")).alias("j")).agg(F.to_json(F.array_sort(F.collect_list("j"))).alias("j"))
    row = as_json(config).select(F.col("j").alias("config")).join(as_json(metrics).select(F.col("j").alias("metrics")), how="cross")
    row.select(F.lit(run_id).alias("run_id"), F.lit(upload_id).alias("upload_id"), F.lit(model_version).alias("model_version"), "config", "metrics", F.current_timestamp().alias("created_at")).write.mode("append").parquet(path)
    return run_id


def payload(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """Metrics as the run log keeps them: finite (else 0) and rounded."""
    return metrics.select(*[F.round(finite(F.col(c)), digits).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])


def append_effects(effects: DataFrame, inseparable: DataFrame, path: str, run_id: str) -> None:
    """All fitted effects of a run, with the director they cannot be told from."""
    keys = ["upload_id", "role", "person_id"]
    rows = effects.join(inseparable.select(*keys, F.col("director_id").alias("inseparable_from_person_id")), keys, "left")
    rows.select(F.lit(run_id).alias("run_id"), "person_id", "role", "effect", "stderr", F.col("n").cast("int").alias("n_films"), "inseparable_from_person_id").write.mode("append").parquet(path)


def append_recommendations(topped: DataFrame, path: str, run_id: str) -> None:
    topped.select(F.lit(run_id).alias("run_id"), "film_id", F.col("predicted").alias("score"), F.col("reason_person_id").alias("primary_reason_person_id"), F.col("percentile").alias("novelty_pct")).write.mode("append").parquet(path)


def write_review(cases: DataFrame, path: str) -> None:
    """The audit sheet: fixed columns, confidence with two decimals, empty strings for nulls, ordered by method and name."""
    texts = {c: F.coalesce(F.format_string("%.2f", "confidence") if c == "confidence" else F.col(c).cast("string"), F.lit("")) if c in cases.columns else F.lit("") for c in REVIEW_COLUMNS}
    cases.select(*[v.alias(k) for k, v in texts.items()]).orderBy("match_method", "name").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
