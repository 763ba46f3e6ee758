"""Sinks: chunk tables, reports, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import evaluation


def safe_filename(chunk_id: Column) -> Column:
    return F.concat(F.regexp_replace(chunk_id, "::", "--"), F.lit(".md"))


def save_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """A Parquet table by strategy, so that one strategy can be replaced or read by itself."""
    chunks.write.mode(mode).partitionBy("strategy").parquet(path)


def replace_strategy(chunks: DataFrame, path: str) -> None:
    """Overwrites just the strategies that occur in chunks."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def load_chunks(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if strategy is None else out.where(F.col("strategy") == strategy)


def write_metrics_csv(results: DataFrame, path: str, with_judge: bool = True) -> None:
    evaluation.metrics_rows(results, with_judge).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_summary_json(summary: DataFrame, path: str) -> None:
    evaluation.summary_json(summary).select("json").coalesce(1).write.mode("overwrite").text(path)


def write_signals(convolved: DataFrame, path: str) -> None:
    """Similarity signals, smoothed signals and valleys as JSON lines."""
    convolved.select("note_id", "signal", "smoothed", "valleys").write.mode("overwrite").json(path)


def plan_notes(plans: DataFrame, tag: str) -> DataFrame:
    """Plans or design documents (id, title, body) as note rows."""
    return plans.select("id", "title", F.col("body").alias("content"), F.array(F.lit(tag)).alias("tags"), F.lit(5).alias("priority"))
