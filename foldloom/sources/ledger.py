"""Job ledgers on disk: job lists, done/failed/claimed records and completion markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.sources.files import list_files


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    """``queue, job_id, expect_complete, position`` from ``jobs/<queue>/jobs.jsonl``."""
    lines = spark.read.schema("id string, expect_complete bigint").json(root.rstrip("/") + "/jobs/*/jobs.jsonl")
    parts = F.split(F.col("_metadata.file_path"), "/")
    # Lines keep their order within a file split, which is all that a report order needs.
    return lines.select(F.element_at(parts, -2).alias("queue"), F.col("id").alias("job_id"),
                        F.coalesce("expect_complete", F.lit(0)).alias("expect_complete"),
                        F.monotonically_increasing_id().alias("position"))


def read_job_records(spark: SparkSession, root: str) -> DataFrame:
    """``queue, job_id, kind`` from ``jobs/<queue>/{done,failed}/<job>.json`` and ``claims/<job>/``."""
    files = list_files(spark, root.rstrip("/") + "/jobs", "*.json")
    parts = F.split("rel", "/")
    kind, name = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    finished = files.where((F.size(parts) == 3) & kind.isin("done", "failed")).select(
        parts[0].alias("queue"), F.regexp_replace(name, r"\.json$", "").alias("job_id"), kind.alias("kind"))
    claimed = files.where((F.size(parts) == 4) & (kind == "claims")).select(
        parts[0].alias("queue"), name.alias("job_id"), F.lit("claimed").alias("kind"))
    return finished.unionByName(claimed)


def read_outputs(spark: SparkSession, root: str, marker: str = "complete.json") -> DataFrame:
    """``queue, job_id, study_id, path, finished_at`` of the markers below ``runs/<queue>/<job>/<study>/``."""
    files = list_files(spark, root.rstrip("/") + "/runs", marker)
    parts = F.split("rel", "/")
    return files.select(parts[0].alias("queue"), F.get(parts, F.lit(1)).alias("job_id"),
                        F.get(parts, F.lit(2)).alias("study_id"), F.col("rel").alias("path"),
                        F.unix_timestamp("modificationTime").alias("finished_at"))


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """``fit, epoch, score`` from the ``history.csv`` files below ``root``; the folder names the fit."""
    rows = (spark.read.schema("epoch int, val_macro_f1 double").option("header", "true")
            .option("recursiveFileLookup", "true").option("pathGlobFilter", "history.csv").csv(root))
    fit = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(fit.alias("fit"), "epoch", F.col("val_macro_f1").alias("score"))
