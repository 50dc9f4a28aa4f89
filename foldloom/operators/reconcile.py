"""Reconciliation of job ledgers, outputs and file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MergeError(ValueError):
    """Outputs of different studies must not be merged."""


def verify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every path of either side with ``status``: ``ok``, ``different``, ``missing`` or ``unlisted``."""
    a = files.select("path", F.col("sha256").alias("found"))
    b = manifest.select("path", F.col("sha256").alias("listed"))
    status = (F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted")
              .when(F.lower("found") == F.lower("listed"), "ok").otherwise("different"))
    return a.join(b, "path", "full").select("path", status.alias("status"))


def disagreements(left: DataFrame, right: DataFrame, value: str = "label", key: str = "record_id") -> DataFrame:
    """(key, left_value, right_value) of records whose value differs, or that one side lacks (``missing``: ``left``, ``right``, else NULL).

    Two stores with the same buckets meet bucket by bucket, without a shuffle.
    """
    a = left.select(F.col(key), F.col(value).alias("left_value"), F.lit(True).alias("_a"))
    b = right.select(F.col(key).alias("_key"), F.col(value).alias("right_value"), F.lit(True).alias("_b"))
    side = F.when(F.col("_a").isNull(), "left").when(F.col("_b").isNull(), "right")
    joined = a.join(b, F.col(key) == F.col("_key"), "full")
    return joined.where(side.isNotNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).select(
        F.coalesce(key, "_key").alias(key), "left_value", "right_value", side.alias("missing"))


def verification_summary(checked: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "different", "missing", "unlisted")]
    passed = F.count_if(F.col("status").isin("different", "missing")) == 0
    return checked.agg(*counts, passed.alias("passed"))


def job_states(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """State of every job from its records (``queue, job_id, kind``: done, failed or claimed).

    Failed minus done; claimed minus both is interrupted unless the record says running; otherwise waiting.
    """
    def seen(kind: str) -> Column:
        return F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False)).alias(f"_{kind}")

    flags = records.groupBy("queue", "job_id").agg(*[seen(k) for k in ("done", "failed", "claimed", "running")])
    state = (F.when(F.col("_done"), "done").when(F.col("_failed"), "failed").when(F.col("_running"), "running")
             .when(F.col("_claimed"), "interrupted").otherwise("waiting"))
    return jobs.join(flags, ["queue", "job_id"], "left").withColumn("state", state).drop(
        "_done", "_failed", "_claimed", "_running")


def output_counts(outputs: DataFrame) -> DataFrame:
    """Completion markers per job."""
    return outputs.groupBy("queue", "job_id").agg(F.count(F.lit(1)).alias("n_outputs"))


STATES = ("done", "running", "failed", "interrupted", "waiting")


def ledger_rollup(states: DataFrame, outputs: DataFrame, now: Column) -> DataFrame:
    """Per queue: jobs by state, outputs against expectation, rates per hour and the hours left.

    ``outputs(queue, job_id, finished_at)`` in epoch seconds; the first output starts the clock.
    """
    jobs = states.groupBy("queue").agg(
        F.count(F.lit(1)).alias("n_jobs"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in STATES],
        F.sum("expect_complete").alias("n_expected"))
    marks = outputs.withColumn("_now", now).groupBy("queue").agg(
        F.count(F.lit(1)).alias("n_outputs"), F.count_if(F.col("finished_at") > F.col("_now") - 3600).alias("n_recent"),
        F.min("finished_at").alias("_start"), F.max("_now").alias("_now"))
    joined = jobs.join(marks, "queue", "left").na.fill(0, ["n_outputs", "n_recent"])
    hours = F.greatest((F.col("_now") - F.col("_start")) / 3600.0, F.lit(1e-3))
    recent = F.try_divide(F.col("n_recent").cast("double"), F.least(F.lit(1.0), hours))
    enough = F.col("n_outputs") >= 2
    left = F.try_divide((F.col("n_expected") - F.col("n_outputs")).cast("double"), F.col("recent_rate"))
    return (joined.withColumn("percent", F.try_divide(100.0 * F.col("n_outputs"), F.col("n_expected")))
            .withColumn("recent_rate", F.when(enough, recent))
            .withColumn("overall_rate", F.when(enough, F.col("n_outputs") / hours))
            .withColumn("hours_left", F.when(F.col("recent_rate") > 0, left)).drop("_start", "_now"))


def completeness(states: DataFrame, counts: DataFrame) -> DataFrame:
    """Per queue: done, failed and expected against the outputs found; ``incomplete`` if anything lacks."""
    joined = states.join(counts, ["queue", "job_id"], "left").na.fill(0, ["n_outputs"])
    totals = joined.groupBy("queue").agg(
        F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("state") == "done").alias("n_done"),
        F.count_if(F.col("state") == "failed").alias("n_failed"), F.sum("expect_complete").alias("n_expected"),
        F.sum("n_outputs").alias("n_outputs"))
    return totals.withColumn("incomplete", (F.col("n_done") < F.col("n_jobs")) | (F.col("n_outputs") < F.col("n_expected")))


def complete_tasks(states: DataFrame, counts: DataFrame) -> DataFrame:
    """Done jobs with ``complete``: whether all expected outputs exist; order by ``position`` for a report."""
    done = states.where("state = 'done'").join(counts, ["queue", "job_id"], "left").na.fill(0, ["n_outputs"])
    return done.withColumn("complete", F.col("n_outputs") >= F.col("expect_complete"))


def studies_per_queue(states: DataFrame, outputs: DataFrame) -> DataFrame:
    """Done jobs' study ids per queue: how many, and the smallest and largest."""
    done = states.where("state = 'done'").select("queue", "job_id")
    return outputs.join(done, ["queue", "job_id"], "left_semi").groupBy("queue").agg(
        F.min("study_id").alias("first_study"), F.max("study_id").alias("last_study"), F.count(F.lit(1)).alias("n_rows"))


def merge_outputs(states: DataFrame, outputs: DataFrame) -> DataFrame:
    """Rows of done jobs, merged per queue; refuses mixed study ids and a ledger without done jobs."""
    if not states.where("state = 'done'").limit(1).count():
        raise MergeError("no done job to merge")
    queues = studies_per_queue(states, outputs).where("first_study <> last_study")
    mixed = [r["queue"] for r in queues.orderBy("queue").limit(20).collect()]
    if mixed:
        raise MergeError(f"more than one study id among the done jobs of {queues.count()} queues (studies_per_queue lists them), first {mixed}")
    done = states.where("state = 'done'").select("queue", "job_id")
    return outputs.join(done, ["queue", "job_id"], "left_semi")
