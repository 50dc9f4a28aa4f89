"""Job ledgers and file manifests made from conversations and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldloom.operators import reconcile as rc
from foldloom.plans.stage import new_path
from foldloom.queries.views import prefixed, rounded, sql, table
from foldloom.sources.stores import write_store


def _jobs(spark, d):
    """A conversation is a job that expects one output per turn; four queues."""
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    return turns.groupBy(F.col("conv_id").alias("job_id")).agg((F.max("turn") + 1).alias("expect_complete")).select(
        prefixed("q", F.col("job_id") % 4).alias("queue"), "job_id", "expect_complete", F.col("job_id").alias("position"))


def _records(spark, d):
    """By conversation number: done, failed, both, running, claimed only, or nothing."""
    kinds = F.when(F.col("job_id") % 7 < 3, F.array(F.lit("claimed"), F.lit("done"))).when(
        F.col("job_id") % 7 == 3, F.array(F.lit("failed"))).when(
        F.col("job_id") % 7 == 4, F.array(F.lit("failed"), F.lit("done"))).when(
        F.col("job_id") % 7 == 5, F.array(F.lit("claimed"))).otherwise(
        F.when(F.col("job_id") % 2 == 0, F.array(F.lit("claimed"), F.lit("running"))).otherwise(F.array().cast("array<string>")))
    return _jobs(spark, d).select("queue", "job_id", F.explode(kinds).alias("kind"))


def _outputs(spark, d):
    """Turns are outputs, but the last turn of every fifth conversation is lost; times follow conversation and turn."""
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    kept = turns.where(~((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0)))
    return kept.select(prefixed("q", F.col("conv_id") % 4).alias("queue"), F.col("conv_id").alias("job_id"),
                       prefixed("study_", F.col("conv_id") % 4).alias("study_id"), "turn",
                       (F.col("conv_id") * 40 + F.col("turn") * 7).alias("finished_at"))


LEDGER = """jobs AS (SELECT 'q' || (conv_id % 4) AS queue, conv_id AS job_id, max(turn) + 1 AS expect_complete FROM conversations GROUP BY conv_id),
states AS (
  SELECT *, CASE WHEN job_id % 7 IN (0, 1, 2, 4) THEN 'done' WHEN job_id % 7 = 3 THEN 'failed' WHEN job_id % 7 = 5 THEN 'interrupted'
    WHEN job_id % 2 = 0 THEN 'running' ELSE 'waiting' END AS state FROM jobs),
outputs AS (
  SELECT 'q' || (conv_id % 4) AS queue, conv_id AS job_id, 'study_' || (conv_id % 4) AS study_id, turn, conv_id * 40 + turn * 7 AS finished_at
  FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 0))"""


def _states(spark, d):
    return rc.job_states(_jobs(spark, d), _records(spark, d))


def job_states(spark, d):
    return _states(spark, d).drop("position")


def ledger_rollup(spark, d):
    outputs = _outputs(spark, d)
    now = outputs.agg(F.max("finished_at")).scalar()
    out = rc.ledger_rollup(_states(spark, d), outputs, now)
    return rounded(out, "percent", "recent_rate", "overall_rate", "hours_left")


ROLLUP_SQL = sql(LEDGER, """j AS (
  SELECT queue, count(*) AS n_jobs, count(*) FILTER (state = 'done') AS n_done, count(*) FILTER (state = 'running') AS n_running,
    count(*) FILTER (state = 'failed') AS n_failed, count(*) FILTER (state = 'interrupted') AS n_interrupted,
    count(*) FILTER (state = 'waiting') AS n_waiting, sum(expect_complete)::BIGINT AS n_expected FROM states GROUP BY queue),
o AS (
  SELECT queue, count(*) AS n_outputs, count(*) FILTER (finished_at > t - 3600) AS n_recent, greatest((max(t) - min(finished_at)) / 3600, 0.001) AS hours
  FROM outputs, (SELECT max(finished_at) AS t FROM outputs) GROUP BY queue),
r AS (SELECT j.*, n_outputs, n_recent, hours, n_recent / least(1, hours) AS rate FROM j JOIN o USING (queue))""", body="""
SELECT * EXCLUDE (hours, rate), round(100 * n_outputs / n_expected, 9) AS percent, round(rate, 9) AS recent_rate,
  round(n_outputs / hours, 9) AS overall_rate, round(CASE WHEN rate > 0 THEN (n_expected - n_outputs) / rate END, 9) AS hours_left FROM r""")


def completeness(spark, d):
    return rc.completeness(_states(spark, d), rc.output_counts(_outputs(spark, d)))


COUNTED = """counted AS (SELECT s.*, (SELECT count(*) FROM outputs o WHERE o.job_id = s.job_id) AS n_outputs FROM states s)"""


def complete_tasks(spark, d):
    return rc.complete_tasks(_states(spark, d), rc.output_counts(_outputs(spark, d))).drop("position").orderBy("queue", "job_id")


def studies_per_queue(spark, d):
    return rc.studies_per_queue(_states(spark, d), _outputs(spark, d))


def merged_outputs(spark, d):
    return rc.merge_outputs(_states(spark, d), _outputs(spark, d))


def _files(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
                                               F.sha2("text", 256).alias("sha256"))
    key = F.col("doc_id")
    files = docs.where(key % 17 != 0).select("path", "sha256")
    manifest = docs.where(key % 19 != 0).select("path", F.when(key % 23 == 0, F.sha2("sha256", 256)).otherwise(F.upper("sha256")).alias("sha256"))
    return files, manifest


FILES = """checked AS (
  SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 19 = 0 THEN 'unlisted'
    WHEN doc_id % 23 = 0 THEN 'different' ELSE 'ok' END AS status FROM documents WHERE NOT (doc_id % 17 = 0 AND doc_id % 19 = 0))"""


def verified_files(spark, d):
    return rc.verify_files(*_files(spark, d))


def verification_summary(spark, d):
    return rc.verification_summary(rc.verify_files(*_files(spark, d)))


def stored_label_check(spark, d):
    """Labels of the labelled documents against an edited copy, both stored in buckets by record."""
    left = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("label")).withColumnRenamed("doc_id", "record_id")
    key = F.col("record_id")
    right = left.where(key % 31 != 0).select("record_id", F.when(key % 17 == 0, 1 - F.col("label")).when(key % 29 == 0, F.lit(None)).otherwise(F.col("label")).alias("label"))
    sides = [write_store(side, f"labels_{uuid.uuid4().hex}", new_path(spark), buckets=8) for side in (left, right)]
    return rc.disagreements(*sides)


STORED_LABEL_SQL = """
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id)
SELECT doc_id AS record_id, q AS left_value, CASE WHEN doc_id % 31 <> 0 AND doc_id % 17 = 0 THEN 1 - q END AS right_value, CASE WHEN doc_id % 31 = 0 THEN 'right' END AS missing
FROM l WHERE doc_id % 31 = 0 OR (doc_id % 17 = 0 AND q IS NOT NULL) OR (doc_id % 17 <> 0 AND doc_id % 29 = 0 AND q IS NOT NULL)"""

QUERIES = {
    "stored_label_check": (stored_label_check, STORED_LABEL_SQL),
    "job_states": (job_states, sql(LEDGER, body="SELECT queue, job_id, expect_complete, state FROM states")),
    "ledger_rollup": (ledger_rollup, ROLLUP_SQL),
    "completeness": (completeness, sql(LEDGER, COUNTED, body="""
SELECT queue, count(*) AS n_jobs, count(*) FILTER (state = 'done') AS n_done, count(*) FILTER (state = 'failed') AS n_failed,
  sum(expect_complete)::BIGINT AS n_expected, sum(n_outputs)::BIGINT AS n_outputs,
  count(*) FILTER (state = 'done') < count(*) OR sum(n_outputs) < sum(expect_complete) AS incomplete FROM counted GROUP BY queue""")),
    "complete_tasks": (complete_tasks, sql(LEDGER, COUNTED, body="""
SELECT queue, job_id, expect_complete, state, n_outputs, n_outputs >= expect_complete AS complete FROM counted WHERE state = 'done'""")),
    "studies_per_queue": (studies_per_queue, sql(LEDGER, body="""
SELECT o.queue, min(study_id) AS first_study, max(study_id) AS last_study, count(*) AS n_rows
FROM outputs o JOIN states s ON o.job_id = s.job_id WHERE state = 'done' GROUP BY o.queue""")),
    "merged_outputs": (merged_outputs, sql(LEDGER, body="""
SELECT o.* FROM outputs o JOIN states s ON o.job_id = s.job_id WHERE state = 'done'""")),
    "verified_files": (verified_files, sql(FILES, body="SELECT path, status FROM checked")),
    "verification_summary": (verification_summary, sql(FILES, body="""
SELECT count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'different') AS n_different,
  count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'unlisted') AS n_unlisted,
  count(*) FILTER (status IN ('different', 'missing')) = 0 AS passed FROM checked""")),
}
