"""Metrics over events (per group), line items (heavy ties) and embeddings (ten classes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.functions import scores as sc
from foldloom.operators import metrics as me
from foldloom.operators import multiclass as mc
from foldloom.operators import rules
from foldloom.queries.views import RECORDS, TIES, VECTORS, records, rounded, sql, table, ties, vectors


def _events(spark, d):
    return records(spark, d).select(F.col("group_id").alias("unit"), F.col("label").alias("target"), "prob")


def _ties(spark, d):
    return ties(spark, d).select(F.col("group_id").alias("unit"), F.col("label").alias("target"), "prob")


EVENTS = RECORDS + ", p AS (SELECT group_id AS unit, label AS target, prob FROM records)"
EVENTS_POOLED = RECORDS + ", p AS (SELECT 'all' AS unit, label AS target, prob FROM records)"
NATIONS = TIES + ", p AS (SELECT group_id AS unit, label AS target, prob FROM ties)"
NATIONS_POOLED = TIES + ", p AS (SELECT 'all' AS unit, label AS target, prob FROM ties)"

# Rank statistics by comparing all pairs of distinct scores of a unit.
SCORED = """s AS (
  SELECT unit, prob, count(*) FILTER (target = 1) AS np, count(*) FILTER (target = 0) AS nn FROM p GROUP BY unit, prob),
pairs AS (
  SELECT a.unit, sum(a.np * b.nn * CASE WHEN a.prob > b.prob THEN 1.0::DOUBLE WHEN a.prob = b.prob THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS wins
  FROM s a JOIN s b ON a.unit = b.unit GROUP BY a.unit),
steps AS (
  SELECT a.unit, a.np, sum(b.np) AS tp, sum(b.nn) AS fp FROM s a JOIN s b ON a.unit = b.unit AND b.prob >= a.prob
  GROUP BY a.unit, a.prob, a.np),
ap AS (SELECT unit, sum(np::DOUBLE * tp / (tp + fp)) AS gain FROM steps GROUP BY unit),
c AS (
  SELECT unit, count(*) FILTER (target = 1 AND prob >= 0.5)::DOUBLE AS tp, count(*) FILTER (target = 0 AND prob < 0.5)::DOUBLE AS tn,
         count(*) FILTER (target = 0 AND prob >= 0.5)::DOUBLE AS fp, count(*) FILTER (target = 1 AND prob < 0.5)::DOUBLE AS fn
  FROM p GROUP BY unit),
m0 AS (
  SELECT c.*, tp + fn AS pos, tn + fp AS neg, tp + tn + fp + fn AS n, (tp + fn > 0 AND tn + fp > 0) AS twosided, wins, gain
  FROM c JOIN pairs USING (unit) JOIN ap USING (unit)),
m AS (
  SELECT unit, n::BIGINT AS n, pos::BIGINT AS n_pos, neg::BIGINT AS n_neg, NOT twosided AS single_class,
    tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn,
    (tp + tn) / n AS accuracy,
    CASE WHEN twosided THEN (tp / pos + tn / neg) / 2 END AS balanced_accuracy,
    tp / nullif(pos, 0) AS sensitivity, tn / nullif(neg, 0) AS specificity,
    tp / nullif(tp + fp, 0) AS precision, tn / nullif(tn + fn, 0) AS npv,
    CASE WHEN pos > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1_pos,
    CASE WHEN neg > 0 THEN 2 * tn / (2 * tn + fp + fn) END AS f1_neg,
    CASE WHEN twosided THEN (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 END AS macro_f1,
    CASE WHEN twosided THEN ((tp + tn) / n - (pos * (tp + fp) + neg * (tn + fn)) / (n * n))
      / nullif(1 - (pos * (tp + fp) + neg * (tn + fn)) / (n * n), 0) END AS kappa,
    CASE WHEN twosided THEN coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * pos * neg * (tn + fn)), 0), 0) END AS mcc,
    CASE WHEN twosided THEN wins / (pos * neg) END AS roc_auc,
    CASE WHEN twosided THEN gain / pos END AS average_precision
  FROM m0)"""

COUNTS = "n, n_pos, n_neg, single_class, tp, tn, fp, fn"
ROUNDED = ", ".join(f"round({x}, 9) AS {x}" for x in me.FOLD_METRICS)


def confusion_per_group(spark, d):
    return me.confusion(_events(spark, d), ["unit"])


def per_unit_metrics(spark, d):
    """Metrics per group, with a fold-level column carried along."""
    predictions = _events(spark, d).withColumn("fold_name", F.concat(F.lit("fold_"), "unit"))
    return rounded(me.per_unit_metrics(predictions, "unit", ["fold_name"]), *me.FOLD_METRICS)


def pooled_metrics(spark, d):
    return rounded(me.pooled_metrics(_events(spark, d)), *me.FOLD_METRICS)


def tied_unit_metrics(spark, d):
    return rounded(me.per_unit_metrics(_ties(spark, d)), *me.FOLD_METRICS)


def tied_pooled_metrics(spark, d):
    return rounded(me.pooled_metrics(_ties(spark, d)), *me.FOLD_METRICS)


SUMMARY = ["n_folds", "n_defined", "mean", "sd", "median", "q1", "q3", "iqr", "weighted_mean"]
AGG = ["mean", "sd", "median", "q1", "q3", "iqr", "weighted_mean"]


def _single_class_events(spark, d):
    """Events per case and day part, so that some units hold one class only."""
    rows = table(spark, d, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.hour("ts").cast("string")).alias("unit"),
        (F.col("event_type") == "error").cast("int").alias("target"), F.least(F.col("value") / 100, F.lit(1.0)).alias("prob"))
    return rows


HOURLY = """p AS (SELECT user_id || '-' || hour(ts) AS unit, CAST(event_type = 'error' AS INT) AS target,
  least(value / 100, 1.0) AS prob FROM events)"""


def fold_summary(spark, d):
    return rounded(me.summarize_folds(me.per_unit_metrics(_events(spark, d))), *AGG)


def single_class_summary(spark, d):
    return rounded(me.summarize_folds(me.per_unit_metrics(_single_class_events(spark, d))), *AGG)


def _summary_sql(source: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT unit, n, single_class, '{x}' AS metric, {x} AS v FROM m" for x in me.FOLD_METRICS)
    return sql(source, SCORED, f"l AS ({parts})", """sc AS (
  SELECT 'all_folds' AS scope, * FROM l UNION ALL SELECT 'both_class_folds', * FROM l WHERE NOT single_class)""", body="""
SELECT scope, metric, count(*) AS n_folds, count(v) AS n_defined, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd,
  round(quantile_cont(v, 0.5), 9) AS median, round(quantile_cont(v, 0.25), 9) AS q1, round(quantile_cont(v, 0.75), 9) AS q3,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 9) AS iqr,
  round(sum(v * n) / sum(CASE WHEN v IS NOT NULL THEN n END), 9) AS weighted_mean
FROM sc GROUP BY scope, metric""")


def metric_text(spark, d):
    summary = me.summarize_folds(me.per_unit_metrics(_ties(spark, d)))
    return summary.select("scope", "metric", sc.format_mean_sd(
        F.col("mean"), F.col("sd"), F.col("n_defined"), F.col("n_folds")).alias("text"))


METRIC_TEXT_SQL = sql(NATIONS, SCORED, "l AS (" + " UNION ALL ".join(
    f"SELECT unit, single_class, '{x}' AS metric, {x} AS v FROM m" for x in me.FOLD_METRICS) + ")", """sc AS (
  SELECT 'all_folds' AS scope, * FROM l UNION ALL SELECT 'both_class_folds', * FROM l WHERE NOT single_class)""", body="""
SELECT scope, metric, CASE WHEN count(v) = 0 THEN 'undefined' ELSE printf('%.3f', avg(v)) || ' ± ' ||
  coalesce(printf('%.3f', stddev_samp(v)), 'n/a') || ' (n=' || count(v) || '/' || count(*) || ')' END AS text
FROM sc GROUP BY scope, metric""")


def evaluation_report(spark, d):
    """All tables of the report in long form: table, key, metric, value."""
    report = me.evaluation_report(_events(spark, d))
    per_unit = report["fold_metrics"].unpivot("unit", list(me.FOLD_METRICS), "metric", "value").select(
        F.lit("fold_metrics").alias("part"), F.col("unit").alias("key"), "metric", "value")
    pooled = report["pooled"].unpivot([], list(me.FOLD_METRICS), "metric", "value").select(
        F.lit("pooled").alias("part"), F.lit("all").alias("key"), "metric", "value")
    summaries = [report[name].select("metric", *[F.col(c).cast("double").alias(c) for c in SUMMARY]).unpivot("metric", SUMMARY, "key", "value").select(
        F.lit(name).alias("part"), "key", "metric", "value") for name in ("fold_summary_all", "fold_summary_both_classes")]
    return rounded(per_unit.unionByName(pooled).unionByName(summaries[0]).unionByName(summaries[1]), "value")


EVALUATION_SQL = sql(EVENTS.replace("p AS (", "p AS (SELECT 'all' AS unit, label AS target, prob FROM records UNION ALL "),
                     SCORED, "l AS (" + " UNION ALL ".join(
                         f"SELECT unit, n, single_class, '{x}' AS metric, {x} AS v FROM m" for x in me.FOLD_METRICS) + ")", """sc AS (
  SELECT 'fold_summary_all' AS part, metric, n, v FROM l WHERE unit <> 'all'
  UNION ALL SELECT 'fold_summary_both_classes', metric, n, v FROM l WHERE unit <> 'all' AND NOT single_class),
agg AS (
  SELECT part, metric, count(*)::DOUBLE AS n_folds, count(v)::DOUBLE AS n_defined, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS median,
         quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr,
         sum(v * n) / sum(CASE WHEN v IS NOT NULL THEN n END) AS weighted_mean FROM sc GROUP BY part, metric)""", body="""
SELECT CASE WHEN unit = 'all' THEN 'pooled' ELSE 'fold_metrics' END AS part, unit AS key, metric, round(v, 9) AS value FROM l
""" + "".join(f"UNION ALL SELECT part, '{c}', metric, round({c}, 9) FROM agg\n" for c in SUMMARY))


def curve_points(spark, d):
    counts = me.score_counts(_ties(spark, d), ["unit"])
    return rounded(me.curve_points(me.score_ranks(counts, ["unit"]), ["unit"]), "threshold", "tpr", "fpr", "precision")


CURVE_SQL = sql(NATIONS, """s AS (
  SELECT unit, prob, count(*) FILTER (target = 1) AS np, count(*) FILTER (target = 0) AS nn FROM p GROUP BY unit, prob)""", body="""
SELECT unit, round(prob, 9) AS threshold, (SELECT sum(np) FROM s b WHERE b.unit = a.unit AND b.prob >= a.prob)::BIGINT AS tp,
  (SELECT sum(nn) FROM s b WHERE b.unit = a.unit AND b.prob >= a.prob)::BIGINT AS fp,
  round((SELECT sum(np) FROM s b WHERE b.unit = a.unit AND b.prob >= a.prob) / (SELECT sum(np) FROM s b WHERE b.unit = a.unit), 9) AS tpr,
  round((SELECT sum(nn) FROM s b WHERE b.unit = a.unit AND b.prob >= a.prob) / (SELECT sum(nn) FROM s b WHERE b.unit = a.unit), 9) AS fpr,
  round((SELECT sum(np) / sum(np + nn) FROM s b WHERE b.unit = a.unit AND b.prob >= a.prob), 9) AS precision
FROM s a""")


def invalid_predictions(spark, d):
    """Events whose type or value makes an invalid prediction: targets of 2 and missing scores."""
    target = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 1).otherwise(0)
    prob = F.when(F.col("value") < 50, F.col("value") / 100)
    rows = table(spark, d, "events").select(F.col("event_id").alias("record_id"), target.alias("target"), prob.alias("prob"))
    found = rules.check_records(rows, [rules.valid_target(), rules.finite_score()])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


CLASSES = list(range(10))


def confusion_matrix(spark, d):
    return mc.confusion_matrix(vectors(spark, d), CLASSES)


def class_metrics(spark, d):
    out = mc.class_metrics(mc.confusion_counts(vectors(spark, d)))
    return rounded(out, "sensitivity", "specificity", "precision", "f1")


CLASS_SQL = """k AS (SELECT unnest(range(10))::INT AS klass),
cm AS (
  SELECT klass, count(*) FILTER (truth = klass) AS support, count(*) FILTER (pred = klass) AS predicted,
         count(*) FILTER (truth = klass AND pred = klass) AS hits, count(*) AS n_total
  FROM k, vectors GROUP BY klass),
cl AS (
  SELECT *, coalesce(hits / nullif(support, 0), 0) AS sensitivity,
    coalesce((n_total - support - predicted + hits) / nullif(n_total - support, 0), 0) AS specificity,
    coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1
  FROM cm WHERE support + predicted > 0)"""


def multiclass_metrics(spark, d):
    out = mc.multiclass_metrics(mc.confusion_counts(vectors(spark, d)))
    return rounded(out, *[c for c in out.columns if c not in ("n", "n_classes")])


MULTICLASS_SQL = sql(VECTORS, CLASS_SQL, """t AS (
  SELECT max(n_total)::DOUBLE AS n, sum(hits)::DOUBLE AS c, sum(support::DOUBLE * predicted) AS tp, sum(support::DOUBLE * support) AS tt,
         sum(predicted::DOUBLE * predicted) AS pp FROM cl)""", body="""
SELECT max(n_total) AS n, count(*) FILTER (support > 0) AS n_classes, round((SELECT c / n FROM t), 9) AS accuracy,
  round(avg(sensitivity) FILTER (support > 0), 9) AS balanced_accuracy, round(avg(precision), 9) AS macro_precision,
  round(avg(sensitivity), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
  round(sum(f1 * support) / max(n_total), 9) AS weighted_f1,
  round((SELECT (c / n - tp / (n * n)) / (1 - tp / (n * n)) FROM t), 9) AS kappa,
  round((SELECT (c * n - tp) / sqrt((n * n - pp) * (n * n - tt)) FROM t), 9) AS mcc,
  round(avg(specificity), 9) AS macro_specificity FROM cl""")


def one_vs_rest_auc(spark, d):
    return rounded(mc.one_vs_rest_auc(vectors(spark, d)), "roc_auc")


def macro_auc(spark, d):
    return rounded(mc.macro_auc(mc.one_vs_rest_auc(vectors(spark, d))), "macro_auc")


OVR = """o AS (
  SELECT klass, CAST(truth = klass AS INT) AS target, probs[klass + 1] AS prob FROM (SELECT unnest(range(10))::INT AS klass), vectors),
auc AS (
  SELECT a.klass, sum(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS roc_auc
  FROM o a JOIN o b ON a.klass = b.klass AND a.target = 1 AND b.target = 0 GROUP BY a.klass)"""


def _scores(spark, d):
    """Event types as tasks, users modulo 11 as ten folds and a holdout, the mean value as score."""
    fit = F.col("user_id") % 11
    return (table(spark, d, "events").groupBy(F.col("event_type").alias("task"), fit.alias("fit"))
            .agg((F.avg("value") / 100).alias("score"))
            .withColumns({"fit_kind": F.when(F.col("fit") == 10, "holdout").otherwise("cv"),
                          "n_classes": (F.length("task") % 3 + 2).cast("bigint")}))


SCORES = """f AS (
  SELECT event_type AS task, length(event_type) % 3 + 2 AS n_classes, user_id % 11 AS fit, avg(value) / 100 AS score
  FROM events GROUP BY ALL),
cv AS (
  SELECT task, n_classes::BIGINT AS n_classes, count(*) FILTER (fit < 10) AS n_fits, avg(score) FILTER (fit < 10) AS cv_mean,
         stddev_samp(score) FILTER (fit < 10) AS cv_sd, avg(score) FILTER (fit = 10) AS holdout_score
  FROM f GROUP BY task, n_classes)"""


def cv_summary(spark, d):
    return rounded(me.cv_summary(_scores(spark, d)), "cv_mean", "cv_sd", "holdout_score")


def cv_range(spark, d):
    return rounded(me.cv_range(me.cv_summary(_scores(spark, d))), "lowest", "highest")


def _history(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("fit"), F.col("event_id").alias("epoch"),
                                            F.round("value", 0).alias("score"))


BEST = """h AS (SELECT user_id AS fit, event_id AS epoch, round(value, 0) AS score FROM events),
top AS (SELECT fit, max(score) AS s, max(epoch) AS last_epoch FROM h GROUP BY fit),
best AS (SELECT h.fit, min(h.epoch) AS best_epoch, s AS best_score, last_epoch FROM h JOIN top ON h.fit = top.fit AND h.score = s GROUP BY h.fit, s, last_epoch)"""


def best_epoch(spark, d):
    return me.best_epoch(_history(spark, d))


def early_share(spark, d):
    return rounded(me.early_share(me.best_epoch(_history(spark, d)), 2000), "early_share")


QUERIES = {
    "confusion_per_group": (confusion_per_group, sql(EVENTS, body="""
SELECT unit, count(*) FILTER (target = 1 AND prob >= 0.5) AS tp, count(*) FILTER (target = 0 AND prob < 0.5) AS tn,
  count(*) FILTER (target = 0 AND prob >= 0.5) AS fp, count(*) FILTER (target = 1 AND prob < 0.5) AS fn FROM p GROUP BY unit""")),
    "per_unit_metrics": (per_unit_metrics, sql(EVENTS, SCORED, body=f"SELECT unit, 'fold_' || unit AS fold_name, {COUNTS}, {ROUNDED} FROM m")),
    "pooled_metrics": (pooled_metrics, sql(EVENTS_POOLED, SCORED, body=f"SELECT {COUNTS}, {ROUNDED} FROM m")),
    "tied_unit_metrics": (tied_unit_metrics, sql(NATIONS, SCORED, body=f"SELECT unit, {COUNTS}, {ROUNDED} FROM m")),
    "tied_pooled_metrics": (tied_pooled_metrics, sql(NATIONS_POOLED, SCORED, body=f"SELECT {COUNTS}, {ROUNDED} FROM m")),
    "fold_summary": (fold_summary, _summary_sql(EVENTS)),
    "single_class_summary": (single_class_summary, _summary_sql(HOURLY)),
    "metric_text": (metric_text, METRIC_TEXT_SQL),
    "evaluation_report": (evaluation_report, EVALUATION_SQL),
    "curve_points": (curve_points, CURVE_SQL),
    "invalid_predictions": (invalid_predictions, """
SELECT 'prediction_target' AS rule, count(*) AS n FROM events WHERE event_type = 'purchase' HAVING count(*) > 0
UNION ALL SELECT 'prediction_score', count(*) FROM events WHERE value >= 50 HAVING count(*) > 0"""),
    "confusion_matrix": (confusion_matrix, sql(VECTORS, body="SELECT truth, " + ", ".join(
        f"count(*) FILTER (pred = {c}) AS pred_{c}" for c in CLASSES) + " FROM vectors GROUP BY truth")),
    "class_metrics": (class_metrics, sql(VECTORS, CLASS_SQL, body="""
SELECT klass, support, predicted, hits, n_total, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity,
  round(precision, 9) AS precision, round(f1, 9) AS f1 FROM cl""")),
    "multiclass_metrics": (multiclass_metrics, MULTICLASS_SQL),
    "one_vs_rest_auc": (one_vs_rest_auc, sql(VECTORS, OVR, body="""
SELECT auc.klass, count(*) FILTER (target = 1) AS n_pos, count(*) FILTER (target = 0) AS n_neg, round(any_value(roc_auc), 9) AS roc_auc
FROM auc JOIN o ON auc.klass = o.klass GROUP BY auc.klass""")),
    "macro_auc": (macro_auc, sql(VECTORS, OVR, body="SELECT count(*) AS n_defined, round(avg(roc_auc), 9) AS macro_auc FROM auc")),
    "cv_summary": (cv_summary, sql(SCORES, body="""
SELECT task, n_classes, n_fits, round(cv_mean, 9) AS cv_mean, round(cv_sd, 9) AS cv_sd, round(holdout_score, 9) AS holdout_score FROM cv""")),
    "cv_range": (cv_range, sql(SCORES, body="""
SELECT n_classes, count(*) AS n_tasks, round(min(cv_mean), 9) AS lowest, round(max(cv_mean), 9) AS highest FROM cv GROUP BY n_classes""")),
    "best_epoch": (best_epoch, sql(BEST, body="SELECT * FROM best")),
    "early_share": (early_share, sql(BEST, body="""
SELECT count(*) AS n_fits, count(*) FILTER (best_epoch <= 2000) AS n_early,
  round(count(*) FILTER (best_epoch <= 2000) / count(*), 9) AS early_share FROM best""")),
}
