"""Binary classification metrics per unit and pooled; NULL means undefined.

Everything starts from ``score_counts``: positives and negatives per (unit, score). Equal scores are one row
from then on, so ties need no care and a repeated score is never a hot spot. Rank statistics read running
totals over score ranges and not a whole unit in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.functions.scores import THRESHOLD, finite_or_null, ratio
from foldloom.plans.ordering import exact_percentiles, running_totals
from foldloom.plans.stage import stage

FOLD_METRICS = ("accuracy", "balanced_accuracy", "sensitivity", "specificity", "precision", "npv",
                "f1_pos", "f1_neg", "macro_f1", "kappa", "mcc", "roc_auc", "average_precision")


def invalid_prediction(target: str = "target", prob: str = "prob") -> Column:
    """True for a prediction whose target is not 0/1 or whose score is missing or not finite."""
    valid = F.col(target).isin(0, 1) & (F.abs(F.col(prob)) < F.lit(math.inf))
    return ~F.coalesce(valid, F.lit(False))


def score_counts(predictions: DataFrame, by: Sequence[str] = (), target: str = "target",
                 prob: str = "prob") -> DataFrame:
    """Positives and negatives per score. An invalid prediction fails the job with a message."""
    checked = F.when(invalid_prediction(target, prob),
                     F.raise_error("predictions need a target of 0 or 1 and a finite score")
                     .cast("double")).otherwise(F.col(prob).cast("double"))
    return (predictions.select(*by, checked.alias("prob"), F.col(target).alias("_t"))
            .groupBy(*by, "prob").agg(F.count_if(F.col("_t") == 1).alias("n_pos"),
                                      F.count_if(F.col("_t") == 0).alias("n_neg")))


def confusion(predictions: DataFrame, by: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """tp, tn, fp, fn at the threshold, without ranking. Invalid or no predictions raise."""
    hit = F.col("prob") >= F.lit(threshold)
    part = lambda side, keep: F.coalesce(F.sum(F.when(keep, F.col(side))), F.lit(0))
    return refuse_empty(score_counts(predictions, by)).groupBy(*by).agg(
        part("n_pos", hit).alias("tp"), part("n_neg", ~hit).alias("tn"), part("n_neg", hit).alias("fp"), part("n_pos", ~hit).alias("fn"))


def refuse_empty(counts: DataFrame) -> DataFrame:
    """``counts``, or an error if they count nothing: metrics of no predictions are a mistake further up."""
    if counts.isEmpty():
        raise ValueError("there are no predictions")
    return counts


def score_ranks(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score counts with the positives and negatives below each score and in total."""
    return running_totals(counts, ["prob"], ["n_pos", "n_neg"], by)


def curve_points(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points: every score as threshold."""
    tp = F.col("total_n_pos") - F.col("before_n_pos")
    fp = F.col("total_n_neg") - F.col("before_n_neg")
    return ranks.select(*by, F.col("prob").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                        ratio(tp, F.col("total_n_pos")).alias("tpr"), ratio(fp, F.col("total_n_neg")).alias("fpr"),
                        ratio(tp, tp + fp).alias("precision"))


def metric_columns(auc_sum: Column, ap_sum: Column) -> list[tuple[str, Column]]:
    """All metrics from tp, tn, fp, fn and the two rank sums."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n_pos, n_neg, n = tp + fn, tn + fp, tp + tn + fp + fn
    both = (n_pos > 0) & (n_neg > 0)

    def defined(condition: Column, value: Column) -> Column:
        return F.when(condition, value)

    sens, spec = ratio(tp, n_pos), ratio(tn, n_neg)
    f1_pos = defined(n_pos > 0, ratio(2 * tp, 2 * tp + fp + fn))
    f1_neg = defined(n_neg > 0, ratio(2 * tn, 2 * tn + fp + fn))
    observed = ratio(tp + tn, n)
    expected = ratio(n_pos * (tp + fp) + n_neg * (tn + fn), n * n)
    spread = F.sqrt(tp + fp) * F.sqrt(tn + fn) * F.sqrt(n_pos) * F.sqrt(n_neg)
    # Both classes in truth but one in the predictions is 0 and not undefined.
    mcc = F.when(spread == 0, 0.0).otherwise(F.try_divide(tp * tn - fp * fn, spread))
    return [("accuracy", observed), ("balanced_accuracy", defined(both, (sens + spec) / 2)),
            ("sensitivity", sens), ("specificity", spec),
            ("precision", ratio(tp, tp + fp)), ("npv", ratio(tn, tn + fn)),
            ("f1_pos", f1_pos), ("f1_neg", f1_neg), ("macro_f1", defined(both, (f1_pos + f1_neg) / 2)),
            ("kappa", defined(both, ratio(observed - expected, 1 - expected))), ("mcc", defined(both, mcc)),
            ("roc_auc", defined(both, ratio(auc_sum, n_pos * n_neg))),
            ("average_precision", defined(both, ap_sum))]


def metrics_from_ranks(ranks: DataFrame, by: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """One row of counts and metrics per key from ``score_ranks``."""
    hit = F.col("prob") >= F.lit(threshold)
    pos, neg = F.col("n_pos"), F.col("n_neg")
    below = F.col("before_n_neg").cast("double") + neg / F.lit(2.0)
    reached_pos = F.col("total_n_pos") - F.col("before_n_pos")
    reached_neg = F.col("total_n_neg") - F.col("before_n_neg")
    step = ratio(pos, F.col("total_n_pos")) * ratio(reached_pos, reached_pos + reached_neg)

    def total(condition: Column, column: Column) -> Column:
        return F.sum(F.when(condition, column).otherwise(F.lit(0)))

    base = ranks.groupBy(*by).agg(
        F.sum(pos + neg).alias("n"), F.sum(pos).alias("n_pos"), F.sum(neg).alias("n_neg"),
        total(hit, pos).alias("tp"), total(~hit, neg).alias("tn"),
        total(hit, neg).alias("fp"), total(~hit, pos).alias("fn"),
        F.sum(pos * below).alias("_auc"), F.sum(step).alias("_ap"))
    single = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    named = [c.alias(name) for name, c in metric_columns(F.col("_auc"), F.col("_ap"))]
    return base.select(*by, "n", "n_pos", "n_neg", single.alias("single_class"), "tp", "tn", "fp", "fn", *named)


def per_unit_metrics(predictions: DataFrame, unit: str = "unit", extra: Sequence[str] = (),
                     threshold: float = THRESHOLD) -> DataFrame:
    """Metrics per test unit; ``extra`` are fold-level columns, which must be constant within a unit."""
    table = metrics_from_ranks(score_ranks(refuse_empty(stage(score_counts(predictions, [unit]))), [unit]), [unit], threshold)
    if not extra:
        return table
    # min and max run as partial aggregates, unlike a set of all values.
    carried = predictions.groupBy(unit).agg(*[
        F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c))
        .otherwise(F.raise_error(f"column {c} differs within a unit")).alias(c) for c in extra])
    return table.join(carried, unit)


def pooled_metrics(predictions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same metrics over all predictions at once."""
    return metrics_from_ranks(score_ranks(refuse_empty(stage(score_counts(predictions)))), (), threshold)


def aggregate_metrics(table: DataFrame, metrics: Sequence[str] = FOLD_METRICS, weight: str = "n",
                      by: Sequence[str] = ()) -> DataFrame:
    """Per metric over the folds that define it: mean, sd, median, quartiles, IQR and weighted mean."""
    long = table.select(*by, weight, *metrics).unpivot([*by, weight], list(metrics), "metric", "value")
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    keys = [*by, "metric"]
    weighted = F.when(F.col("value").isNotNull(), F.col(weight).cast("double"))
    moments = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.count("value").alias("n_defined"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.try_divide(F.sum(F.col("value") * weighted), F.sum(weighted)).alias("weighted_mean"))
    quartiles = exact_percentiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    return (moments.join(quartiles, keys, "left").withColumn("iqr", F.col("q3") - F.col("q1"))
            .select(*keys, "n_folds", "n_defined", "mean", "sd", "median", "q1", "q3", "iqr", "weighted_mean"))


def summarize_folds(table: DataFrame, metrics: Sequence[str] = FOLD_METRICS, weight: str = "n") -> DataFrame:
    """Aggregates over all folds and over the folds whose test set holds both classes, in one pass."""
    scopes = F.when(F.col("single_class"), F.array(F.lit("all_folds"))).otherwise(
        F.array(F.lit("all_folds"), F.lit("both_class_folds")))
    return aggregate_metrics(table.withColumn("scope", F.explode(scopes)), metrics, weight, ["scope"])


def evaluation_report(predictions: DataFrame, unit: str = "unit", extra: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Per-unit table, summaries and pooled metrics from one scan of the predictions, and a second one for ``extra``."""
    counts = refuse_empty(stage(score_counts(predictions, [unit])))
    per_unit = stage(metrics_from_ranks(score_ranks(counts, [unit]), [unit]))
    pooled = counts.groupBy("prob").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
    table = per_unit
    if extra:
        carried = predictions.groupBy(unit).agg(*[
            F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c))
            .otherwise(F.raise_error(f"column {c} differs within a unit")).alias(c) for c in extra])
        table = per_unit.join(carried, unit)
    summary = summarize_folds(per_unit)
    return {"fold_metrics": table,
            "fold_summary_all": summary.where("scope = 'all_folds'").drop("scope"),
            "fold_summary_both_classes": summary.where("scope = 'both_class_folds'").drop("scope"),
            "pooled": metrics_from_ranks(score_ranks(pooled))}


def cv_summary(scores: DataFrame) -> DataFrame:
    """Per task: mean and spread over the folds beside the holdout score.

    ``scores(task, n_classes, fit_kind, score)`` with ``fit_kind`` in ``cv``/``holdout``.
    """
    cv = F.when(F.col("fit_kind") == "cv", F.col("score"))
    return scores.groupBy("task", "n_classes").agg(
        F.count(cv).alias("n_fits"), F.avg(cv).alias("cv_mean"), F.stddev_samp(cv).alias("cv_sd"),
        F.avg(F.when(F.col("fit_kind") == "holdout", F.col("score"))).alias("holdout_score"))


def cv_range(summary: DataFrame) -> DataFrame:
    """Lowest and highest mean score per number of classes."""
    return summary.groupBy("n_classes").agg(F.count(F.lit(1)).alias("n_tasks"), F.min("cv_mean").alias("lowest"),
                                            F.max("cv_mean").alias("highest"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Per fit the first epoch that reached the top score; NaN and missing scores never win. ``history(fit, epoch, score)``."""
    top = F.max(F.when(finite_or_null("score").isNotNull(), F.struct(F.col("score"), (-F.col("epoch")).alias("back"))))
    return history.groupBy("fit").agg(top.alias("_t"), F.max("epoch").alias("last_epoch")).select(
        "fit", (-F.col("_t.back")).alias("best_epoch"), F.col("_t.score").alias("best_score"), "last_epoch")


def early_share(best: DataFrame, epochs: int = 4) -> DataFrame:
    """How many fits never improved after the first ``epochs`` epochs."""
    early = F.count_if(F.col("best_epoch") <= epochs)
    return best.agg(F.count(F.lit(1)).alias("n_fits"), early.alias("n_early"),
                    ratio(early, F.count(F.lit(1))).alias("early_share"))
