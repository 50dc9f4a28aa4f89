"""Metrics over more than two classes from one confusion count table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.operators.metrics import metrics_from_ranks, score_counts, score_ranks


def confusion_counts(predictions: DataFrame, by: Sequence[str] = (), truth: str = "truth",
                     pred: str = "pred") -> DataFrame:
    return predictions.groupBy(*by, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, classes: Sequence, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Truth by predicted class, one column ``pred_<class>`` each."""
    wide = predictions.groupBy(truth).pivot(pred, list(classes)).count().na.fill(0)
    return wide.select(truth, *[F.col(str(c)).alias(f"pred_{c}") for c in classes])


def class_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support, predicted, hits and rates. A zero denominator counts as 0."""
    sides = F.array(F.struct(F.col("truth").alias("klass"), F.col("n").alias("support"), F.lit(0).alias("predicted")),
                    F.struct(F.col("pred").alias("klass"), F.lit(0).alias("support"), F.col("n").alias("predicted")))
    # The hit is counted on the truth side only.
    hit = F.when((F.col("truth") == F.col("pred")) & (F.col("_s.support") > 0), F.col("n")).otherwise(F.lit(0))
    rows = counts.withColumn("_s", F.explode(sides)).select(
        *by, F.col("_s.klass").alias("klass"), F.col("_s.support").alias("support"),
        F.col("_s.predicted").alias("predicted"), hit.alias("hits"))
    sums = rows.groupBy(*by, "klass").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n_total"))
    joined = sums.join(totals, list(by)) if by else sums.withColumn("n_total", totals.scalar())

    def zero(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, t, p, n = (F.col(c) for c in ("hits", "support", "predicted", "n_total"))
    return joined.withColumns({
        "sensitivity": zero(tp, t), "specificity": zero(n - t - p + tp, n - t),
        "precision": zero(tp, p), "f1": zero(2 * tp, t + p)})


def multiclass_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted scores, kappa and MCC.

    Macro scores run over the classes seen in truth or prediction; balanced accuracy over those in truth.
    """
    rows = class_metrics(counts, by)
    tp, t, p = (F.col(c).cast("double") for c in ("hits", "support", "predicted"))
    sums = rows.groupBy(*by).agg(
        F.max("n_total").alias("n"), F.count_if(F.col("support") > 0).alias("n_classes"), F.sum(tp).alias("_c"),
        F.sum(t * p).alias("_tp"), F.sum(t * t).alias("_tt"), F.sum(p * p).alias("_pp"),
        F.avg(F.when(F.col("support") > 0, F.col("sensitivity"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("sensitivity").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * t).alias("_wf1"),
        F.avg("specificity").alias("macro_specificity"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * n - F.col("_pp")) * F.sqrt(n * n - F.col("_tt"))
    mcc = F.when(spread == 0, 0.0).otherwise(F.try_divide(F.col("_c") * n - F.col("_tp"), spread))
    expected = F.col("_tp") / (n * n)
    return sums.select(
        *by, "n", "n_classes", (F.col("_c") / n).alias("accuracy"), "balanced_accuracy", "macro_precision",
        "macro_recall", "macro_f1", (F.col("_wf1") / n).alias("weighted_f1"),
        F.try_divide(F.col("_c") / n - expected, 1 - expected).alias("kappa"), mcc.alias("mcc"), "macro_specificity")


def one_vs_rest_auc(predictions: DataFrame, by: Sequence[str] = (), truth: str = "truth",
                    probs: str = "probs") -> DataFrame:
    """ROC AUC of every class against the rest; ``probs[i]`` scores class ``i``."""
    rows = predictions.select(*by, truth, F.posexplode(probs).alias("klass", "prob")).select(
        *by, "klass", "prob", (F.col(truth) == F.col("klass")).cast("int").alias("target"))
    keys = [*by, "klass"]
    return metrics_from_ranks(score_ranks(score_counts(rows, keys), keys), keys).select(
        *keys, "n_pos", "n_neg", "roc_auc")


def macro_auc(per_class: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return per_class.groupBy(*by).agg(F.count("roc_auc").alias("n_defined"), F.avg("roc_auc").alias("macro_auc"))
