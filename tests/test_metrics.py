import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldloom.operators import metrics as me
from foldloom.operators import multiclass as mc


def frame(spark, units):
    rows = [(u, int(t), float(p)) for u, (truth, prob) in units.items() for t, p in zip(truth, prob)]
    return spark.createDataFrame(rows, "unit string, target int, prob double").repartition(5)


def brute(truth, prob):
    """Twin by definition: all pairs for AUC, every threshold for average precision."""
    truth, prob = np.asarray(truth), np.asarray(prob)
    pred = prob >= 0.5
    tp, tn = int((pred & (truth == 1)).sum()), int((~pred & (truth == 0)).sum())
    fp, fn = int((pred & (truth == 0)).sum()), int((~pred & (truth == 1)).sum())
    pos, neg = prob[truth == 1], prob[truth == 0]
    out = {"tp": tp, "tn": tn, "fp": fp, "fn": fn, "accuracy": (tp + tn) / len(truth)}
    if len(pos) and len(neg):
        out["roc_auc"] = float(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
        steps = sorted(set(prob), reverse=True)
        recall = [0.0] + [float((pos >= s).mean()) for s in steps]
        out["average_precision"] = sum((recall[i + 1] - recall[i]) * (truth[prob >= s] == 1).mean() for i, s in enumerate(steps))
        po, n = (tp + tn) / len(truth), len(truth)
        pe = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / n**2
        out["kappa"] = (po - pe) / (1 - pe)
        den = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        out["mcc"] = (tp * tn - fp * fn) / den if den else 0.0
    return out


def test_metrics_match_definitions(spark):
    rng = np.random.default_rng(3)
    units = {}
    for name, n, digits in (("a", 200, 1), ("b", 31, 3), ("hot", 600, 2), ("one", 9, 0)):
        truth = rng.integers(0, 2, n)
        units[name] = (truth, np.round(rng.beta(2 + truth, 3 - truth), digits))
    df = frame(spark, units)
    got = {r["unit"]: r for r in me.per_unit_metrics(df).collect()}
    for name, (truth, prob) in units.items():
        for key, value in brute(truth, prob).items():
            assert got[name][key] == pytest.approx(value), (name, key)
    pooled = me.pooled_metrics(df).first()
    everything = [np.concatenate([u[i] for u in units.values()]) for i in (0, 1)]
    for key, value in brute(*everything).items():
        assert pooled[key] == pytest.approx(value), key
    flat = {r["unit"]: (r["tp"], r["tn"], r["fp"], r["fn"]) for r in me.confusion(df, ["unit"]).collect()}
    assert flat == {u: (got[u]["tp"], got[u]["tn"], got[u]["fp"], got[u]["fn"]) for u in units}


def test_single_class_units_are_undefined_not_wrong(spark):
    df = frame(spark, {"neg": (np.zeros(40), np.linspace(0, 0.6, 40)), "pos": (np.ones(10), np.linspace(0.3, 0.9, 10))})
    got = {r["unit"]: r for r in me.per_unit_metrics(df).collect()}
    for key in ("sensitivity", "f1_pos", "balanced_accuracy", "macro_f1", "kappa", "mcc", "roc_auc", "average_precision"):
        assert got["neg"][key] is None
    assert got["neg"]["specificity"] == got["neg"]["accuracy"] and got["neg"]["single_class"]
    assert got["pos"]["specificity"] is None and got["pos"]["f1_neg"] is None
    assert got["pos"]["npv"] == 0.0 and got["pos"]["sensitivity"] == got["pos"]["accuracy"]


def test_threshold_counts_half_as_positive(spark):
    row = me.pooled_metrics(frame(spark, {"u": ([0, 1], [0.5, 0.5])})).first()
    assert (row["tp"], row["fp"], row["mcc"], row["kappa"]) == (1, 1, 0.0, 0.0)


@pytest.mark.parametrize("target,prob", [(0, float("nan")), (0, float("inf")), (2, 0.5)])
def test_invalid_predictions_fail(spark, target, prob):
    df = spark.createDataFrame([("u", target, prob), ("u", 1, 0.5)], "unit string, target int, prob double")
    with pytest.raises(Exception, match="finite score"):
        me.pooled_metrics(df).collect()


def test_aggregate_golden_values(spark):
    table = spark.createDataFrame([(10, False, 0.6, 0.5), (30, False, 0.8, 0.7), (20, False, 1.0, 0.9), (40, True, None, 1.0)],
                                  "n int, single_class boolean, roc_auc double, accuracy double")
    got = {(r["scope"], r["metric"]): r for r in me.summarize_folds(table, ["roc_auc", "accuracy"]).collect()}
    r = got[("all_folds", "roc_auc")]
    assert (r["n_defined"], r["n_folds"]) == (3, 4)
    for key, value in dict(mean=0.8, sd=0.2, median=0.8, iqr=0.2, weighted_mean=50 / 60).items():
        assert r[key] == pytest.approx(value)
    assert got[("all_folds", "accuracy")]["weighted_mean"] == pytest.approx(0.84)
    assert got[("both_class_folds", "accuracy")]["n_folds"] == 3
    lone = me.aggregate_metrics(table.limit(1), ["roc_auc"]).first()
    assert lone["sd"] is None and lone["mean"] == pytest.approx(0.6)
    none = me.aggregate_metrics(table.where("n = 40"), ["roc_auc"]).first()
    assert none["n_defined"] == 0 and none["mean"] is None and none["median"] is None


def test_report_and_carried_columns(spark):
    rng = np.random.default_rng(1)
    units = {u: (np.r_[np.zeros(a), np.ones(b)], rng.uniform(0, 1, a + b)) for u, (a, b) in
             {"chb01": (10, 10), "chb07": (12, 0), "chb09": (5, 7)}.items()}
    from pyspark.sql import functions as F
    df = frame(spark, units).withColumn("val_group", F.concat(F.lit("v"), "unit"))
    report = me.evaluation_report(df, "unit", ["val_group"])
    folds = {r["unit"]: r for r in report["fold_metrics"].collect()}
    assert folds["chb07"]["single_class"] and folds["chb07"]["roc_auc"] is None and folds["chb09"]["val_group"] == "vchb09"
    every = {r["metric"]: r for r in report["fold_summary_all"].collect()}
    assert (every["roc_auc"]["n_defined"], every["accuracy"]["n_defined"]) == (2, 3)
    both = {r["metric"]: r for r in report["fold_summary_both_classes"].collect()}
    assert both["accuracy"]["n_folds"] == 2
    assert report["pooled"].first() == me.pooled_metrics(df).first()
    mixed = df.withColumn("val_group", F.col("prob").cast("string"))
    with pytest.raises(Exception, match="differs within a unit"):
        me.per_unit_metrics(mixed, "unit", ["val_group"]).collect()


def test_best_epoch_takes_the_first_top(spark):
    rows = [("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9), ("b", 1, 0.1), ("b", 7, 0.4)]
    best = me.best_epoch(spark.createDataFrame(rows, "fit string, epoch int, score double"))
    assert {r["fit"]: (r["best_epoch"], r["last_epoch"]) for r in best.collect()} == {"a": (2, 3), "b": (7, 7)}
    assert me.early_share(best).first()["early_share"] == 0.5


def test_cv_summary(spark):
    rows = [("t", 2, "cv", 0.5), ("t", 2, "cv", 0.7), ("t", 2, "holdout", 0.4), ("s", 3, "cv", 0.9)]
    summary = me.cv_summary(spark.createDataFrame(rows, "task string, n_classes int, fit_kind string, score double"))
    got = {r["task"]: r for r in summary.collect()}
    assert got["t"]["cv_mean"] == pytest.approx(0.6) and got["t"]["holdout_score"] == 0.4 and got["s"]["cv_sd"] is None
    assert {r["n_classes"]: r["highest"] for r in me.cv_range(summary).collect()} == {2: pytest.approx(0.6), 3: 0.9}


def test_multiclass_by_definition(spark):
    rng = np.random.default_rng(5)
    truth, pred = rng.integers(0, 4, 300), rng.integers(0, 5, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(truth, pred)], "truth int, pred int")
    row = mc.multiclass_metrics(mc.confusion_counts(df)).first()
    labels = sorted(set(truth) | set(pred))
    rec = [np.mean(pred[truth == c] == c) if (truth == c).any() else 0.0 for c in labels]
    pre = [np.mean(truth[pred == c] == c) if (pred == c).any() else 0.0 for c in labels]
    f1 = [2 * p * r / (p + r) if p + r else 0.0 for p, r in zip(pre, rec)]
    spec = [np.mean(pred[truth != c] != c) for c in labels]
    t, p = np.array([(truth == c).sum() for c in labels]), np.array([(pred == c).sum() for c in labels])
    n, hit = 300, (truth == pred).sum()
    assert row["accuracy"] == pytest.approx(hit / n)
    assert row["balanced_accuracy"] == pytest.approx(np.mean(rec[:4]))
    assert row["macro_precision"] == pytest.approx(np.mean(pre)) and row["macro_recall"] == pytest.approx(np.mean(rec))
    assert row["macro_f1"] == pytest.approx(np.mean(f1)) and row["weighted_f1"] == pytest.approx((np.array(f1) * t).sum() / n)
    assert row["macro_specificity"] == pytest.approx(np.mean(spec))
    pe = (t * p).sum() / n**2
    assert row["kappa"] == pytest.approx((hit / n - pe) / (1 - pe))
    assert row["mcc"] == pytest.approx((hit * n - (t * p).sum()) / math.sqrt((n**2 - (p**2).sum()) * (n**2 - (t**2).sum())))
    per_task = df.withColumn("task", df["truth"] % 2)
    assert mc.multiclass_metrics(mc.confusion_counts(per_task, ["task"]), ["task"]).count() == 2


def test_one_vs_rest(spark):
    rng = np.random.default_rng(6)
    truth, probs = rng.integers(0, 3, 80), np.round(rng.uniform(size=(80, 3)), 1)
    df = spark.createDataFrame([(int(a), [float(v) for v in p]) for a, p in zip(truth, probs)], "truth int, probs array<double>")
    per = mc.one_vs_rest_auc(df)
    got = {r["klass"]: r["roc_auc"] for r in per.collect()}
    for c in range(3):
        assert got[c] == pytest.approx(brute((truth == c).astype(int), probs[:, c])["roc_auc"])
    assert mc.macro_auc(per).first()["macro_auc"] == pytest.approx(np.mean(list(got.values())))


def test_wrong_or_no_predictions_raise(spark):
    good = frame(spark, {"a": ([0, 1], [0.2, 0.7])})
    for empty in (me.pooled_metrics, me.confusion, me.per_unit_metrics, me.evaluation_report):
        with pytest.raises(ValueError, match="no predictions"):
            empty(good.limit(0))
    for column, value in (("target", 2), ("target", None), ("prob", float("nan")), ("prob", None)):
        with pytest.raises(Exception, match="finite score"):
            me.confusion(good.withColumn(column, F.lit(value).cast(good.schema[column].dataType))).collect()


def test_best_epoch_passes_over_undefined_scores(spark):
    rows = [("a", 1, 0.5), ("a", 2, float("nan")), ("a", 3, 0.7), ("a", 4, 0.7), ("a", 5, None), ("b", 1, float("nan")), ("c", 1, float("inf")), ("c", 2, 0.1)]
    got = {r["fit"]: (r["best_epoch"], r["best_score"], r["last_epoch"]) for r in me.best_epoch(spark.createDataFrame(rows, "fit string, epoch int, score double")).collect()}
    assert got == {"a": (3, 0.7, 5), "b": (None, None, 1), "c": (2, 0.1, 2)}
