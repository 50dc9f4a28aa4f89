from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldloom.operators import stratified as st


def recordings(spark, per_set=100, sets="ZONFS"):
    rows = [(f"{s}{i:03d}", s) for s in sets for i in range(per_set)]
    return spark.createDataFrame(rows, "record_id string, set_id string")


def test_task_list(spark):
    tasks = st.preset_tasks(spark)
    rows = st.order_tasks(st.task_catalog(tasks)).collect()
    assert [r["n_classes"] for r in rows] == [5] + [4] * 5 + [3] * 11 + [2] * 15
    assert [r["rank"] for r in rows] == list(range(1, 33))
    assert rows[0]["task_id"] == "Z_vs_O_vs_N_vs_F_vs_S" and rows[-1]["task_id"] == "Z+O_vs_N+F+S"
    assert rows[0]["n_recordings"] == 500 and len({r["task_id"] for r in rows}) == 32
    targets = {(r["set_id"], r["target"]) for r in st.task_targets(tasks).where("task_id = 'Z+O_vs_N+F_vs_S'").collect()}
    assert targets == {("Z", 0), ("O", 0), ("N", 1), ("F", 1), ("S", 2)}


def test_kfold_is_balanced_and_reproducible(spark):
    df = recordings(spark, 57).where("record_id <> 'Z000'")
    a = {r["record_id"]: r["test_fold"] for r in st.stratified_kfold(df).collect()}
    b = {r["record_id"]: r["test_fold"] for r in st.stratified_kfold(df.orderBy(F.rand(1)).repartition(9)).collect()}
    assert a == b and set(a.values()) == set(range(1, 11))
    for r in st.fold_balance(st.stratified_kfold(df)).collect():
        assert r["largest_fold"] - r["smallest_fold"] <= 1
    whole = Counter(a.values())
    assert max(whole.values()) - min(whole.values()) <= 1
    spread = st.stratified_kfold(recordings(spark, 3, "ABCDEFGHIJKLMNOPQRST"))
    assert set(Counter(r["test_fold"] for r in spread.collect()).values()) == {6}
    few = st.fold_balance(st.stratified_kfold(df.where("record_id = 'O001'"))).first()
    assert (few["smallest_fold"], few["largest_fold"]) == (0, 1)


def test_all_fits_of_all_tasks(spark):
    plan = st.plan_tasks(st.preset_tasks(spark), recordings(spark))
    assert plan.select("task_id", "fit").distinct().count() == 352
    assert st.incomplete_tasks(plan).count() == 0
    assert st.incomplete_tasks(plan.where("NOT (task_id = 'Z_vs_O' AND fit = 'cv_fold_03')")).first()[:] == ("Z_vs_O", 10)
    with pytest.raises(st.SplitError, match="fits"):
        st.plan_tasks(st.preset_tasks(spark), recordings(spark, 1, "ZO"))
    one = plan.where("task_id = 'Z+O_vs_S'").collect()
    parts = {}
    for r in one:
        parts.setdefault((r["fit"], r["seed"]), {}).setdefault(r["part"], []).append(r)
    assert {k[1] for k in parts} == {43 + i for i in range(10)} | {1042}
    for (fit, _), split in parts.items():
        ids = [r["record_id"] for rows in split.values() for r in rows]
        assert len(ids) == len(set(ids)) == 300
        share = {p: Counter(r["set_id"] for r in rows) for p, rows in split.items()}
        expected = {"test": 30, "val": 11, "train": 59} if fit == "holdout_70_30" else {"test": 10, "val": 14, "train": 76}
        for part, n in expected.items():
            assert all(abs(share[part][s] - n) <= 1 for s in "ZOS")
    tested = Counter(r["record_id"] for r in one if r["part"] == "test" and r["fit"].startswith("cv"))
    assert set(tested.values()) == {1} and len(tested) == 300
