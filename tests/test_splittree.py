"""Split plans as digest trees: composed digests against digests of all rows, and the descent through stored trees."""

import re

from pyspark.sql import functions as F

from foldloom.operators import fingerprints as fp
from foldloom.operators import splittree as tr
from foldloom.operators import stratified as st
from foldloom.plans.stage import stage

TASKS = ("Z_vs_O", "Z+O_vs_S", "O_vs_S")
SF_DIR = "/root/testdata/sf0.001"


def plan(spark):
    rows = spark.createDataFrame([(f"{s}{i}", s) for s in "ZOS" for i in range(20)], "record_id string, set_id string")
    return stage(st.planned_fits(rows)), st.task_targets(st.preset_tasks(spark, TASKS))


def edits(fits):
    """Edited plans: moved within a fit, moved to another stratum, another seed, a lost and a repeated record."""
    own = (F.col("fit") == "cv_fold_02") & (F.col("record_id") == "Z3")
    return {
        "part": fits.withColumn("part", F.when(own, "other").otherwise(F.col("part"))),
        "stratum": fits.withColumn("set_id", F.when(own, "O").otherwise(F.col("set_id"))),
        "seed": fits.withColumn("seed", F.when(F.col("fit") == "cv_fold_04", F.col("seed") + 7).otherwise(F.col("seed"))),
        "lost": fits.where(~own), "repeated": fits.unionByName(fits.where(own))}


def test_composed_digests_differ_where_those_of_all_rows_do(spark):
    fits, targets = plan(spark)

    def both(rows, goals):
        whole = fp.split_digests(rows.join(goals, "set_id"))
        composed = tr.composed_split_digests(rows, goals)
        return [{tuple(r[c] for c in ("task_id", "fit") if c in r): r["digest"] for r in d[level].collect()} for d in (whole, composed) for level in ("fit", "task")]

    base = both(fits, targets)
    other_goals = targets.withColumn("target", F.when(F.col("task_id") == "O_vs_S", 1 - F.col("target")).otherwise(F.col("target")))
    renamed = fits.withColumn("set_id", F.concat("set_id", F.lit("1"))), targets.withColumn("set_id", F.concat("set_id", F.lit("1")))
    seen = set()
    for name, (rows, goals) in ({k: (v, targets) for k, v in edits(fits).items()} | {"targets": (fits, other_goals), "names": renamed}).items():
        now = both(rows, goals)
        changed = [{k for k in b if b[k] != n.get(k)} for b, n in zip(base, now, strict=True)]
        assert changed[0] == changed[2] and changed[1] == changed[3], name
        seen.add((name, len(changed[0])))
    # Z3 as a record of O is the same row of Z+O_vs_S, and leaves Z_vs_O changed and O_vs_S changed.
    assert seen == {("part", 2), ("stratum", 2), ("seed", 3), ("lost", 2), ("repeated", 2), ("targets", 11), ("names", 0)}


def stored(spark, tmp_path, name, rows, goals):
    tr.write_split_tree(rows, goals, str(tmp_path / name))
    return tr.read_split_tree(spark, str(tmp_path / name))


def test_descent_names_fits_and_records(spark, tmp_path):
    fits, targets = plan(spark)
    mine = stored(spark, tmp_path, "mine", fits, targets)
    assert tr.tree_digests(mine)["plan"].first() == tr.composed_split_digests(fits, targets)["plan"].first()
    assert tr.differing_fits(mine, mine).count() == 0
    old = fits.where("fit = 'cv_fold_02' AND record_id = 'Z3'").first()["part"]
    part = [(t, "cv_fold_02", "both", False, False, 1, "Z3") for t in ("Z+O_vs_S", "Z_vs_O")]
    expected = {
        "part": (part, [("cv_fold_02", "Z3", "Z", old, "Z", "other")]), "repeated": (part, [("cv_fold_02", "Z3", "Z", old, "Z", old)]),
        "lost": (part, [("cv_fold_02", "Z3", "Z", old, None, None)]), "seed": (sorted((t, "cv_fold_04", "both", True, False, 0, "") for t in TASKS), []),
        "stratum": ([(t, "cv_fold_02", "both", False, False, 1, "Z3") for t in ("O_vs_S", "Z_vs_O")], [("cv_fold_02", "Z3", "Z", old, "O", old)])}
    for name, rows in edits(fits).items():
        other = stored(spark, tmp_path, name, rows, targets)
        fit_rows, places = expected[name]
        assert sorted(tuple(r) for r in tr.differing_fits(mine, other).collect()) == fit_rows, name
        assert [tuple(r) for r in tr.differing_records(mine, other).collect()] == places, name
    fewer = stored(spark, tmp_path, "fewer", fits.where("fit <> 'holdout_70_30'"), targets.where("task_id <> 'O_vs_S'"))
    lone = {(r["task_id"], r["fit"]): r["side"] for r in tr.differing_fits(mine, fewer).collect()}
    assert len(lone) == 13 and set(lone.values()) == {"only_left"} and ("Z_vs_O", "holdout_70_30") in lone


def test_equal_branches_are_not_read(spark, tmp_path):
    """Only the folders of the differing fit and part are scanned, on every level."""
    fits, targets = plan(spark)
    mine = stored(spark, tmp_path, "mine", fits, targets)
    differing = spark.createDataFrame([("cv_fold_02", "train", "Z")], "fit string, part string, set_id string")
    for level in ("buckets", "members"):
        rows = tr.branches(mine[level], differing, tr.BRANCH)
        text = rows._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*fit#\d+ = cv_fold_02[^\]]*part#\d+ = train", text), text
        assert {(r["fit"], r["part"], r["set_id"]) for r in rows.collect()} == {("cv_fold_02", "train", "Z")}


def test_members_hashed_once_per_target_give_the_digests_of_all_rows(spark):
    """Also for a record that is repeated, or in two sets of one target; the whole line of each member counts."""
    fits, targets = plan(spark)
    own = (F.col("fit") == "cv_fold_02") & (F.col("record_id") == "Z3")
    variants = edits(fits) | {"as planned": fits, "two sets": fits.unionByName(fits.where(own).withColumn("set_id", F.lit("O"))), "empty fit": fits.where("fit <> 'cv_fold_07'")}
    for name, rows in variants.items():
        whole, planned = fp.split_digests(rows.join(targets, "set_id")), fp.planned_split_digests(rows, targets)
        for level in ("fit", "task", "plan"):
            columns = whole[level].columns
            assert sorted(map(tuple, planned[level].select(*columns).collect())) == sorted(map(tuple, whole[level].collect())), (name, level)


def test_query_digests_the_lines_of_all_members(spark):
    from foldloom.queries import digests as qd
    from foldloom.queries.views import vectors

    whole = fp.split_digests(st.plan_tasks(st.preset_tasks(spark), vectors(spark, SF_DIR)))
    wanted = [tuple(r) for r in whole["task"].select("task_id", "n_lines", "digest").collect()] + [("<all>", *whole["plan"].first())]
    assert sorted(map(tuple, qd.split_digests(spark, SF_DIR).collect())) == sorted(wanted)


def test_comparison_makes_no_row_per_task_and_record(spark, monkeypatch):
    """What meets in a tree by task are digests of fits, at most 11 a task."""
    from foldloom.queries import digests as qd

    seen, plain = [], fp.tree_digest
    monkeypatch.setattr(fp, "tree_digest", lambda df, *rest: seen.append(df.count()) or plain(df, *rest))
    row = qd.split_comparison(spark, SF_DIR).first()
    assert (row["n_common"], row["n_differing"], row["n_only_left"], row["n_only_right"]) == (12, 8, 20, 0)
    assert seen and max(seen) <= 11 * len(st.PRESET_TASKS)
