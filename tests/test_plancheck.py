import pytest
from pyspark.sql import functions as F

from foldloom.operators import folds as fo
from foldloom.operators import plancheck as pc
from foldloom.operators import profile as pr
from tables import NINE, SMALL, records


@pytest.fixture(scope="module")
def base(spark):
    data = records(spark, NINE)
    folds = fo.logo_folds(pr.case_counts(data), "case")
    members = pc.stage(pc.expand_plan(data, folds))
    return data, folds, members


def broken(found):
    return {(r["rule"], r["fold"]) for r in found.collect()}


def check(base, members=None, folds=None, low=5, complete=False):
    data, heads, rows = base
    return broken(pc.check_plan(members if members is not None else rows, folds if folds is not None else heads, data, low, complete))


def test_valid_plan(base):
    assert check(base, complete=True) == set()
    data, _, members = base
    row = pc.plan_coverage(members.repartition(5), data).first()
    assert row["coverage"] == "full" and row["n_tested"] == data.count()


def test_record_and_group_leak(base):
    _, _, members = base
    leak = members.where("fold = 2 AND part = 'test'").limit(1).withColumn("part", F.lit("train"))
    assert check(base, members.unionByName(leak)) == {("record_in_two_parts", 2), ("group_in_two_parts", 2)}


def test_sibling_in_training(base):
    data, folds, members = base
    number = folds.where("test_unit = 'chb01'").first()["fold"]
    sibling = data.where("case_id = 'chb21'").select(F.lit(number).cast("bigint").alias("fold"), F.lit("train").alias("part"), "record_id")
    assert check(base, members.unionByName(sibling)) == {("group_in_two_parts", number), ("left_out", number)}


def test_partial_validation_and_repeats(base):
    _, _, members = base
    rows = members.where("fold = 1 AND part = 'val'").limit(4).select("record_id")
    half = members.join(rows.withColumn("fold", F.lit(1)).withColumn("part", F.lit("val")), ["fold", "part", "record_id"], "left_anti")
    found = check(base, half)
    assert ("val_not_group", 1) in found and ("left_out", 1) in found and {f for _, f in found} == {1}
    twice = members.where("fold = 3 AND part = 'train'").limit(2)
    assert check(base, members.unionByName(twice)) == {("repeated_id", 3)}


def test_unknown_ids_empty_parts_and_heads(base):
    _, folds, members = base
    alien = members.where("fold = 1 AND part = 'test'").limit(1).withColumn("record_id", F.lit("nobody"))
    assert check(base, members.unionByName(alien)) == {("unknown_id", 1)}
    no_train = members.where("NOT (fold = 5 AND part = 'train')")
    assert {("empty_part", 5), ("train_lacks_class", 5)} <= check(base, no_train)
    other = folds.withColumn("val_group", F.when(F.col("fold") == 1, "chb03").otherwise(F.col("val_group")))
    assert {("val_group", 1), ("val_not_group", 1)} <= check(base, folds=other)
    kind = folds.withColumn("unit_kind", F.when(F.col("fold") == 1, "person").otherwise(F.col("unit_kind")))
    assert ("unit_kind", 1) in check(base, folds=kind)


def test_minimum_per_class(base):
    found = check(base, low=100)
    assert {r for r, _ in found} == {"val_below_minimum"} and len(found) == 9


def test_completeness_rules(base):
    _, folds, members = base
    short = check(base, members.where("fold < 9"), folds.where("fold < 9"), complete=True)
    assert short == {("unit_tested_once", None), ("record_tested_once", None)}
    gap = check(base, members, folds.withColumn("fold", F.col("fold")).withColumn("seed", F.when(F.col("fold") == 2, 99).otherwise(F.col("seed"))), complete=True)
    assert gap == {("seeds", None)}
    shifted = check(base, members.withColumn("fold", F.col("fold") + 1), folds.withColumn("fold", F.col("fold") + 1).withColumn("seed", F.col("seed") + 1), complete=True)
    assert shifted == {("fold_numbers", None)}


def test_compare_with_rule(base, spark):
    data, folds, _ = base
    same = pc.compare_with_rule(folds, fo.logo_folds(pr.case_counts(data), "case")).first()
    assert same["n_differing"] == 0 and same["first_fold"] is None
    other = folds.withColumn("val_group", F.when(F.col("fold") >= 4, "chb99").otherwise(F.col("val_group")))
    row = pc.compare_with_rule(other, folds).first()
    assert (row["n_differing"], row["first_fold"], row["first_field"]) == (6, 4, "val_group")
    fewer = pc.compare_with_rule(folds.where("fold <> 2"), folds).first()
    assert (fewer["first_fold"], fewer["first_side"]) == (2, "only_right")


def test_ids(base, spark):
    data, _, members = base
    missing = pc.missing_ids(members, data.where("case_id <> 'chb06'")).where("part = 'test'").first()
    assert missing["n_missing"] == 12 and len(missing["examples"].split(", ")) == 3
    table = data.withColumn("segment_id", F.col("record_id")).withColumn("record_id", F.lit("same"))
    assert pc.resolve_id_column(table, members.select("record_id").distinct()) == "segment_id"
    assert pc.resolve_id_column(data, spark.createDataFrame([("x",)], "record_id string")) is None
    leak = members.where("fold = 2 AND part = 'test'").limit(1).withColumn("part", F.lit("train"))
    assert pc.shared_between_parts(members.unionByName(leak)).count() == 1
    assert pc.report_problems(pc.check_plan(members, fo.logo_folds(pr.case_counts(data), "case"), data, 100), 4).count() == 4


def test_group_table_inputs(spark):
    counts = {r["group_id"]: (r["n_neg"], r["n_pos"]) for r in pr.group_counts(pr.case_counts(records(spark, SMALL))).collect()}
    assert counts == {"chb01": tuple(map(sum, zip(SMALL["chb01"], SMALL["chb21"]))), "chb02": SMALL["chb02"]}


def test_empty_and_mixed_plans_are_always_wrong(spark):
    data = records(spark, NINE)
    folds = fo.logo_folds(pr.case_counts(data), "case")
    members = pc.stage(pc.expand_plan(data, folds))
    rules = lambda f, m: {r["rule"] for r in pc.check_plan(m, f, data, complete=False).collect()}
    assert rules(folds, members) == set()
    assert rules(folds.limit(0), members.limit(0)) == {"empty_plan"}
    mixed = folds.withColumn("unit_kind", F.when(F.col("test_unit") == "chb02", "group").otherwise(F.col("unit_kind")))
    assert rules(mixed, members) == {"mixed_units"}


def test_members_that_differ_from_the_rule(spark):
    data = records(spark, NINE)
    folds = fo.logo_folds(pr.case_counts(data), "case")
    members = pc.stage(pc.expand_plan(data, folds))
    assert pc.diff_members(members, data, folds).count() == 0
    moved = F.when((F.col("fold") == 3) & (F.col("part") == "test"), "val").otherwise(F.col("part"))
    got = {(r["fold"], r["part"]): (r["n_plan"], r["n_rule"]) for r in pc.diff_members(members.withColumn("part", moved), data, folds).collect()}
    assert set(got) == {(3, "test"), (3, "val")} and got[(3, "test")][0] == 0
