import pytest
from pyspark.sql import functions as F

from foldloom.operators import folds as fo
from foldloom.operators import profile as pr
from tables import BELOW_MIN, MANY, NINE, ONE_ELIGIBLE, OWNERS, SINGLE, counted, natural, records


def plan(spark, counts, unit="group", low=5, seed=42):
    cases = pr.case_counts(records(spark, counts))
    folds = fo.logo_folds(cases, unit, low, seed)
    return folds, cases


def heads(folds):
    return {r["test_unit"]: r for r in folds.collect()}


def brute(counts, unit, low):
    """Independent twin on plain Python lists: unit, group, validation group per fold."""
    groups = {}
    for case, (a, b) in counts.items():
        old = groups.get(OWNERS.get(case, case), (0, 0))
        groups[OWNERS.get(case, case)] = (old[0] + a, old[1] + b)
    ring = sorted(groups, key=natural)
    units = ring if unit == "group" else sorted(counts, key=natural)
    out = []
    for u in units:
        g = u if unit == "group" else OWNERS.get(u, u)
        at = ring.index(g)
        turn = ring[at + 1:] + ring[:at]
        out.append((u, g, next(v for v in turn if min(groups[v]) >= max(1, low))))
    return out


@pytest.mark.parametrize("counts,unit,low", [(SINGLE, "group", 5), (BELOW_MIN, "group", 5), (BELOW_MIN, "group", 4),
                                             (NINE, "group", 5), (NINE, "case", 5), (MANY, "group", 5), (MANY, "case", 5)])
def test_folds_equal_the_plain_rule(spark, counts, unit, low):
    folds, _ = plan(spark, counts, unit, low)
    rows = folds.orderBy("fold").collect()
    assert [(r["test_unit"], r["test_group"], r["val_group"]) for r in rows] == brute(counts, unit, low)
    assert [r["fold"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["seed"] for r in rows] == [42 + r["fold"] for r in rows]


def test_case_mode_leaves_out_siblings(spark):
    folds, cases = plan(spark, MANY, "case")
    listed = {}
    for r in fo.excluded_units(folds, cases).orderBy("fold", "ordinal").collect():
        listed.setdefault(r["fold"], []).append(r["excluded_unit"])
    by = heads(folds)
    assert {u: listed[by[u]["fold"]] for u in ("chb01", "chb21", "chb17a", "chb17b")} == {
        "chb01": ["chb21"], "chb21": ["chb01"], "chb17a": ["chb17b"], "chb17b": ["chb17a"]}
    assert len(listed) == 4 and by["chb21"]["val_group"] == "chb02"


def test_manifest_counts(spark):
    folds, _ = plan(spark, NINE, "case")
    rows = {r["test_unit"]: r for r in fo.fold_manifest(folds).collect()}
    n = sum(a + b for a, b in NINE.values())
    for r in rows.values():
        assert r["n_train"] + r["n_val"] + r["n_test"] + r["n_excluded"] == n
    assert rows["chb21"]["n_excluded_units"] == 1 and rows["chb21"]["n_excluded"] == sum(NINE["chb01"])
    assert rows["chb04"]["test_single_class"] and not rows["chb01"]["test_single_class"]
    assert rows["chb06"]["val_group"] == "chb17" and rows["chb06"]["n_val_cases"] == 2
    assert list(rows["chb01"].asDict()) == list(fo.MANIFEST_COLUMNS)


def test_group_of_many_cases_stays_whole(spark):
    """More cases than any cell should hold: the rows are all there, in natural order."""
    rows = spark.range(1100).select(F.lit("big").alias("group_id"), F.concat(F.lit("c"), F.col("id")).alias("case_id"), F.lit(2).cast("bigint").alias("n_neg"),
                                    F.lit(3).cast("bigint").alias("n_pos"), F.lit(0).cast("bigint").alias("n_bad"))
    cases = rows.unionByName(rows.limit(0).unionByName(spark.createDataFrame([(g, g, 9, 9, 0) for g in ("x1", "x2")], rows.schema)))
    folds = fo.logo_folds(cases, "case")
    assert folds.count() == 1102
    one = fo.excluded_units(folds.where("test_unit = 'c700'"), cases).orderBy("ordinal").collect()
    assert [r["excluded_unit"] for r in one] == [f"c{i}" for i in range(1100) if i != 700]
    assert one[700]["ordinal"] == 702 and fo.excluded_units(folds, cases).count() == 1100 * 1099
    assert fo.fold_manifest(folds).where("n_excluded_units = 1099").count() == 1100
    table = {r["group_id"]: r["n_cases"] for r in pr.group_table(cases).collect()}
    assert table == {"big": 1100, "x1": 1, "x2": 1} and pr.group_cases(cases).count() == 1102


def test_roles_of_more_folds_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(fo, "BLOCK_FOLDS", 7)
    data = records(spark, counted([f"c{i}" for i in range(40)]))
    folds = fo.logo_folds(pr.case_counts(data))
    got = fo.fold_roles(data, folds).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {(r["fold"], r["role"]): r["n"] for r in got}
    for r in folds.collect():
        assert sizes[(r["fold"], "test")] == r["n_test_neg"] + r["n_test_pos"] and sizes[(r["fold"], "train")] == r["n_train_neg"] + r["n_train_pos"]


@pytest.mark.parametrize("column,value,rule", [
    ("group_id", "NULL", "blank_group"), ("case_id", "' '", "blank_case"), ("label", "2", "label_outside_domain"), ("label", "NULL", "label_outside_domain"),
    ("group_id", "'chb03'", "case_with_several_groups")])
def test_invalid_records_are_refused(spark, column, value, rule):
    data = records(spark, NINE).withColumn(column, F.when(F.col("record_id").endswith("chb01-1.csv"), F.expr(value)).otherwise(F.col(column)))
    assert rule in {r["rule"] for r in fo.input_violations(data).collect()}
    with pytest.raises(fo.FoldPlanError, match=rule):
        fo.logo_folds(pr.case_counts(data))


def test_repeated_ids_and_empty_input(spark):
    data = records(spark, SINGLE)
    assert fo.input_violations(data).count() == 0
    assert {tuple(r) for r in fo.input_violations(data.unionByName(data.limit(2))).collect()} == {("repeated_record_id", 2)}
    assert fo.input_violations(data.limit(0)).first()["rule"] == "no_records"
    with pytest.raises(fo.FoldPlanError, match="no_records"):
        fo.logo_folds(pr.case_counts(data.limit(0)))


def test_two_groups_leave_nothing_to_train_on(spark):
    with pytest.raises(fo.FoldPlanError, match="training"):
        plan(spark, counted(["chb01", "chb02"]))


def test_too_few_eligible_groups(spark):
    with pytest.raises(fo.FoldPlanError):
        plan(spark, ONE_ELIGIBLE)
    with pytest.raises(fo.FoldPlanError):
        plan(spark, NINE, "person")


def test_selection_keeps_numbers_and_seeds(spark):
    folds, _ = plan(spark, MANY)
    got = fo.select_folds(folds, ["chb09", "chb02"]).orderBy("fold").collect()
    assert [(r["test_unit"], r["fold"], r["seed"]) for r in got] == [("chb02", 2, 44), ("chb09", 9, 51)]
    assert fo.select_folds(folds, []).count() == folds.count()
    for bad in (["chb21"], ["chb02", "chb02"]):
        with pytest.raises(fo.FoldPlanError):
            fo.select_folds(folds, bad)


def test_roles_agree_with_counts(spark):
    folds, _ = plan(spark, NINE, "case")
    data = records(spark, NINE).repartition(5)
    roles = fo.fold_roles(data, folds)
    seen = {(r["fold"], r["role"]): r["n"] for r in roles.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in folds.collect():
        assert seen[(r["fold"], "test")] == r["n_test_neg"] + r["n_test_pos"]
        assert seen[(r["fold"], "validation")] == r["n_val_neg"] + r["n_val_pos"]
        assert seen[(r["fold"], "train")] == r["n_train_neg"] + r["n_train_pos"]
        assert seen.get((r["fold"], "excluded"), 0) == r["n_excluded_neg"] + r["n_excluded_pos"]
    tested = fo.tested_in(data, folds, "case")
    assert tested.count() == data.count()


def test_partitioning_and_row_order_do_not_matter(spark):
    data = records(spark, MANY)
    a = fo.logo_folds(pr.case_counts(data), "case").orderBy("fold").collect()
    b = fo.logo_folds(pr.case_counts(data.orderBy(F.desc("record_id")).repartition(13)), "case").orderBy("fold").collect()
    assert a == b


def test_many_groups_in_many_ranges(spark):
    """Eligible groups are rare, so the next one usually lies in another range."""
    rows = spark.range(3000).select(
        F.concat(F.lit("g"), F.col("id")).alias("group_id"), F.concat(F.lit("c"), F.col("id")).alias("case_id"),
        F.lit(5).cast("bigint").alias("n_neg"), F.when(F.col("id").isin(17, 1400, 2800), 9).otherwise(0).cast("bigint").alias("n_pos"))
    got = {r["test_unit"]: r["val_group"] for r in fo.logo_folds(rows, "group", 5).collect()}
    for i in range(3000):
        expected = 17 if i < 17 or i >= 2800 else 1400 if i < 1400 else 2800
        assert got[f"g{i}"] == f"g{expected}"


def test_group_cases_and_table(spark):
    cases = pr.case_counts(records(spark, NINE))
    rows = {(r["group_id"], r["ordinal"]): r["case_id"] for r in pr.group_cases(cases).collect()}
    assert rows[("chb01", 1)] == "chb01" and rows[("chb01", 2)] == "chb21" and rows[("chb17", 1)] == "chb17a" and len(rows) == 9
    whole = {r["group_id"]: r for r in pr.group_table(cases).collect()}
    assert whole["chb17"]["n_cases"] == 2 and whole["chb17"]["eligible"] and not whole["chb05"]["eligible"]


def test_map_group(spark):
    data = records(spark, NINE).drop("group_id")
    aliases = spark.createDataFrame(list(OWNERS.items()), "case_id string, group_id string")
    got = {(r["case_id"], r["group_id"]) for r in fo.map_group(data, aliases).select("case_id", "group_id").distinct().collect()}
    assert got == {(c, OWNERS.get(c, c)) for c in NINE}
