"""Leave-one-group-out folds as a table of heads; membership follows from the heads by rule.

A fold is described by its test unit, test group and validation group. A record's role is then a
comparison of its case and group with the head, so no row per (fold, record) has to exist. Sizes come from
the (group, case) counts: train = all - validation group - test group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.functions.text import natural_key
from foldloom.operators.profile import case_counts, group_cases, group_counts
from foldloom.plans.ordering import RANGE, numbered, positions, rows_before
from foldloom.plans.stage import stage

UNIT_KINDS = ("group", "case")

MANIFEST_COLUMNS = (
    "fold", "name", "unit_kind", "test_unit", "test_group", "val_group", "seed", "n_train", "n_train_neg", "n_train_pos", "n_train_groups",
    "n_val", "n_val_neg", "n_val_pos", "n_val_cases", "n_test", "n_test_neg", "n_test_pos", "test_single_class",
    "n_excluded", "n_excluded_units",
)

# Heads whose roles are rows of one block; more heads make more blocks.
BLOCK_FOLDS = 256


class FoldPlanError(ValueError):
    """The fold plan cannot be built, is inconsistent, or does not match the data."""


def map_group(df: DataFrame, aliases: DataFrame, case: str = "case_id", group: str = "group_id") -> DataFrame:
    """Adds the owner of every case: the mapped group if ``aliases(case, group)`` lists it, else the case itself.

    The mapping holds one row per alias; Spark broadcasts it when its measured size allows.
    """
    pairs = aliases.select(F.col(case).alias("_alias"), F.col(group).alias("_owner"))
    joined = df.join(pairs, df[case] == pairs["_alias"], "left")
    return joined.withColumn(group, F.coalesce("_owner", case)).drop("_alias", "_owner")


def _ordered_groups(cases: DataFrame, min_per_class: int) -> DataFrame:
    """Groups in natural order, each with the next eligible group in cyclic order (``next``) and the totals.

    Inside a range a window finds the next eligible group. For the groups after a range's last eligible one, the
    summary with one row per range names the first eligible group of the ranges that follow.
    """
    local = numbered(group_counts(cases, min_per_class).withColumn("_key", natural_key("group_id")), "_key", "group_id")
    candidate = F.when(F.col("eligible"), F.struct("group_id", "n_neg", "n_pos", "n_cases"))
    # Bounded by the number of partitions, so its windows and its broadcast stay small at any scale.
    per_range = local.groupBy(RANGE).agg(
        F.max("_row").alias("_n"), F.min_by(candidate, F.when(F.col("eligible"), F.col("_row"))).alias("_first"),
        F.sum("n_neg").alias("all_neg"), F.sum("n_pos").alias("all_pos"))
    later = Window.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = per_range.select(
        RANGE, rows_before().alias("_off"),
        F.coalesce(F.last("_first", ignorenulls=True).over(later), F.first("_first", ignorenulls=True).over(whole)).alias("_later"),
        *[F.sum(c).over(whole).alias(a) for c, a in (
            ("_n", "n_groups"), ("all_neg", "all_neg"), ("all_pos", "all_pos"))])
    # Descending order turns "next" into "last seen", which a growing frame answers in one pass.
    after = Window.partitionBy(RANGE).orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, -1)
    inside = local.withColumn("_inside", F.last(candidate, ignorenulls=True).over(after))
    return (inside.join(F.broadcast(summary), RANGE)
            .withColumns({"position": F.col("_row") + F.col("_off"), "next": F.coalesce("_inside", "_later")})
            .drop("_inside", "_later", "_key", "_row", "_off", RANGE))


def case_violations(cases: DataFrame) -> DataFrame:
    """(rule, n): what keeps folds from being built, from the case counts: blank owners, labels outside 0 and 1, split cases, no data."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    bad = F.col("n_bad") if "n_bad" in cases.columns else F.lit(0)
    per_case = cases.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("owners"), F.sum(F.col("n_neg") + F.col("n_pos") + bad).alias("records"), F.sum(bad).alias("bad"),
        F.sum(F.when(blank("group_id"), F.col("n_neg") + F.col("n_pos") + bad).otherwise(0)).alias("unowned"))
    counts = per_case.agg(
        F.sum(F.when(blank("case_id"), F.col("records"))).alias("blank_case"), F.sum("unowned").alias("blank_group"),
        F.sum("bad").alias("label_outside_domain"), F.count_if((F.col("owners") > 1) & ~blank("case_id")).alias("case_with_several_groups"),
        (F.count(F.lit(1)) == 0).cast("bigint").alias("no_records"))
    return counts.unpivot([], counts.columns, "rule", "n").where("n > 0")


def input_violations(records: DataFrame) -> DataFrame:
    """(rule, n): ``case_violations`` of the records, and record ids that are missing or occur more than once."""
    ids = records.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = ids.agg(F.count_if(F.col("record_id").isNotNull() & (F.col("n") > 1)).alias("repeated_record_id"),
                       F.sum(F.when(F.col("record_id").isNull(), F.col("n"))).alias("blank_record_id"))
    rows = repeated.unpivot([], repeated.columns, "rule", "n").where("n > 0")
    return case_violations(case_counts(records)).unionByName(rows)


def logo_folds(cases: DataFrame, unit: str = "group", min_per_class: int = 5, seed: int = 42) -> DataFrame:
    """One row per fold: the heads of the leave-one-group-out plan and the class counts of its parts.

    Fold k tests unit k in natural order. Validation is the next whole group after the test group, in cyclic
    natural order, with at least ``min_per_class`` records of each class. Everything else is training, except the
    other cases of the test group when ``unit='case'``. ``cases`` comes from ``case_counts``.
    """
    if unit not in UNIT_KINDS:
        raise FoldPlanError(f"unit must be one of {UNIT_KINDS}, got {unit!r}")
    broken = case_violations(cases).collect()  # one row a rule at most
    if broken:
        raise FoldPlanError("; ".join(f"{r['rule']}: {r['n']}" for r in broken))
    groups = _ordered_groups(cases, min_per_class)
    owner = groups.select(F.col("group_id").alias("test_group"), F.col("n_neg").alias("_group_neg"),
                          F.col("n_pos").alias("_group_pos"), "n_cases", "n_groups", "all_neg", "all_pos", "next", "position")
    if unit == "group":
        units = owner.select("*", F.col("test_group").alias("test_unit"),
                             F.col("_group_neg").alias("n_test_neg"), F.col("_group_pos").alias("n_test_pos"),
                             F.lit(0).cast("bigint").alias("n_excluded_units"))
    else:
        keyed = cases.withColumn("_key", natural_key("case_id"))
        ranked = positions(keyed, "_key", "case_id").select(
            F.col("group_id").alias("test_group"), F.col("case_id").alias("test_unit"),
            F.col("n_neg").alias("n_test_neg"), F.col("n_pos").alias("n_test_pos"), "position")
        units = (ranked.join(owner.drop("position"), "test_group")
                 .withColumn("n_excluded_units", F.col("n_cases") - 1))
    # One row per fold, read by everything that follows.
    folds = stage(units.select(
        F.col("position").alias("fold"), F.concat(F.lit("fold_"), "test_unit").alias("name"),
        F.lit(unit).alias("unit_kind"), "test_unit", "test_group", F.col("next.group_id").alias("val_group"),
        "n_excluded_units", F.col("next.n_cases").alias("n_val_cases"), (F.lit(int(seed)).cast("bigint") + F.col("position")).alias("seed"),
        "n_test_neg", "n_test_pos", F.col("next.n_neg").alias("n_val_neg"), F.col("next.n_pos").alias("n_val_pos"),
        (F.col("_group_neg") - F.col("n_test_neg")).alias("n_excluded_neg"),
        (F.col("_group_pos") - F.col("n_test_pos")).alias("n_excluded_pos"),
        (F.col("all_neg") - F.col("_group_neg") - F.col("next.n_neg")).alias("n_train_neg"),
        (F.col("all_pos") - F.col("_group_pos") - F.col("next.n_pos")).alias("n_train_pos"),
        (F.col("n_groups") - 2).alias("n_train_groups")))
    # Without an eligible group there is no next one; a single one would have to follow itself.
    alone = F.col("val_group").isNull() | (F.col("val_group") == F.col("test_group"))
    untrained = F.least("n_train_neg", "n_train_pos") == 0
    faults = folds.agg(F.count_if(alone).alias("alone"), F.count_if(untrained & ~alone).alias("untrained")).first()
    if faults["alone"]:
        raise FoldPlanError(f"fewer than 2 groups have at least {max(1, int(min_per_class))} records of each class")
    if faults["untrained"]:
        raise FoldPlanError(f"{faults['untrained']} folds have no training records of some class")
    return folds


def excluded_units(folds: DataFrame, cases: DataFrame) -> DataFrame:
    """(fold, ordinal, excluded_unit): the other cases of the test group, one row each.

    For folds that are looked at: the rule says the same without rows, ``case_id <> test_unit`` within ``test_group``.
    """
    siblings = group_cases(cases).withColumnRenamed("group_id", "test_group")
    return (folds.where("n_excluded_units > 0").select("fold", "test_group", "test_unit").join(siblings, "test_group")
            .where("case_id <> test_unit").select("fold", "ordinal", F.col("case_id").alias("excluded_unit")))


def fold_manifest(folds: DataFrame) -> DataFrame:
    """The readable fold table: units, class counts per part, seed. No record is read, and nothing grows with a group's cases:
    the validation cases are those of ``val_group`` in ``group_cases``, the excluded ones those of ``test_group`` but ``test_unit``."""
    wide = folds.withColumns({
        "n_train": F.col("n_train_neg") + F.col("n_train_pos"), "n_val": F.col("n_val_neg") + F.col("n_val_pos"),
        "n_test": F.col("n_test_neg") + F.col("n_test_pos"), "n_excluded": F.col("n_excluded_neg") + F.col("n_excluded_pos"),
        "test_single_class": F.least("n_test_neg", "n_test_pos") == 0})
    return wide.select(*MANIFEST_COLUMNS)


def select_folds(folds: DataFrame, units: Sequence[str] | None = None) -> DataFrame:
    """Folds whose test unit is listed (None or empty: all), with their numbers and seeds unchanged."""
    if not units:
        return folds
    wanted = [str(u) for u in units]
    if len(set(wanted)) != len(wanted):
        raise FoldPlanError(f"repeated test units in the selection: {wanted}")
    listed = folds.sparkSession.createDataFrame([(u,) for u in wanted], "test_unit string")
    unknown = [r[0] for r in unknown_units(folds, listed).collect()]
    if unknown:
        raise FoldPlanError(f"unknown test units: {sorted(unknown)}")
    return folds.join(listed, "test_unit", "left_semi")


def unknown_units(folds: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected test units that the plan does not have."""
    return selection.join(folds, "test_unit", "left_anti")


def role_of(case: Column, group: Column, test_unit: Column, test_group: Column, val_group: Column,
            unit_kind: Column) -> Column:
    """Role of a record in a fold, from ids alone."""
    own = F.when(unit_kind == "case", case).otherwise(group)
    return (F.when(own == test_unit, "test").when(group == test_group, "excluded")
            .when(group == val_group, "validation").otherwise("train"))


def fold_roles(records: DataFrame, folds: DataFrame) -> DataFrame:
    """Role of every record in each of the given folds: ``fold, seed, role`` beside the record.

    The result has one row per record and fold, so hand over the folds that are trained now; ``tested_in`` answers "which fold tests this
    record" for a whole plan. Heads are joined in blocks, each meeting every part of the records, so both sides may have any size.
    """
    heads = folds.select("fold", "seed", "unit_kind", "test_unit", "test_group", "val_group")
    blocks = max(1, -(-heads.count() // BLOCK_FOLDS))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = records.withColumns({"_part": F.pmod(F.xxhash64("record_id"), F.lit(parts)).cast("int"),
                                "_block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = heads.select(*[F.col(c).alias(f"_{c}") for c in heads.columns], F.pmod(F.xxhash64("fold"), F.lit(blocks)).cast("int").alias("_block"),
                         F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    joined = left.join(right, ["_block", "_part"])
    role = role_of(F.col("case_id"), F.col("group_id"), *[F.col(f"_{c}") for c in ("test_unit", "test_group", "val_group", "unit_kind")])
    return joined.select(*records.columns, F.col("_fold").alias("fold"), F.col("_seed").alias("seed"), role.alias("role"))


def tested_in(records: DataFrame, folds: DataFrame, unit: str = "group") -> DataFrame:
    """Every record with the one fold that tests it."""
    key = "group_id" if unit == "group" else "case_id"
    heads = folds.select(F.col("test_unit").alias(key), "fold", "seed")
    return records.join(heads, key)
