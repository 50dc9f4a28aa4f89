"""Checks of an externally supplied plan: heads ``folds`` and rows ``members(fold, part, record_id)``.

The row form of a plan has one row per fold and record. It is read once: records have ordinals in the order of their cases, and the first aggregation
turns the rows of a fold, part and case into bitmaps over these, one bit a record. Sizes, overlaps between parts and what is left out are counts of bits; rows of single
records are looked at again only in the bitmaps that hold repeated or shared ones. A plan built by ``logo_folds`` needs no such rows; compare its heads with
``compare_with_rule``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.operators.profile import case_counts
from foldloom.plans.ordering import positions
from foldloom.plans.stage import stage

PARTS = ("train", "val", "test")

PLAN_VIOLATIONS = "rule string, fold bigint, n bigint"


def expand_plan(records: DataFrame, folds: DataFrame) -> DataFrame:
    """Row form of selected folds (``fold, part, record_id``), as a plan file stores it."""
    from foldloom.operators.folds import fold_roles

    roles = fold_roles(records, folds).where("role <> 'excluded'")
    part = F.when(F.col("role") == "validation", "val").otherwise(F.col("role"))
    return roles.select("fold", part.alias("part"), "record_id")


def missing_ids(members: DataFrame, records: DataFrame, examples: int = 3) -> DataFrame:
    """Per fold and part: number of plan ids that the data lacks, and the first ids."""
    gone = members.join(records.select("record_id"), "record_id", "left_anti")
    first = F.array_sort(F.collect_list(F.struct("record_id")))
    ranked = _first_per(gone, ["fold", "part"], "record_id", examples)
    listed = ranked.groupBy("fold", "part").agg(
        F.array_join(F.transform(first, lambda x: x["record_id"].cast("string")), ", ").alias("examples"))
    counts = gone.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n_missing"))
    return counts.join(listed, ["fold", "part"])


def _first_per(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def resolve_id_column(table: DataFrame, plan_ids: DataFrame, candidates=("record_id", "segment_id")) -> str | None:
    """The first candidate column that is unique and contains every plan id."""
    for name in candidates:
        if name not in table.columns:
            continue
        repeated = table.groupBy(name).count().where("count > 1").limit(1).count()
        ids = table.select(F.col(name).alias("record_id"))
        if not repeated and not plan_ids.join(ids, "record_id", "left_anti").limit(1).count():
            return name
    return None


def shared_between_parts(located: DataFrame, key: str = "record_id") -> DataFrame:
    """(fold, key) pairs that occur in more than one part; ``key`` is the record or the group."""
    sides = located.groupBy("fold", key).agg(F.min("part").alias("_a"), F.max("part").alias("_b"))
    return sides.where("_a <> _b").select("fold", key)


def _all_of(*conditions: Column) -> Column:
    whole = conditions[0]
    for c in conditions[1:]:
        whole = whole & c
    return whole


BIT_KEYS = ("fold", "group_id", "case_id", "label", "bucket", "unknown_id")


def ordinals(records: DataFrame) -> DataFrame:
    """Records (record_id unique) with ``bucket`` and ``bit`` of their ordinal: a case's records of one label lie next to each other, so they share few buckets."""
    rows = positions(records.select("record_id", "group_id", "case_id", "label"), "group_id", "case_id", "label", "record_id", name="_at")
    return stage(rows.select("record_id", "group_id", "case_id", "label", F.bitmap_bucket_number("_at").alias("bucket"), F.bitmap_bit_position("_at").alias("bit")))


def with_bits(members: DataFrame, placed: DataFrame) -> DataFrame:
    """Plan rows with the bit of their record; an id that the data lacks is its own bitmap of one bit (``unknown_id``)."""
    joined = members.select("fold", "part", "record_id").join(placed, "record_id", "left")
    return joined.withColumns({"unknown_id": F.when(F.col("bucket").isNull(), F.col("record_id")), "bit": F.coalesce("bit", F.lit(0))})


def part_bits(rows: DataFrame) -> DataFrame:
    """One bitmap per fold, part, case, label and bucket, and the number of plan rows in it: the only aggregation over plan rows."""
    return stage(rows.groupBy(*BIT_KEYS, "part").agg(F.bitmap_construct_agg("bit").alias("bits"), F.count(F.lit(1)).alias("n")).withColumn("size", F.bitmap_count("bits")))


def merged_parts(bits: DataFrame) -> DataFrame:
    """Bitmaps of all parts side by side: distinct records per part and in all (``placed``), rows per part, and records in more than one part (``overlap``).

    Sizes of unions give those of intersections.
    """
    def union(*parts: str) -> Column:
        names = ", ".join(f"'{p}'" for p in parts)
        return F.coalesce(F.expr(f"bitmap_count(bitmap_or_agg(bits) FILTER (WHERE part IN ({names})))"), F.lit(0))

    def of(part: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == part, F.col(value))), F.lit(0))

    pairs = {f"_{x}_{y}": (x, y) for x, y in (("train", "val"), ("train", "test"), ("val", "test"))}
    wide = bits.groupBy(*BIT_KEYS).agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("placed"), union(*PARTS).alias("_all"), *[union(*p).alias(c) for c, p in pairs.items()],
        *[of(p, "size").alias(p) for p in PARTS], *[of(p, "n").alias(f"rows_{p}") for p in PARTS])
    both = {c: F.col(x) + F.col(y) - F.col(c) for c, (x, y) in pairs.items()}
    in_two = sum(both.values(), F.lit(0))
    in_three = F.col("_all") - sum((F.col(p) for p in PARTS), F.lit(0)) + in_two
    return wide.withColumn("overlap", in_two - 2 * in_three).drop("_all", *pairs)


def _rows_below(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Plan rows of the given bitmaps. Without such bitmaps the plan is not read again."""
    if keys.isEmpty():
        return rows.limit(0)
    condition = None
    for c in keys.columns:
        same = rows[c].eqNullSafe(keys[c])
        condition = same if condition is None else condition & same
    return rows.join(keys, condition, "left_semi")


def repeated_records(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """(fold, record_id) of records that one part of a fold lists more than once."""
    uneven = stage(bits.where("n > size").select("fold", "part", "case_id", "bucket", "unknown_id"))
    again = _rows_below(rows, uneven).groupBy("fold", "part", "record_id").count().where("count > 1")
    return again.select("fold", "record_id").distinct()


def shared_records(members: DataFrame, records: DataFrame) -> DataFrame:
    """(fold, record_id) of records that stand in more than one part of a fold, found in the bitmaps of the parts."""
    rows = with_bits(members, ordinals(records))
    shared = stage(merged_parts(part_bits(rows)).where("overlap > 0").select("fold", "case_id", "bucket", "unknown_id"))
    return shared_between_parts(_rows_below(rows, shared), "record_id")


def fold_audit(members: DataFrame, folds: DataFrame, records: DataFrame) -> DataFrame:
    """One row of counts per fold: everything the fold rules need."""
    rows = with_bits(members, ordinals(records))
    bits = part_bits(rows)
    known = F.col("unknown_id").isNull()
    count = lambda column, *conditions: F.coalesce(F.sum(F.when(_all_of(known, *conditions), F.col(column))), F.lit(0))
    # At most folds x cases rows, read twice below.
    per_case = stage(merged_parts(bits).groupBy("fold", "group_id", "case_id").agg(
        F.coalesce(F.sum(F.when(~known, F.col("placed"))), F.lit(0)).alias("unknown"), count("placed").alias("placed"), F.sum("overlap").alias("overlap"),
        *[F.sum(f"rows_{p}").alias(f"rows_{p}") for p in PARTS], *[count(p).alias(p) for p in PARTS],
        *[count(p, F.col("label") == c).alias(f"{p}_{c}") for p in ("train", "val") for c in (0, 1)]))
    repeated = repeated_records(rows, bits).groupBy("fold").agg(F.count(F.lit(1)).alias("repeated"))
    heads = folds.select("fold", "unit_kind", "test_unit", "test_group", "val_group")
    judged = per_case.join(heads, "fold")
    unit = F.when(F.col("unit_kind") == "case", F.col("case_id")).otherwise(F.col("group_id"))
    judged = judged.withColumns({"_unit": F.coalesce(unit == F.col("test_unit"), F.lit(False)),
                                 "_own": F.coalesce(F.col("group_id") == F.col("test_group"), F.lit(False)),
                                 "_val": F.coalesce(F.col("group_id") == F.col("val_group"), F.lit(False))})

    def where(flag: str, value: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(value)).otherwise(F.lit(0)))

    sums = ["unknown", "placed", "overlap", *[f"rows_{p}" for p in PARTS], *PARTS,
            "train_0", "train_1", "val_0", "val_1"]
    sibling = F.sum(F.when(F.col("_own") & ~F.col("_unit"), F.col("placed")).otherwise(F.lit(0)))
    by_fold = judged.groupBy("fold").agg(
        *[F.sum(c).alias(c) for c in sums],
        where("_unit", "test").alias("test_in_unit"), where("_val", "val").alias("val_in_group"),
        F.sum(F.when(~F.col("_own"), F.col("test")).otherwise(F.lit(0))).alias("test_outside_group"),
        F.sum(F.when(~F.col("_val"), F.col("val")).otherwise(F.lit(0))).alias("val_outside_group"),
        sibling.alias("sibling_placed"))
    by_group = judged.where(F.col("group_id").isNotNull()).groupBy("fold", "group_id").agg(
        *[(F.sum(p) > 0).cast("int").alias(p) for p in PARTS])
    leaks = by_group.groupBy("fold").agg(
        F.count_if(F.col("train") + F.col("val") + F.col("test") > 1).alias("groups_in_two_parts"))
    cases = case_counts(records)
    n = F.col("n_neg") + F.col("n_pos")
    group_sizes = cases.groupBy("group_id").agg(F.sum(n).alias("n_own"))
    case_sizes = cases.groupBy("case_id").agg(F.sum(n).alias("n_case"))
    val_sizes = group_sizes.select(F.col("group_id").alias("val_group"), F.col("n_own").alias("n_val_group"))
    expected = (heads.join(group_sizes.withColumnRenamed("group_id", "test_group"), "test_group", "left")
                .join(val_sizes, "val_group", "left")
                .join(case_sizes.withColumnRenamed("case_id", "test_unit"), "test_unit", "left"))
    n_unit = F.when(F.col("unit_kind") == "case", F.col("n_case")).otherwise(F.col("n_own"))
    expected = expected.select("fold", "test_unit", "unit_kind", *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (
        (n_unit, "n_unit"), (F.col("n_own"), "n_own"), (F.col("n_val_group"), "n_val_group"))])
    total = cases.agg(F.sum(n).alias("n")).scalar()
    audit = expected.join(by_fold, "fold", "left").join(repeated, "fold", "left").join(leaks, "fold", "left").withColumn("n_records", total)
    counted = [c for c in audit.columns if c not in ("fold", "test_unit", "unit_kind")]
    return audit.na.fill(0, subset=counted)


def fold_violations(audit: DataFrame, min_per_class: int = 5) -> DataFrame:
    """Broken fold rules, one row each, from the audit counts."""
    need = max(1, int(min_per_class))
    c = F.col
    n_siblings = c("n_own") - c("n_unit")
    left_out = c("n_records") - c("placed")
    # Each rule: what is wrong, and how many records or groups are affected.
    broken = {
        "unit_kind": (~c("unit_kind").isin("group", "case"), F.lit(1)),
        "empty_part": (F.least(*[f"rows_{p}" for p in PARTS]) == 0, F.lit(1)),
        "unknown_id": (c("unknown") > 0, c("unknown")),
        "repeated_id": (c("repeated") > 0, c("repeated")),
        "record_in_two_parts": (c("overlap") > 0, c("overlap")),
        "group_in_two_parts": (c("groups_in_two_parts") > 0, c("groups_in_two_parts")),
        "test_group": (c("test_outside_group") > 0, c("test_outside_group")),
        "val_group": (c("val_outside_group") > 0, c("val_outside_group")),
        "test_not_unit": ((c("test") != c("n_unit")) | (c("test_in_unit") != c("n_unit")),
                          F.abs(c("test") - c("n_unit")) + c("n_unit") - c("test_in_unit")),
        "val_not_group": ((c("val") != c("n_val_group")) | (c("val_in_group") != c("n_val_group")),
                          F.abs(c("val") - c("n_val_group")) + c("n_val_group") - c("val_in_group")),
        "left_out": ((left_out != n_siblings) | (c("sibling_placed") > 0),
                     F.abs(left_out - n_siblings) + c("sibling_placed")),
        "val_below_minimum": (F.least("val_0", "val_1") < need, F.least("val_0", "val_1")),
        "train_lacks_class": (F.least("train_0", "train_1") == 0, F.lit(1)),
    }
    found = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(name).alias("rule"), n.cast("bigint").alias("n")))
        for name, (bad, n) in broken.items()]))
    return audit.select("fold", F.explode(found).alias("v")).select("v.rule", "fold", "v.n")


def plan_coverage(members: DataFrame, records: DataFrame) -> DataFrame:
    """One row: records, how many are tested, tested more than once, and ``full`` or ``partial``."""
    tested = members.where("part = 'test'").groupBy("record_id").agg(F.count(F.lit(1)).alias("times"))
    seen = records.select("record_id").join(tested, "record_id", "left")
    counts = seen.agg(F.count(F.lit(1)).alias("n_records"), F.count("times").alias("n_tested"),
                      F.count_if(F.col("times") > 1).alias("n_tested_again"))
    full = (F.col("n_tested") == F.col("n_records")) & (F.col("n_tested_again") == 0)
    text = F.concat(F.lit("partial ("), F.col("n_tested").cast("string"), F.lit(" of "),
                    F.col("n_records").cast("string"), F.lit(")"))
    return counts.withColumn("coverage", F.when(full, "full").otherwise(text))


def _head_rules(whole: DataFrame, broken: dict[str, str]) -> DataFrame:
    """(rule, n) for the conditions that hold on the one row of ``whole``; n is its number of folds."""
    found = F.array_compact(F.array(*[F.when(F.expr(bad), F.lit(rule)) for rule, bad in broken.items()]))
    return whole.select(F.explode(found).alias("rule"), F.col("k").alias("n"))


def plan_kind_violations(folds: DataFrame) -> DataFrame:
    """Rules of any plan, complete or not: it has folds, and all test one kind of unit."""
    whole = folds.agg(F.count(F.lit(1)).alias("k"), F.min("unit_kind").alias("u0"), F.max("unit_kind").alias("u1"))
    found = _head_rules(whole, {"mixed_units": "u0 <> u1", "empty_plan": "k = 0"})
    return found.select("rule", F.lit(None).cast("bigint").alias("fold"), F.col("n").cast("bigint").alias("n"))


def completeness_violations(members: DataFrame, folds: DataFrame, records: DataFrame) -> DataFrame:
    """Rules of a complete plan: numbering, seeds, every unit and every record tested exactly once."""
    shift = F.col("seed") - F.col("fold")
    whole = folds.agg(F.count(F.lit(1)).alias("k"), F.count_distinct("fold").alias("d"), F.min("fold").alias("lo"),
                      F.max("fold").alias("hi"), F.min(shift).alias("s0"), F.max(shift).alias("s1"))
    head_rules = _head_rules(whole, {"fold_numbers": "lo <> 1 OR hi <> k OR d <> k", "seeds": "s0 <> s1"})
    kind = folds.agg(F.min("unit_kind")).scalar()
    units = records.select(F.when(kind == "case", F.col("case_id")).otherwise(F.col("group_id")).alias("test_unit")).distinct()
    planned = folds.groupBy("test_unit").agg(F.count(F.lit(1)).alias("times"))
    wrong = units.join(planned, "test_unit", "full").where("times IS NULL OR times <> 1")
    unit_rule = wrong.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("unit_tested_once").alias("rule"), "n")
    seen = plan_coverage(members, records)
    record_rule = seen.where("coverage <> 'full'").select(
        F.lit("record_tested_once").alias("rule"),
        (F.col("n_records") - F.col("n_tested") + F.col("n_tested_again")).alias("n"))
    result = head_rules.unionByName(unit_rule).unionByName(record_rule)
    return result.select("rule", F.lit(None).cast("bigint").alias("fold"), F.col("n").cast("bigint").alias("n"))


def check_plan(members: DataFrame, folds: DataFrame, records: DataFrame, min_per_class: int = 5,
               complete: bool = True) -> DataFrame:
    """All broken plan rules as rows ``(rule, fold, n)``; no row means the plan is valid."""
    found = fold_violations(fold_audit(members, folds, records), min_per_class).unionByName(plan_kind_violations(folds))
    if complete:
        found = found.unionByName(completeness_violations(members, folds, records))
    return found


def report_problems(violations: DataFrame, limit: int = 20) -> DataFrame:
    """The first problems in fold order; a report of fixed length."""
    return violations.orderBy(F.asc_nulls_last("fold"), "rule").limit(limit)


HEAD_FIELDS = ("test_unit", "test_group", "val_group", "seed", "n_excluded_units")


def diff_heads(left: DataFrame, right: DataFrame, fields=HEAD_FIELDS) -> DataFrame:
    """Folds whose heads differ: ``fold, side, fields``. ``side`` tells folds that only one plan has."""
    a, b = left.select("fold", *fields).alias("a"), right.select("fold", *fields).alias("b")
    joined = a.join(b, F.col("a.fold") == F.col("b.fold"), "full")
    differs = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]
    side = F.when(F.col("b.fold").isNull(), "only_left").when(F.col("a.fold").isNull(), "only_right").otherwise("both")
    rows = joined.select(F.coalesce("a.fold", "b.fold").alias("fold"), side.alias("side"),
                         F.array_compact(F.array(*differs)).alias("fields"))
    return rows.where((F.col("side") != "both") | (F.size("fields") > 0))


def compare_with_rule(folds: DataFrame, rule_folds: DataFrame, fields=HEAD_FIELDS) -> DataFrame:
    """One row: number of differing folds and the first difference in fold order (NULL if none)."""
    diff = diff_heads(folds, rule_folds, fields)
    first = F.min_by(F.struct("fold", "side", F.element_at("fields", 1).alias("field")), "fold")
    return diff.agg(F.count(F.lit(1)).alias("n_differing"), first.alias("f")).select(
        "n_differing", F.col("f.fold").alias("first_fold"), F.col("f.side").alias("first_side"),
        F.when(F.col("f.side") == "both", F.col("f.field")).alias("first_field"))


def diff_members(members: DataFrame, records: DataFrame, rule_folds: DataFrame, line: Column | None = None) -> DataFrame:
    """(fold, part, n_plan, n_rule): parts of a plan in row form whose members are not those of the rule, by number or by member sums.

    The rule's parts are sums over cases, so no row per fold and record is made for it.
    """
    from foldloom.operators.fingerprints import case_sums, part_digests, plan_part_sums, record_line, rule_part_sums

    line = record_line("record_id") if line is None else line
    plan = part_digests(plan_part_sums(members, line)).select("fold", "part", F.col("n_members").alias("n_plan"), F.col("digest").alias("_a"))
    rule = part_digests(rule_part_sums(rule_folds, case_sums(records, line))).select("fold", "part", F.col("n_members").alias("n_rule"), F.col("digest").alias("_b"))
    joined = plan.join(rule, ["fold", "part"], "full").na.fill(0, ["n_plan", "n_rule"])
    return joined.where(~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")
