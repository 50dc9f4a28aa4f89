"""Leave-one-group-out plans over events and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.operators import folds as fo
from foldloom.operators import plancheck as pc
from foldloom.operators.profile import case_counts
from foldloom.queries.views import MIN_PER_CLASS, RECORDS, TEXTS, prefixed, records, sql, table, texts

SELECTED = ("g1", "g3", "g6")

# Heads by brute force: units in order, and for every unit the first eligible group in the ring of groups.
GROUPS = f"""grp AS (
  SELECT gid, group_id, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1,
         row_number() OVER (ORDER BY gid) AS pos FROM records GROUP BY gid, group_id),
ring AS (
  SELECT t.gid, v.group_id AS val_group, v.gid AS vgid,
         row_number() OVER (PARTITION BY t.gid ORDER BY (v.pos - t.pos + n.g) % n.g) AS turn
  FROM grp t, grp v, (SELECT count(*) AS g FROM grp) n
  WHERE v.gid <> t.gid AND least(v.n0, v.n1) >= {MIN_PER_CLASS}),
heads_group AS (
  SELECT row_number() OVER (ORDER BY g.gid) AS fold, g.group_id AS test_unit, g.group_id AS test_group, g.gid, val_group, vgid
  FROM grp g JOIN ring r ON r.gid = g.gid AND turn = 1),
heads_case AS (
  SELECT row_number() OVER (ORDER BY user_id) AS fold, 'u' || user_id AS test_unit, 'g' || c.gid AS test_group, c.gid, val_group, vgid
  FROM (SELECT DISTINCT user_id, gid FROM records) c JOIN ring r ON r.gid = c.gid AND turn = 1)"""

ROLES = """roles AS (
  SELECT h.fold, r.*, CASE WHEN {unit} = h.test_unit THEN 'test' WHEN r.group_id = h.test_group THEN 'excluded'
         WHEN r.group_id = h.val_group THEN 'validation' ELSE 'train' END AS role
  FROM {heads} h CROSS JOIN records r)"""


def _cases(spark, d):
    return case_counts(records(spark, d))


def _folds(spark, d, unit):
    cases = _cases(spark, d)
    return fo.logo_folds(cases, unit, MIN_PER_CLASS), cases


HEADS = ["fold", "name", "unit_kind", "test_unit", "test_group", "val_group", "n_excluded_units", "seed"]


def logo_folds_group(spark, d):
    return _folds(spark, d, "group")[0].select(*HEADS)


def logo_folds_case(spark, d):
    return _folds(spark, d, "case")[0].select(*HEADS)


def _heads_sql(unit: str) -> str:
    excluded = "0" if unit == "group" else "(SELECT count(DISTINCT user_id) - 1 FROM records r WHERE r.gid = h.gid)"
    return sql(RECORDS, GROUPS, body=f"""
SELECT fold, 'fold_' || test_unit AS name, '{unit}' AS unit_kind, test_unit, test_group, val_group,
  CAST({excluded} AS BIGINT) AS n_excluded_units, 42 + fold AS seed
FROM heads_{unit} h""")


def fold_manifest_group(spark, d):
    return fo.fold_manifest(_folds(spark, d, "group")[0])


def fold_manifest_case(spark, d):
    return fo.fold_manifest(_folds(spark, d, "case")[0])


def _manifest_sql(unit: str) -> str:
    column = "r.group_id" if unit == "group" else "r.case_id"
    part = ", ".join(
        f"count(*) FILTER (role = '{role}' AND label = {c}) AS n_{short}_{name}"
        for role, short in (("train", "train"), ("validation", "val"), ("test", "test")) for c, name in ((0, "neg"), (1, "pos")))
    return sql(RECORDS, GROUPS, ROLES.format(unit=column, heads=f"heads_{unit}"), f"""agg AS (
  SELECT fold, {part}, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'validation') AS n_val,
         count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'excluded') AS n_excluded,
         count(DISTINCT gid) FILTER (role = 'train') AS n_train_groups
  FROM roles GROUP BY fold),
users AS (SELECT DISTINCT user_id, gid FROM records)""", body=f"""
SELECT a.*, h.test_unit, h.val_group, 42 + h.fold AS seed, h.test_group,
  (SELECT count(*) FROM users u WHERE u.gid = h.vgid) AS n_val_cases,
  (SELECT count(*) FROM users u WHERE '{unit}' = 'case' AND u.gid = h.gid AND 'u' || user_id <> h.test_unit) AS n_excluded_units,
  least(n_test_neg, n_test_pos) = 0 AS test_single_class, 'fold_' || h.test_unit AS name, '{unit}' AS unit_kind
FROM agg a JOIN heads_{unit} h ON a.fold = h.fold""")


def excluded_units(spark, d):
    folds, cases = _folds(spark, d, "case")
    return fo.excluded_units(folds, cases)


def _spoilt(spark, d):
    """Events with every kind of bad input: blank owners and cases, labels that are missing or 2, split cases, repeated ids."""
    event, user = F.col("record_id"), F.col("case_id")
    return records(spark, d).select(
        F.when(event % 11 == 0, event + 1).otherwise(event).alias("record_id"), F.when(event % 97 == 0, " ").otherwise(user).alias("case_id"),
        F.when(event % 89 == 0, F.lit(None)).when(event % 83 == 0, "other").otherwise(F.col("group_id")).alias("group_id"),
        F.when(event % 79 == 0, 2).when(event % 73 == 0, F.lit(None)).otherwise(F.col("label")).alias("label"))


def fold_input_violations(spark, d):
    return fo.input_violations(_spoilt(spark, d))


INPUT_VIOLATIONS_SQL = sql(RECORDS, """spoilt AS (
  SELECT CASE WHEN record_id % 11 = 0 THEN record_id + 1 ELSE record_id END AS record_id, CASE WHEN record_id % 97 = 0 THEN ' ' ELSE case_id END AS case_id,
         CASE WHEN record_id % 89 = 0 THEN NULL WHEN record_id % 83 = 0 THEN 'other' ELSE group_id END AS group_id,
         CASE WHEN record_id % 79 = 0 THEN 2 WHEN record_id % 73 = 0 THEN NULL ELSE label END AS label FROM records),
found AS (
  SELECT 'blank_case' AS rule, count(*) AS n FROM spoilt WHERE trim(case_id) = ''
  UNION ALL SELECT 'blank_group', count(*) FROM spoilt WHERE group_id IS NULL
  UNION ALL SELECT 'label_outside_domain', count(*) FROM spoilt WHERE label IS NULL OR label = 2
  UNION ALL SELECT 'case_with_several_groups', count(*) FROM (
    SELECT case_id FROM spoilt WHERE trim(case_id) <> '' GROUP BY case_id HAVING count(DISTINCT coalesce(group_id, '-')) > 1)
  UNION ALL SELECT 'repeated_record_id', count(*) FROM (SELECT record_id FROM spoilt GROUP BY record_id HAVING count(*) > 1))""", body="""
SELECT rule, n FROM found WHERE n > 0""")


def selected_folds(spark, d):
    return fo.select_folds(_folds(spark, d, "group")[0], SELECTED).select(*HEADS)


def unknown_units(spark, d):
    """Every group shifted by three places, as a selection: the last three are unknown."""
    shifted = table(spark, d, "events").select(prefixed("g", F.floor(F.col("user_id") / 2) + 3).alias("test_unit")).distinct()
    return fo.unknown_units(_folds(spark, d, "group")[0], shifted)


def fold_roles(spark, d):
    folds = fo.select_folds(_folds(spark, d, "group")[0], SELECTED)
    return fo.fold_roles(records(spark, d), folds).groupBy("fold", "seed", "role", "label").agg(F.count(F.lit(1)).alias("n"))


def tested_in(spark, d):
    return fo.tested_in(records(spark, d), _folds(spark, d, "case")[0], "case").select("record_id", "fold", "seed")


# ---- plans in row form: every fold of the labelled documents

TEXT_HEADS = """tgrp AS (
  SELECT gid, group_id, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1,
         row_number() OVER (ORDER BY gid) AS pos FROM texts GROUP BY gid, group_id),
tring AS (
  SELECT t.gid, v.group_id AS val_group, row_number() OVER (PARTITION BY t.gid ORDER BY (v.pos - t.pos + n.g) % n.g) AS turn
  FROM tgrp t, tgrp v, (SELECT count(*) AS g FROM tgrp) n WHERE v.gid <> t.gid AND least(v.n0, v.n1) >= 1),
theads AS (
  SELECT row_number() OVER (ORDER BY g.gid) AS fold, g.group_id AS test_group, r.val_group
  FROM tgrp g JOIN tring r ON r.gid = g.gid AND turn = 1),
tplan AS (
  SELECT fold, CASE WHEN group_id = test_group THEN 'test' WHEN group_id = val_group THEN 'val' ELSE 'train' END AS part,
         record_id, group_id, label, test_group, val_group FROM theads, texts)"""

# The broken plan: fold 1 also trains on its test rows, fold 2 loses half of its validation rows, fold 3 repeats
# its test rows, fold 4 holds ids that the data lacks, the last fold is missing.
BROKEN = """bplan AS (
  SELECT fold, part, record_id FROM tplan WHERE fold < (SELECT max(fold) FROM theads) AND NOT (fold = 2 AND part = 'val' AND record_id % 2 = 0)
  UNION ALL SELECT fold, 'train', record_id FROM tplan WHERE fold = 1 AND part = 'test'
  UNION ALL SELECT fold, part, record_id FROM tplan WHERE fold = 3 AND part = 'test'
  UNION ALL SELECT fold, part, -1 - record_id FROM tplan WHERE fold = 4 AND part = 'val')"""


def _text_plan(spark, d):
    data = texts(spark, d)
    folds = fo.logo_folds(case_counts(data), "group", 1)
    return data, folds, pc.expand_plan(data, folds)


def _broken_plan(spark, d):
    data, folds, plan = _text_plan(spark, d)
    last = folds.agg(F.max("fold")).scalar()
    fold, part, key = F.col("fold"), F.col("part"), F.col("record_id")
    row = lambda p, k, when: F.when(when, F.struct(p.alias("part"), k.alias("record_id")))
    # One expansion of the plan: each of its rows becomes none, one or two.
    changed = F.array_compact(F.array(
        row(part, key, (fold < last) & ~((fold == 2) & (part == "val") & (key % 2 == 0))), row(F.lit("train"), key, (fold == 1) & (part == "test")),
        row(part, key, (fold == 3) & (part == "test")), row(part, -1 - key, (fold == 4) & (part == "val"))))
    members = plan.select("fold", F.explode(changed).alias("x")).select("fold", "x.part", "x.record_id")
    return data, folds.where(F.col("fold") < last), members


AUDIT = ["fold", "train", "val", "test", "unknown", "repeated", "overlap", "groups_in_two_parts", "n_unit", "n_val_group",
         "test_in_unit", "val_in_group", "placed", "n_records"]


def plan_audit(spark, d):
    data, folds, members = _broken_plan(spark, d)
    return pc.fold_audit(members, folds, data).select(*AUDIT)


PLAN_AUDIT_SQL = sql(TEXTS, TEXT_HEADS, BROKEN, """loc AS (
  SELECT b.fold, b.part, b.record_id, t.group_id, t.label FROM bplan b LEFT JOIN texts t ON b.record_id = t.record_id),
rec AS (SELECT fold, record_id, any_value(group_id) AS group_id, count(*) FILTER (part = 'train') AS a,
        count(*) FILTER (part = 'val') AS b, count(*) FILTER (part = 'test') AS c FROM loc GROUP BY fold, record_id),
leak AS (SELECT fold, count(*) AS k FROM (SELECT fold, group_id FROM loc WHERE group_id IS NOT NULL
         GROUP BY fold, group_id HAVING count(DISTINCT part) > 1) GROUP BY fold)""", body="""
SELECT h.fold, count(*) FILTER (r.group_id IS NOT NULL AND a > 0) AS train,
  count(*) FILTER (r.group_id IS NOT NULL AND b > 0) AS val, count(*) FILTER (r.group_id IS NOT NULL AND c > 0) AS test,
  count(*) FILTER (r.group_id IS NULL) AS unknown, count(*) FILTER (greatest(a, b, c) > 1) AS repeated,
  count(*) FILTER ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT > 1) AS overlap, coalesce(max(l.k), 0) AS groups_in_two_parts,
  (SELECT count(*) FROM texts t WHERE t.group_id = h.test_group) AS n_unit,
  (SELECT count(*) FROM texts t WHERE t.group_id = h.val_group) AS n_val_group,
  count(*) FILTER (c > 0 AND r.group_id = h.test_group) AS test_in_unit,
  count(*) FILTER (b > 0 AND r.group_id = h.val_group) AS val_in_group,
  count(*) FILTER (r.group_id IS NOT NULL) AS placed, (SELECT count(*) FROM texts) AS n_records
FROM theads h JOIN rec r ON r.fold = h.fold LEFT JOIN leak l ON l.fold = h.fold
GROUP BY h.fold, h.test_group, h.val_group""")


def plan_violations(spark, d):
    data, folds, members = _broken_plan(spark, d)
    return pc.check_plan(members, folds, data, 1).select("rule", F.coalesce("fold", F.lit(0)).alias("fold"), "n")


PLAN_VIOLATIONS_SQL = sql(TEXTS, TEXT_HEADS, BROKEN, """size AS (
  SELECT h.fold, (SELECT count(*) FROM texts t WHERE t.group_id = h.test_group) AS n_test,
         (SELECT count(*) FROM texts t WHERE t.group_id = h.val_group) AS n_val,
         (SELECT count(*) FROM texts t WHERE t.group_id = h.val_group AND t.record_id % 2 = 1) AS n_odd,
         (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) FROM texts t
          WHERE t.group_id = h.val_group AND t.record_id % 2 = 1) AS odd_min, (SELECT max(fold) FROM theads) AS k
  FROM theads h)""", body="""
SELECT 'record_in_two_parts' AS rule, fold, n_test AS n FROM size WHERE fold = 1
UNION ALL SELECT 'group_in_two_parts', fold, 1 FROM size WHERE fold = 1
UNION ALL SELECT 'val_not_group', fold, 2 * (n_val - n_odd) FROM size WHERE fold = 2 AND n_odd < n_val
UNION ALL SELECT 'left_out', fold, n_val - n_odd FROM size WHERE fold = 2 AND n_odd < n_val
UNION ALL SELECT 'val_below_minimum', fold, odd_min FROM size WHERE fold = 2 AND odd_min < 1
UNION ALL SELECT 'empty_part', fold, 1 FROM size WHERE fold = 2 AND n_odd = 0
UNION ALL SELECT 'repeated_id', fold, n_test FROM size WHERE fold = 3
UNION ALL SELECT 'unknown_id', fold, n_val FROM size WHERE fold = 4
UNION ALL SELECT 'val_group', fold, 0 FROM size WHERE false
UNION ALL SELECT 'unit_tested_once', 0, 1
UNION ALL SELECT 'record_tested_once', 0, (SELECT n_test FROM size WHERE fold = k) + (SELECT n_test FROM size WHERE fold = 3)""")


def valid_plan_violations(spark, d):
    data, folds, members = _text_plan(spark, d)
    found = pc.check_plan(members, folds, data, 1)
    return found.agg(F.count(F.lit(1)).alias("n_violations"))


def plan_coverage(spark, d):
    data, _, members = _broken_plan(spark, d)
    return pc.plan_coverage(members, data)


PLAN_COVERAGE_SQL = sql(TEXTS, TEXT_HEADS, BROKEN, """t AS (
  SELECT record_id, count(*) AS times FROM bplan WHERE part = 'test' GROUP BY record_id)""", body="""
SELECT (SELECT count(*) FROM texts) AS n_records, count(*) AS n_tested, count(*) FILTER (times > 1) AS n_tested_again,
  'partial (' || count(*) || ' of ' || (SELECT count(*) FROM texts) || ')' AS coverage FROM t""")


def shared_records(spark, d):
    data, _, members = _broken_plan(spark, d)
    return pc.shared_records(members, data)


def missing_plan_ids(spark, d):
    data, _, members = _broken_plan(spark, d)
    return pc.missing_ids(members, data)


MISSING_SQL = sql(TEXTS, TEXT_HEADS, BROKEN, body="""
SELECT fold, part, count(*) AS n_missing,
  array_to_string(list_sort(list(record_id))[1:3], ', ') AS examples
FROM bplan WHERE record_id NOT IN (SELECT record_id FROM texts) GROUP BY fold, part""")


def member_differences(spark, d):
    """The broken plan against the rule, part by part, from member sums."""
    data, folds, members = _broken_plan(spark, d)
    return pc.diff_members(members, data, folds)


MEMBER_DIFFERENCES_SQL = sql(TEXTS, TEXT_HEADS, BROKEN, """sides AS (
  SELECT fold, part, list_sort(list(record_id)) AS ids, count(*) AS n FROM bplan GROUP BY fold, part),
rule AS (SELECT fold, part, list_sort(list(record_id)) AS ids, count(*) AS n FROM tplan
         WHERE fold < (SELECT max(fold) FROM theads) GROUP BY fold, part)""", body="""
SELECT coalesce(s.fold, r.fold) AS fold, coalesce(s.part, r.part) AS part, coalesce(s.n, 0) AS n_plan, coalesce(r.n, 0) AS n_rule
FROM sides s FULL JOIN rule r ON s.fold = r.fold AND s.part = r.part WHERE s.ids IS DISTINCT FROM r.ids""")


def plan_problems(spark, d):
    """The bounded report of the broken plan."""
    data, folds, members = _broken_plan(spark, d)
    found = pc.check_plan(members, folds, data, 1)
    return pc.report_problems(found, 5).select("rule", F.coalesce("fold", F.lit(0)).alias("fold"), "n")


def changed_heads(spark, d):
    """The plan against the rule with a lower minimum: which folds validate elsewhere."""
    cases = _cases(spark, d)
    strict, loose = fo.logo_folds(cases, "group", MIN_PER_CLASS), fo.logo_folds(cases, "group", 1, seed=42)
    return pc.diff_heads(strict, loose).select("fold", "side", F.array_join("fields", ",").alias("fields"))


CHANGED_HEADS_SQL = sql(RECORDS, GROUPS, """nxt AS (
  SELECT g.gid, first_value(g.group_id) OVER (ORDER BY g.gid) AS first_group,
         lead(g.group_id) OVER (ORDER BY g.gid) AS next_group FROM grp g)""", body="""
SELECT fold, 'both' AS side, 'val_group' AS fields FROM heads_group h JOIN nxt ON nxt.gid = h.gid
WHERE val_group <> coalesce(next_group, first_group)""")


def plan_vs_rule(spark, d):
    cases = _cases(spark, d)
    return pc.compare_with_rule(fo.logo_folds(cases, "group", MIN_PER_CLASS), fo.logo_folds(cases, "group", 1))


PLAN_VS_RULE_SQL = CHANGED_HEADS_SQL.replace("SELECT fold, 'both' AS side, 'val_group' AS fields", """
SELECT count(*) AS n_differing, min(fold) AS first_fold, 'both' AS first_side, 'val_group' AS first_field""")

QUERIES = {
    "logo_folds_group": (logo_folds_group, _heads_sql("group")),
    "logo_folds_case": (logo_folds_case, _heads_sql("case")),
    "fold_manifest_group": (fold_manifest_group, _manifest_sql("group")),
    "fold_manifest_case": (fold_manifest_case, _manifest_sql("case")),
    "excluded_units": (excluded_units, sql(RECORDS, GROUPS, body="""
SELECT fold, ordinal, 'u' || user_id AS excluded_unit
FROM heads_case h JOIN (SELECT user_id, gid, row_number() OVER (PARTITION BY gid ORDER BY user_id) AS ordinal
                        FROM (SELECT DISTINCT user_id, gid FROM records)) u ON u.gid = h.gid AND 'u' || user_id <> test_unit""")),
    "fold_input_violations": (fold_input_violations, INPUT_VIOLATIONS_SQL),
    "member_differences": (member_differences, MEMBER_DIFFERENCES_SQL),
    "selected_folds": (selected_folds, _heads_sql("group") + f" WHERE test_unit IN {SELECTED}"),
    "unknown_units": (unknown_units, """
SELECT DISTINCT 'g' || (user_id // 2 + 3) AS test_unit FROM events
WHERE user_id // 2 + 3 NOT IN (SELECT user_id // 2 FROM events)"""),
    "fold_roles": (fold_roles, sql(RECORDS, GROUPS, ROLES.format(unit="r.group_id", heads="heads_group"), body=f"""
SELECT fold, 42 + fold AS seed, role, label, count(*) AS n FROM roles
WHERE fold IN (SELECT fold FROM heads_group WHERE test_unit IN {SELECTED}) GROUP BY fold, role, label""")),
    "tested_in": (tested_in, sql(RECORDS, body="""
SELECT record_id, fold, 42 + fold AS seed FROM (SELECT record_id, dense_rank() OVER (ORDER BY user_id) AS fold FROM records)""")),
    "plan_audit": (plan_audit, PLAN_AUDIT_SQL),
    "plan_violations": (plan_violations, PLAN_VIOLATIONS_SQL),
    "valid_plan_violations": (valid_plan_violations, sql(TEXTS, body="SELECT count(*) AS n_violations FROM texts WHERE label NOT IN (0, 1)")),
    "plan_coverage": (plan_coverage, PLAN_COVERAGE_SQL),
    "shared_records": (shared_records, sql(TEXTS, TEXT_HEADS, BROKEN, body="""
SELECT fold, record_id FROM bplan GROUP BY fold, record_id HAVING count(DISTINCT part) > 1""")),
    "missing_plan_ids": (missing_plan_ids, MISSING_SQL),
    "plan_problems": (plan_problems, "SELECT rule, fold, n FROM (" + PLAN_VIOLATIONS_SQL + ") ORDER BY CASE WHEN fold = 0 THEN 1 ELSE 0 END, fold, rule LIMIT 5"),
    "changed_heads": (changed_heads, CHANGED_HEADS_SQL),
    "plan_vs_rule": (plan_vs_rule, PLAN_VS_RULE_SQL),
}
