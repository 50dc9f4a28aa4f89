"""Fingerprints of the given tables and comparisons of two sides made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.functions.text import record_line
from foldloom.operators import compare as co
from foldloom.operators import fingerprints as fp
from foldloom.operators import folds as fo
from foldloom.operators import splittree as tr
from foldloom.operators import stratified as st
from foldloom.operators.profile import case_counts
from foldloom.plans.digests import tree_digest
from foldloom.plans.stage import new_path
from foldloom.queries import folds as qf
from foldloom.queries import splits as qs
from foldloom.queries.views import MIN_PER_CLASS, RECORDS, TEXTS, VECTORS, records, sql, table, texts, vectors


def tree(name: str, source: str, line: str, by: str = "") -> str:
    """SQL of the digest tree: lines, leaves by six hex digits, branches by three, root."""
    keys, group = (f"{by}, ", f"{by}, ") if by else ("", "")
    tail = f"GROUP BY {by}" if by else ""
    return f"""{name}_l AS (SELECT {keys}sha256({line}) AS h, count(*) AS n FROM {source} GROUP BY {group}sha256({line})),
{name}_6 AS (SELECT {keys}substr(h, 1, 6) AS p, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h || ':' || n)) AS e, sum(n) AS n
  FROM {name}_l GROUP BY {group}substr(h, 1, 6)),
{name}_3 AS (SELECT {keys}substr(p, 1, 3) AS q, sha256(string_agg(p || ':' || e, chr(10) ORDER BY p || ':' || e)) AS e, sum(n) AS n
  FROM {name}_6 GROUP BY {group}substr(p, 1, 3)),
{name} AS (SELECT {keys}sum(n)::BIGINT AS n_lines, sha256(string_agg(q || ':' || e, chr(10) ORDER BY q || ':' || e)) AS digest
  FROM {name}_3 {tail})"""


def backwards():
    """The labelled documents from the last id to the first: an order that is not the key."""
    return F.lit(10**9) - F.col("record_id")


def dataset_digests(spark, d):
    data = texts(spark, d)
    return fp.keyed_digests(data, {
        "records": fp.record_id_line(), "payloads": record_line("record_id", "payload_hash"),
        "labels": F.concat_ws(":", "payload_hash", F.col("label").cast("string")),
        "owners": F.concat_ws(":", "payload_hash", "group_id", "case_id"),
        "row_order": record_line(backwards(), "payload_hash")})


def single_digests(spark, d):
    """The same digests, one operator each."""
    data = texts(spark, d)
    parts = {"records": fp.records_digest(data), "payloads": fp.payload_digest(data), "labels": fp.signal_label_digest(data),
             "owners": fp.owner_digest(data), "row_order": fp.ordered_digest(data.withColumn("ordinal", backwards()), "ordinal", F.col("payload_hash"))}
    out = None
    for key, part in parts.items():
        row = part.select(F.lit(key).alias("key"), "n_lines", "digest")
        out = row if out is None else out.unionByName(row)
    return out


RECORD_LINE = "record_id || chr(9) || group_id || chr(9) || case_id || chr(9) || label"
DATASET_SQL = sql(TEXTS, tree("a", "texts", RECORD_LINE), tree("b", "texts", "record_id || chr(9) || payload_hash"),
                  tree("c", "texts", "payload_hash || ':' || label"),
                  tree("e2", "texts", "payload_hash || ':' || group_id || ':' || case_id"),
                  tree("o", "texts", "(1000000000 - record_id) || chr(9) || payload_hash"), body="""
SELECT 'records' AS key, * FROM a UNION ALL SELECT 'payloads', * FROM b UNION ALL SELECT 'labels', * FROM c
UNION ALL SELECT 'owners', * FROM e2 UNION ALL SELECT 'row_order', * FROM o""")


def line_digest(spark, d):
    """Digest of every line item per return flag: few keys, many rows, repeated lines."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
    return tree_digest(lines, record_line("l_orderkey", "l_linenumber", "l_partkey"), ["l_returnflag"])


def case_digests(spark, d):
    return fp.records_digest(records(spark, d), ["group_id"])


def _recordings(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ordinal"), F.col("lang").alias("set_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("record_id"),
        F.sha2("text", 256).alias("payload_hash"), F.sha2(F.concat("text", F.lit("\n")), 256).alias("file_hash"))


RECORDINGS = """rec AS (SELECT doc_id AS ordinal, lang AS set_id, 'doc' || doc_id AS record_id, sha256(text) AS payload_hash,
  sha256(text || chr(10)) AS file_hash FROM documents),
lines AS (
  SELECT 'data_order' AS key, ordinal || chr(9) || set_id || chr(9) || payload_hash AS line FROM rec
  UNION ALL SELECT 'signal_set', set_id || chr(9) || payload_hash FROM rec
  UNION ALL SELECT 'file_order', ordinal || chr(9) || set_id || chr(9) || file_hash FROM rec
  UNION ALL SELECT 'record_order', ordinal || chr(9) || record_id FROM rec)"""


def recording_digests(spark, d):
    return fp.recording_digests(_recordings(spark, d))


def split_digests(spark, d):
    """Digest of every task and of the whole split plan, from the lines of all their members."""
    out = fp.planned_split_digests(st.planned_fits(vectors(spark, d)), st.task_targets(st.preset_tasks(spark)))
    return out["task"].select("task_id", "n_lines", "digest").unionByName(
        out["plan"].select(F.lit("<all>").alias("task_id"), "n_lines", "digest"))


def _lanes(h: str) -> str:
    return " || ',' || ".join(f"sum(CAST('0x' || substr({h}, {4 * i + 1}, 4) AS BIGINT))::BIGINT" for i in range(16))


SPLIT_SQL = sql(VECTORS, qs.TASKS, qs.RANKED, "rows AS (SELECT * FROM planned JOIN targets USING (set_id))",
                tree("f", "rows", "part || chr(9) || record_id || chr(9) || target || chr(9) || seed", "task_id, fit"),
                tree("t", "f", "fit || chr(9) || digest", "task_id"),
                tree("a", "t", "task_id || chr(9) || digest"), body="""
SELECT task_id, n_lines, digest FROM t UNION ALL SELECT '<all>', n_lines, digest FROM a""")


def _edited_fits(fits):
    """A plan in which fold 3 validates some of its training records, fold 1 lost some records, and the holdout has another seed."""
    key, fit = F.col("record_id"), F.col("fit")
    moved = (fit == "cv_fold_03") & (F.col("part") == "train") & (key % 50 == 7)
    kept = fits.where(~((fit == "cv_fold_01") & (key % 97 == 5)))
    return kept.withColumns({"part": F.when(moved, "val").otherwise(F.col("part")),
                             "seed": F.when(fit == "holdout_70_30", F.col("seed") + 1).otherwise(F.col("seed"))})


def _stored_trees(spark, d):
    """Trees of the plan and of its edited form; in that one set S has another target in all tasks with set Z."""
    fits = fp.stage(st.planned_fits(vectors(spark, d)))
    targets = st.task_targets(st.preset_tasks(spark))
    other = targets.withColumn("target", F.when(F.col("task_id").contains("Z") & (F.col("set_id") == "S"), F.col("target") + 10).otherwise(F.col("target")))
    trees = []
    for rows, goals in ((fits, targets), (_edited_fits(fits), other)):
        path = new_path(spark)
        tr.write_split_tree(rows, goals, path)
        trees.append(tr.read_split_tree(spark, path))
    return trees


def differing_fits(spark, d):
    return tr.differing_fits(*_stored_trees(spark, d))


def differing_records(spark, d):
    return tr.differing_records(*_stored_trees(spark, d))


EDITED = """edited AS (
  SELECT fit, CASE WHEN fit = 'holdout_70_30' THEN seed + 1 ELSE seed END AS seed, record_id, set_id,
         CASE WHEN fit = 'cv_fold_03' AND part = 'train' AND record_id % 50 = 7 THEN 'val' ELSE part END AS part
  FROM planned WHERE NOT (fit = 'cv_fold_01' AND record_id % 97 = 5)),
goals AS (SELECT task_id, set_id, CASE WHEN contains(task_id, 'Z') AND set_id = 'S' THEN target + 10 ELSE target END AS target FROM targets)"""

# All rows of both plans side by side.
DIFFERING_FITS_SQL = sql(VECTORS, qs.TASKS, qs.RANKED, EDITED, """a AS (SELECT * FROM planned JOIN targets USING (set_id)),
b AS (SELECT * FROM edited JOIN goals USING (set_id)),
both_sides AS (SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.fit, b.fit) AS fit, coalesce(a.record_id, b.record_id) AS record_id,
    a.part IS DISTINCT FROM b.part AS moved, a.seed <> b.seed AS reseeded, a.target <> b.target AS retargeted
  FROM a FULL JOIN b ON a.task_id = b.task_id AND a.fit = b.fit AND a.record_id = b.record_id),
aims AS (SELECT t.task_id, bool_or(t.target <> g.target) AS targets_differ FROM targets t JOIN goals g USING (task_id, set_id) GROUP BY t.task_id)""", body="""
SELECT task_id, fit, 'both' AS side, coalesce(bool_or(reseeded), false) AS seed_differs, any_value(targets_differ) AS targets_differ,
  count(*) FILTER (moved) AS n_records, coalesce(array_to_string(list_sort(list(record_id) FILTER (moved))[1:3], ', '), '') AS first_records
FROM both_sides JOIN aims USING (task_id) GROUP BY task_id, fit HAVING bool_or(moved OR coalesce(reseeded, false) OR coalesce(retargeted, false))""")
DIFFERING_RECORDS_SQL = sql(VECTORS, qs.RANKED, EDITED.split(",\ngoals")[0], body="""
SELECT coalesce(a.fit, b.fit) AS fit, coalesce(a.record_id, b.record_id) AS record_id, a.set_id AS left_set, a.part AS left_part, b.set_id AS right_set, b.part AS right_part
FROM planned a FULL JOIN edited b ON a.fit = b.fit AND a.record_id = b.record_id WHERE a.part IS DISTINCT FROM b.part""")


def _lane_digest(keys: str, source: str, line: str) -> str:
    return f"SELECT {keys}, count(*) AS n_members, count(*) FILTER (label = 1) AS n_pos, sha256(count(*) || ',' || {_lanes('h')}) AS digest FROM (SELECT *, sha256({line}) AS h FROM {source}) GROUP BY {keys}"


def fold_part_digests(spark, d):
    """Digest of the members of every part of every case fold, from case sums alone."""
    cases = case_counts(records(spark, d))
    folds = fo.logo_folds(cases, "case", MIN_PER_CLASS)
    sums = fp.case_sums(records(spark, d), record_line("record_id"))
    return fp.part_digests(fp.rule_part_sums(folds, sums))


FOLD_PARTS_SQL = sql(RECORDS, qf.GROUPS, qf.ROLES.format(unit="r.case_id", heads="heads_case"), f"""parted AS (
  SELECT fold, CASE role WHEN 'validation' THEN 'val' ELSE role END AS part, record_id, label FROM roles WHERE role <> 'excluded')""",
                     body=_lane_digest("fold, part", "parted", "CAST(record_id AS VARCHAR)"))


def plan_row_digests(spark, d):
    """The same digests for a plan in row form, keyed by payload."""
    data = texts(spark, d)
    folds = fo.logo_folds(case_counts(data), "group", 1)
    rows = fo.fold_roles(data, folds).where("role <> 'excluded'").select(
        "fold", F.col("role").alias("part"), "payload_hash", "label")
    return fp.part_digests(fp.plan_part_sums(rows, F.col("payload_hash"), F.col("label") == 1))


PLAN_ROWS_SQL = sql(TEXTS, qf.TEXT_HEADS, """parted AS (
  SELECT t.fold, CASE t.part WHEN 'val' THEN 'validation' ELSE t.part END AS part, x.payload_hash, x.label FROM tplan t JOIN texts x USING (record_id))""",
                    body=_lane_digest("fold, part", "parted", "payload_hash"))


def _sides(spark, d):
    """The labelled documents with their folds, and the same with other case names (payload level cannot see record
    order or fold names, but it sees owners)."""
    data = texts(spark, d)
    other = data.withColumn("case_id", F.concat(F.lit("c"), "case_id"))
    return data, other, fo.logo_folds(case_counts(data), "group", 1)


def fingerprint_status(spark, d):
    data, other, folds = _sides(spark, d)
    ours = fp.fingerprint(data, folds, "payload_hash", "record_id")
    moved = fp.fingerprint(other, folds, "payload_hash", "record_id")
    pairs = {"same": (ours, ours), "other cases": (ours, moved), "ids only": (ours, fp.fingerprint(data, folds))}
    out = None
    for name, (a, b) in pairs.items():
        row = co.compare_fingerprints(a, b).withColumn("pair", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def fingerprint_lines(spark, d):
    data, other, folds = _sides(spark, d)
    return co.comparison_lines(fp.fingerprint(data, folds, "payload_hash", "record_id"),
                               fp.fingerprint(other, folds, "payload_hash", "record_id"))


def recordings_explained(spark, d):
    """The documents against copies with other bytes, other names, another order and other content."""
    base = _recordings(spark, d)
    variants = {
        "same": base,
        "bytes": base.withColumn("file_hash", F.sha2("file_hash", 256)),
        "names": base.withColumn("record_id", F.concat(F.lit("x"), "record_id")),
        "order": base.withColumn("ordinal", -F.col("ordinal")),
        "content": base.withColumn("payload_hash", F.when(F.col("ordinal") == 7, F.lit("0")).otherwise(F.col("payload_hash")))}
    mine = fp.stage(fp.recording_digests(base))
    out = None
    for name, other in variants.items():
        row = co.explain_recordings(mine, fp.recording_digests(other)).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def missing_recordings(spark, d):
    base = _recordings(spark, d)
    return co.missing_per_set(base, base.where(F.col("ordinal") % 9 != 0))


def split_comparison(spark, d):
    """All tasks with seed 42 against the tasks without set S, of which those with set Z use seed 43."""
    fits, targets = st.complete_fits(st.preset_tasks(spark), vectors(spark, d))
    fewer = tuple(t for t in st.PRESET_TASKS if "S" not in t)
    again, goals = st.complete_fits(st.preset_tasks(spark, fewer), vectors(spark, d))
    with_z = F.col("task_id").contains("Z")
    sides = (fp.planned_fit_digests(again.withColumn("seed", F.col("seed") + 1), goals.where(with_z)), fp.planned_fit_digests(again, goals.where(~with_z)))
    return co.compare_splits(fp.planned_split_digests(fits, targets)["task"], fp.task_digests(sides[0].unionByName(sides[1])))


def task_sides(spark, d):
    """Tasks that the sets of the embeddings allow, against those without set F."""
    sets = vectors(spark, d).select("set_id").distinct()
    left = st.task_targets(st.preset_tasks(spark)).join(sets, "set_id").select("task_id").distinct()
    right = left.where(~F.col("task_id").contains("F")).unionByName(
        left.where(F.col("task_id").contains("F")).withColumn("task_id", F.concat(F.lit("x"), "task_id")))
    return co.compare_keys(left, right, "task_id")


def table_cells(spark, d):
    """Suppliers against an edited copy: changed balances, a lost nation, lost and added rows."""
    left = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    key = F.col("s_suppkey")
    right = left.where(key % 11 != 0).select(
        F.when(key % 13 == 0, -key).otherwise(key).alias("s_suppkey"), "s_name",
        F.when(key % 3 == 0, F.lit(None).cast("int")).otherwise(F.col("s_nationkey")).alias("s_nationkey"))
    return co.diff_tables(left, right, ["s_suppkey"])


TABLE_CELLS_SQL = """
WITH r AS (SELECT CASE WHEN s_suppkey % 13 = 0 THEN -s_suppkey ELSE s_suppkey END AS k, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS nat
  FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT coalesce(s_suppkey, k) AS s_suppkey, '<row>' AS "column", CASE WHEN s_suppkey IS NOT NULL THEN 'present' END AS left_value,
  CASE WHEN k IS NOT NULL THEN 'present' END AS right_value FROM supplier FULL JOIN r ON s_suppkey = k WHERE s_suppkey IS NULL OR k IS NULL
UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR), CAST(nat AS VARCHAR) FROM supplier JOIN r ON s_suppkey = k
WHERE s_nationkey IS DISTINCT FROM nat"""

def order_cells(spark, d):
    """Orders against a copy with a few changes: a changed status, a missing price, lost and moved orders."""
    left = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    right = left.where(key % 997 != 0).select(
        F.when(key % 991 == 0, -key).otherwise(key).alias("o_orderkey"), "o_custkey", F.when(key % 983 == 0, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 977 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return co.diff_large_tables(left, right, ["o_orderkey"]).select("o_orderkey", "column", F.when(F.col("column") == "o_totalprice", F.lit(None)).otherwise(
        F.col("left_value")).alias("left_value"), "right_value")


ORDER_CELLS_SQL = """
WITH r AS (SELECT CASE WHEN o_orderkey % 991 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 983 = 0 THEN '?' ELSE o_orderstatus END AS s,
  CASE WHEN o_orderkey % 977 <> 0 THEN o_totalprice END AS p FROM orders WHERE o_orderkey % 997 <> 0)
SELECT coalesce(o_orderkey, k) AS o_orderkey, '<row>' AS "column", CASE WHEN o_orderkey IS NOT NULL THEN 'present' END AS left_value,
  CASE WHEN k IS NOT NULL THEN 'present' END AS right_value FROM orders FULL JOIN r ON o_orderkey = k WHERE o_orderkey IS NULL OR k IS NULL
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, s FROM orders JOIN r ON o_orderkey = k WHERE o_orderstatus IS DISTINCT FROM s
UNION ALL SELECT o_orderkey, 'o_totalprice', NULL, NULL FROM orders JOIN r ON o_orderkey = k WHERE o_totalprice IS DISTINCT FROM p"""

# Both sides of the fingerprint queries, their lines and folds, hashed as plain sorted text and compared.
FINGERPRINTS = """sides AS (
  SELECT 'a' AS side, record_id, group_id, case_id, label, payload_hash FROM texts
  UNION ALL SELECT 'b', record_id, group_id, 'c' || case_id, label, payload_hash FROM texts),
lines AS (
  SELECT side, 'record' AS level, 'records' AS key, record_id || chr(9) || group_id || chr(9) || case_id || chr(9) || label AS line FROM sides
  UNION ALL SELECT side, 'payload', 'signals', payload_hash || ':' || label FROM sides
  UNION ALL SELECT side, 'payload', 'owners', payload_hash || ':' || group_id || ':' || case_id FROM sides
  UNION ALL SELECT side, 'note', 'row_order', record_id || chr(9) || payload_hash || ':' || label FROM sides),
fold_lines AS (
  SELECT side, 'record' AS level, fold, part || ' ' || record_id || ' ' || s.label AS line FROM tplan t JOIN sides s USING (record_id)
  UNION ALL SELECT side, 'payload', fold, part || ' ' || payload_hash || ' ' || s.label FROM tplan t JOIN sides s USING (record_id)),
fold_digests AS (SELECT side, level, 'fold' AS scope, CAST(fold AS VARCHAR) AS key, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM fold_lines GROUP BY side, level, fold),
digests AS (
  SELECT side, level, 'dataset' AS scope, key, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM lines GROUP BY side, level, key
  UNION ALL SELECT side, level, 'dataset', 'fold_table', sha256(string_agg(key || d, chr(10) ORDER BY key)) FROM fold_digests GROUP BY side, level
  UNION ALL SELECT * FROM fold_digests
  UNION ALL SELECT side, 'meta', 'meta', unnest(['kind', 'schema']), 'x' FROM (VALUES ('a'), ('b')) v(side)),
changes AS (SELECT a.level, a.scope, a.key, a.d <> b.d AS differs FROM digests a JOIN digests b USING (level, scope, key) WHERE a.side = 'a' AND b.side = 'b')"""

FINGERPRINT_LINES_SQL = sql(TEXTS, qf.TEXT_HEADS, FINGERPRINTS, body="""
SELECT level, scope, key, CASE WHEN differs THEN 'MISMATCH' ELSE 'MATCH' END AS result FROM changes WHERE scope <> 'fold'
UNION ALL SELECT level, scope, key, 'MISMATCH' FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY CAST(key AS BIGINT)) AS r
  FROM changes WHERE scope = 'fold' AND differs) WHERE r <= 5
UNION ALL SELECT level, 'fold', '...', (count(*) - 5) || ' more' FROM changes WHERE scope = 'fold' AND differs GROUP BY level HAVING count(*) > 5""")
FINGERPRINT_STATUS_SQL = sql(TEXTS, qf.TEXT_HEADS, FINGERPRINTS, """pairs AS (
  SELECT 'same' AS pair, 'payload' AS level, scope, a.d <> b.d AS differs FROM digests a JOIN digests b USING (side, level, scope, key) WHERE side = 'a' AND level = 'payload'
  UNION ALL SELECT 'other cases', level, scope, differs FROM changes WHERE level = 'payload'
  UNION ALL SELECT 'ids only', level, scope, a.d <> b.d FROM digests a JOIN digests b USING (side, level, scope, key) WHERE side = 'a' AND level = 'record')""", body="""
SELECT pair, CASE WHEN bool_or(differs) THEN 'MISMATCH' ELSE 'MATCH' END AS status, level, count(*) FILTER (differs AND scope = 'dataset') AS n_dataset_differs,
  count(*) FILTER (differs AND scope = 'fold') AS n_folds_differ FROM pairs GROUP BY pair, level""")
RECORDINGS_EXPLAINED_SQL = sql(RECORDINGS.split(",\nlines AS")[0], """variants AS (
  SELECT 'same' AS variant, * FROM rec UNION ALL SELECT 'bytes', * REPLACE (sha256(file_hash) AS file_hash) FROM rec
  UNION ALL SELECT 'names', * REPLACE ('x' || record_id AS record_id) FROM rec UNION ALL SELECT 'order', * REPLACE (-ordinal AS ordinal) FROM rec
  UNION ALL SELECT 'content', * REPLACE (CASE WHEN ordinal = 7 THEN '0' ELSE payload_hash END AS payload_hash) FROM rec),
d AS (SELECT variant, sha256(string_agg(ordinal || ' ' || set_id || ' ' || payload_hash, ',' ORDER BY ordinal)) AS data_order,
    sha256(string_agg(set_id || ' ' || payload_hash, ',' ORDER BY set_id, payload_hash)) AS signals,
    sha256(string_agg(ordinal || ' ' || set_id || ' ' || file_hash, ',' ORDER BY ordinal)) AS files,
    sha256(string_agg(ordinal || ' ' || record_id, ',' ORDER BY ordinal)) AS names FROM variants GROUP BY variant)""", body="""
SELECT v.variant, CASE WHEN v.data_order = s.data_order THEN 'MATCH' ELSE 'MISMATCH' END AS status,
  CASE WHEN v.data_order = s.data_order AND v.files = s.files AND v.names = s.names THEN 'identical'
    WHEN v.data_order = s.data_order AND v.names = s.names THEN 'same signals, other file bytes'
    WHEN v.data_order = s.data_order AND v.files = s.files THEN 'same signals, other names'
    WHEN v.data_order = s.data_order THEN 'same signals, other file bytes and names'
    WHEN v.signals = s.signals THEN 'same signals, other order' ELSE 'different signals' END AS cause
FROM d v, (SELECT * FROM d WHERE variant = 'same') s""")
SPLIT_COMPARISON_SQL = sql(VECTORS, qs.TASKS, qs.RANKED, """l AS (SELECT task_id, fit, seed, part, record_id, target FROM planned JOIN targets USING (set_id)),
r AS (SELECT task_id, fit, CASE WHEN contains(task_id, 'Z') THEN seed + 1 ELSE seed END AS seed, part, record_id, target FROM l WHERE NOT contains(task_id, 'S')),
names AS (SELECT coalesce(x.task_id, y.task_id) AS task_id, x.task_id IS NULL AS lone_right, y.task_id IS NULL AS lone_left
          FROM (SELECT DISTINCT task_id FROM l) x FULL JOIN (SELECT DISTINCT task_id FROM r) y ON x.task_id = y.task_id),
rows_apart AS ((SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL (SELECT * FROM r EXCEPT SELECT * FROM l)),
apart AS (SELECT DISTINCT task_id FROM rows_apart JOIN names USING (task_id) WHERE NOT lone_left AND NOT lone_right)""", body="""
SELECT count(*) FILTER (NOT lone_left AND NOT lone_right) AS n_common, (SELECT count(*) FROM apart) AS n_differing, count(*) FILTER (lone_left) AS n_only_left,
  count(*) FILTER (lone_right) AS n_only_right, (SELECT array_to_string(list_sort(list(task_id))[1:6], ', ') || CASE WHEN count(*) > 6 THEN ' ...' ELSE '' END FROM apart) AS first_differing FROM names""")

QUERIES = {
    "order_cells": (order_cells, ORDER_CELLS_SQL),
    "dataset_digests": (dataset_digests, DATASET_SQL),
    "single_digests": (single_digests, DATASET_SQL),
    "line_digest": (line_digest, sql(tree("a", "lineitem", "l_orderkey || chr(9) || l_linenumber || chr(9) || l_partkey", "l_returnflag"),
                                     body="SELECT l_returnflag, n_lines, digest FROM a")),
    "case_digests": (case_digests, sql(RECORDS, tree("a", "records", RECORD_LINE, "group_id"), body="SELECT group_id, n_lines, digest FROM a")),
    "recording_digests": (recording_digests, sql(RECORDINGS, tree("a", "lines", "line", "key"), body="SELECT key, n_lines, digest FROM a")),
    "split_digests": (split_digests, SPLIT_SQL),
    "differing_fits": (differing_fits, DIFFERING_FITS_SQL),
    "differing_records": (differing_records, DIFFERING_RECORDS_SQL),
    "fold_part_digests": (fold_part_digests, FOLD_PARTS_SQL),
    "plan_row_digests": (plan_row_digests, PLAN_ROWS_SQL),
    "fingerprint_status": (fingerprint_status, FINGERPRINT_STATUS_SQL),
    "fingerprint_lines": (fingerprint_lines, FINGERPRINT_LINES_SQL),
    "recordings_explained": (recordings_explained, RECORDINGS_EXPLAINED_SQL),
    "missing_recordings": (missing_recordings, """
SELECT lang AS set_id, count(*) AS n_missing FROM (
  SELECT DISTINCT lang, text FROM documents EXCEPT SELECT DISTINCT lang, text FROM documents WHERE doc_id % 9 <> 0) GROUP BY lang"""),
    "split_comparison": (split_comparison, SPLIT_COMPARISON_SQL),
    "task_sides": (task_sides, sql(qs.TASKS, body="""
SELECT task_id, CASE WHEN contains(task_id, 'F') THEN 'only_left' ELSE 'both' END AS side FROM tasks
UNION ALL SELECT 'x' || task_id, 'only_right' FROM tasks WHERE contains(task_id, 'F')""")),
    "table_cells": (table_cells, TABLE_CELLS_SQL),
}
