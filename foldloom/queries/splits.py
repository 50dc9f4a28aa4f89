"""Stratified splits and task plans over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldloom.operators import stratified as st
from foldloom.queries.views import VECTORS, sql, vectors

TASKS = "tasks AS (SELECT pos, t AS task_id FROM (VALUES " + ", ".join(
    f"({i}, '{t}')" for i, t in enumerate(st.PRESET_TASKS)) + """) x(pos, t)),
targets AS (
  SELECT task_id, unnest(string_split(g, '+')) AS set_id, target FROM (
    SELECT task_id, unnest(string_split(task_id, '_vs_')) AS g, unnest(range(len(string_split(task_id, '_vs_')))) AS target FROM tasks))"""

RANKED = """ranked AS (
  SELECT record_id, set_id, row_number() OVER (PARTITION BY set_id ORDER BY sha256('42:' || record_id)) AS pos,
         row_number() OVER (ORDER BY set_id, sha256('42:' || record_id)) AS deal, count(*) OVER (PARTITION BY set_id) AS n FROM vectors),
fits AS (
  SELECT 'cv_fold_' || lpad(CAST(i AS VARCHAR), 2, '0') AS fit, 42 + i AS seed, record_id, set_id,
         CASE WHEN (deal - 1) % 10 + 1 = i THEN 'test' ELSE 'dev' END AS part FROM ranked, range(1, 11) r(i)
  UNION ALL
  SELECT 'holdout_70_30', 1042, record_id, set_id, CASE WHEN pos <= round(n * 0.3) THEN 'test' ELSE 'dev' END FROM ranked),
inner_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fit, part, set_id ORDER BY sha256(seed || ':' || record_id)) AS p,
         count(*) OVER (PARTITION BY fit, part, set_id) AS m FROM fits),
planned AS (
  SELECT fit, seed, record_id, set_id, CASE WHEN part = 'test' THEN 'test' WHEN p <= round(m * 0.15) THEN 'val' ELSE 'train' END AS part
  FROM inner_ranked)"""


def task_catalog(spark, d):
    """The task list sized by the records of the sets each task uses, in the order in which tasks are run."""
    catalog = st.task_catalog(st.preset_tasks(spark))
    sizes = vectors(spark, d).groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    used = st.task_targets(st.preset_tasks(spark)).join(sizes, "set_id").groupBy("task_id").agg(F.sum("n").alias("n_records"))
    joined = catalog.drop("groups").join(used, "task_id")
    return st.order_tasks(joined)


def task_targets(spark, d):
    """Records of every task with their class in it."""
    targets = st.task_targets(st.preset_tasks(spark))
    return vectors(spark, d).select("record_id", "set_id").join(targets, "set_id").groupBy("task_id", "target").agg(
        F.count(F.lit(1)).alias("n"))


def kfold_members(spark, d):
    return st.stratified_kfold(vectors(spark, d).select("record_id", "set_id"))


def kfold_balance(spark, d):
    """Sizes per stratum, and of whole folds under the stratum ``all``."""
    assigned = st.stratified_kfold(vectors(spark, d).select("record_id", "set_id"))
    return st.fold_balance(assigned.unionByName(assigned.withColumn("set_id", F.lit("all"))))


def holdout_members(spark, d):
    return st.stratified_holdout(vectors(spark, d).select("record_id", "set_id"))


def planned_fits(spark, d):
    return st.planned_fits(vectors(spark, d))


def task_plan_sizes(spark, d):
    return st.fit_sizes(st.planned_fits(vectors(spark, d)), st.task_targets(st.preset_tasks(spark)))


def incomplete_tasks(spark, d):
    """Tasks without eleven fits once the holdout of the tasks that use set S is lost."""
    sizes = st.fit_sizes(st.planned_fits(vectors(spark, d)), st.task_targets(st.preset_tasks(spark)))
    lost = (F.col("fit") == "holdout_70_30") & F.col("task_id").contains("S")
    return st.incomplete_tasks(sizes.where(~lost))


QUERIES = {
    "task_catalog": (task_catalog, sql(VECTORS, TASKS, body="""
SELECT task_id, pos::BIGINT AS pos, row_number() OVER (ORDER BY len(string_split(task_id, '_vs_')) DESC, pos) AS rank, len(string_split(task_id, '_vs_')) AS n_classes,
  100 * (SELECT count(*) FROM targets g WHERE g.task_id = t.task_id) AS n_recordings,
  (SELECT count(*) FROM vectors v JOIN targets g ON v.set_id = g.set_id WHERE g.task_id = t.task_id) AS n_records FROM tasks t""")),
    "task_targets": (task_targets, sql(VECTORS, TASKS, body="""
SELECT task_id, target, count(*) AS n FROM vectors JOIN targets USING (set_id) GROUP BY task_id, target""")),
    "kfold_members": (kfold_members, sql(VECTORS, RANKED, body="SELECT record_id, set_id, (deal - 1) % 10 + 1 AS test_fold FROM ranked")),
    "kfold_balance": (kfold_balance, sql(VECTORS, body="""
SELECT set_id, count(*) AS n_records, count(*) // 10 AS smallest_fold, (count(*) + 9) // 10 AS largest_fold FROM vectors GROUP BY set_id
UNION ALL SELECT 'all', count(*), count(*) // 10, (count(*) + 9) // 10 FROM vectors""")),
    "holdout_members": (holdout_members, sql(VECTORS, RANKED, body="SELECT record_id, set_id, pos <= round(n * 0.3) AS is_test FROM ranked")),
    "planned_fits": (planned_fits, sql(VECTORS, RANKED, body="SELECT fit, seed, part, set_id, record_id FROM planned")),
    "task_plan_sizes": (task_plan_sizes, sql(VECTORS, TASKS, RANKED, body="""
SELECT task_id, fit, seed, part, target, count(*) AS n FROM planned JOIN targets USING (set_id) GROUP BY ALL""")),
    "incomplete_tasks": (incomplete_tasks, sql(VECTORS, TASKS, RANKED, body="""
SELECT task_id, count(DISTINCT fit) AS n_fits FROM planned JOIN targets USING (set_id)
WHERE NOT (fit = 'holdout_70_30' AND contains(task_id, 'S')) GROUP BY task_id HAVING count(DISTINCT fit) <> 11""")),
}
