"""Stratified k-fold and holdout splits, for one table or for many tasks over the same records.

The order inside a stratum is a seeded hash of the record id, so a split does not depend on partitioning
and every part of a stratum has its exact share. The order does not depend on the task either: it is ranked once
per record and the tasks are joined on afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions import text as tx
from foldloom.plans.ordering import first_by_hash, hash_positions, positions, running_totals
from foldloom.plans.stage import stage

# Shares and seed offset of the study's splits.
K_FOLDS, HOLDOUT_SHARE, VALIDATION_SHARE, HOLDOUT_SEED_OFFSET = 10, 0.30, 0.15, 1000

# The 32 preset tasks, groups separated by _vs_ and sets by +.
PRESET_TASKS = (
    "Z_vs_O", "Z_vs_N", "Z_vs_F", "Z_vs_S", "O_vs_N", "O_vs_F", "O_vs_S", "N_vs_F", "N_vs_S", "F_vs_S",
    "Z+O_vs_S", "N+F_vs_S", "Z+O+N+F_vs_S", "Z+O_vs_N+F", "Z+O_vs_N+F+S",
    "Z_vs_O_vs_N", "Z_vs_O_vs_F", "Z_vs_O_vs_S", "Z_vs_N_vs_F", "Z_vs_N_vs_S", "Z_vs_F_vs_S",
    "O_vs_F_vs_N", "O_vs_N_vs_S", "O_vs_F_vs_S", "N_vs_F_vs_S", "Z+O_vs_N+F_vs_S",
    "Z_vs_O_vs_N_vs_F", "Z_vs_O_vs_N_vs_S", "Z_vs_O_vs_F_vs_S", "Z_vs_N_vs_F_vs_S", "O_vs_N_vs_F_vs_S",
    "Z_vs_O_vs_N_vs_F_vs_S",
)


class SplitError(ValueError):
    """A split or task list breaks its contract."""


def preset_tasks(spark, tasks=PRESET_TASKS) -> DataFrame:
    """(pos, groups): the task list in its original order."""
    rows = [(i, [g.split("+") for g in t.split("_vs_")]) for i, t in enumerate(tasks)]
    return spark.createDataFrame(rows, "pos bigint, groups array<array<string>>")


def task_catalog(tasks: DataFrame, per_set: int = 100) -> DataFrame:
    """Id, classes and size of every task, and its rank: more classes first, ties in original order.

    The task list is the study's fixed list, so its rank needs one small sort.
    """
    return tasks.select(
        "pos", "groups", tx.task_id("groups").alias("task_id"), F.size("groups").cast("bigint").alias("n_classes"),
        (tx.task_sets("groups") * per_set).cast("bigint").alias("n_recordings"))


def task_targets(tasks: DataFrame) -> DataFrame:
    """(task_id, set_id, target): the class of a set is the index of its group."""
    groups = tasks.select(tx.task_id("groups").alias("task_id"), F.posexplode("groups").alias("target", "sets"))
    return groups.select("task_id", F.explode("sets").alias("set_id"), F.col("target").cast("bigint").alias("target"))


def order_tasks(catalog: DataFrame) -> DataFrame:
    """The catalog with ``rank`` from 1: more classes first, ties in original order. Rows come in that order."""
    back = catalog.withColumn("_back", -F.col("n_classes"))
    return positions(back, "_back", "pos", name="rank").drop("_back").orderBy("rank")


def share(n, fraction: float):
    """Rounded share of a stratum."""
    return F.round(n * F.lit(fraction)).cast("bigint")


def stratified_kfold(records: DataFrame, k: int = K_FOLDS, seed: int = 42, stratum: str = "set_id",
                     key: str = "record_id") -> DataFrame:
    """Adds ``test_fold`` (1..k): strata and whole folds are spread with sizes within one record."""
    return _with_fold(hash_positions(records, key, [stratum], F.lit(seed)), k, stratum).drop("position", "n_stratum")


def _with_fold(ranked: DataFrame, k: int, stratum: str) -> DataFrame:
    """Each stratum goes on dealing where the one before it stopped. One row per stratum carries the offset."""
    sizes = stage(ranked.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")))
    offsets = running_totals(sizes, [stratum], ["n"]).select(F.col(stratum).alias("_stratum"), F.col("before_n").alias("_dealt"))
    return (ranked.join(offsets, F.col(stratum).eqNullSafe(F.col("_stratum")))
            .withColumn("test_fold", F.pmod(F.col("_dealt") + F.col("position") - 1, F.lit(k)) + 1).drop("_stratum", "_dealt"))


def stratified_holdout(records: DataFrame, fraction: float = HOLDOUT_SHARE, seed: int = 42, stratum: str = "set_id",
                       key: str = "record_id") -> DataFrame:
    """Adds ``is_test``: the rounded share of every stratum."""
    return first_by_hash(records, key, [stratum], F.lit(seed), lambda n: share(n, fraction), "is_test")


def inner_validation(members: DataFrame, fraction: float = VALIDATION_SHARE, stratum: str = "set_id",
                     key: str = "record_id") -> DataFrame:
    """Splits the development rows of every fit into ``train`` and ``val``, stratified, by the fit's own seed.

    ``members(fit, seed, part, ...)`` has part ``dev`` or ``test``; test rows pass unchanged.
    """
    test = F.col("part") == "test"
    chosen = first_by_hash(members, key, ["fit", "part", stratum], F.col("seed"), lambda n: share(n, fraction), "_val", ~test)
    return chosen.withColumn("part", F.when(test, "test").when(F.col("_val"), "val").otherwise("train")).drop("_val")


def planned_fits(records: DataFrame, k: int = K_FOLDS, seed: int = 42, stratum: str = "set_id",
                 key: str = "record_id") -> DataFrame:
    """``fit, seed, part, set_id, record_id`` for the k folds and the holdout of every stratum.

    A record takes part in every fit, so the k + 1 rows per record are the plan itself.
    """
    # Folds and holdout follow the same order, which is ranked once.
    ranked = stage(hash_positions(records.select(key, stratum), key, [stratum], F.lit(seed)))
    held = _with_fold(ranked, k, stratum).withColumn("is_test", F.col("position") <= share(F.col("n_stratum"), HOLDOUT_SHARE))
    # A staged table of narrow rows is few files: without this, one task would hold the k + 1 rows of all its records.
    held = held.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cv = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(
        F.format_string("cv_fold_%02d", i).alias("fit"), (F.lit(seed) + i).alias("seed"),
        F.when(F.col("test_fold") == i, "test").otherwise("dev").alias("part")))
    holdout = F.array(F.struct(F.lit("holdout_70_30").alias("fit"), F.lit(seed + HOLDOUT_SEED_OFFSET).alias("seed"),
                               F.when(F.col("is_test"), "test").otherwise("dev").alias("part")))
    rows = held.withColumn("f", F.explode(F.concat(cv, holdout))).select(
        F.col("f.fit").alias("fit"), F.col("f.seed").cast("bigint").alias("seed"), F.col("f.part").alias("part"),
        stratum, key)
    return inner_validation(rows, VALIDATION_SHARE, stratum, key)


def complete_fits(tasks: DataFrame, records: DataFrame, k: int = K_FOLDS, seed: int = 42,
                  stratum: str = "set_id", key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """The fits of a plan, staged, and the targets of its tasks. Raises if a task lacks fits."""
    targets = task_targets(tasks).withColumnRenamed("set_id", stratum)
    fits = stage(planned_fits(records, k, seed, stratum, key))
    counted = fit_sizes(fits, targets, stratum).groupBy("task_id").agg(F.count_distinct("fit").alias("n_fits"))
    planned = targets.select("task_id").distinct().join(counted, "task_id", "left").where(F.coalesce("n_fits", F.lit(0)) != k + 1)
    short = planned.agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("first")).first()
    if short["n"]:
        raise SplitError(f"{short['n']} tasks do not have {k + 1} fits, the first is {short['first']}")
    return fits, targets


def plan_tasks(tasks: DataFrame, records: DataFrame, k: int = K_FOLDS, seed: int = 42,
               stratum: str = "set_id", key: str = "record_id") -> DataFrame:
    """Every task with every fit: ``task_id, fit, seed, part, set_id, record_id, target``. Raises if a task lacks fits."""
    fits, targets = complete_fits(tasks, records, k, seed, stratum, key)
    return fits.join(targets, stratum)


def fit_sizes(fits: DataFrame, targets: DataFrame, stratum: str = "set_id") -> DataFrame:
    """(task_id, fit, seed, part, target, n): records are counted per fit, part and stratum before tasks come in."""
    sizes = fits.groupBy("fit", "seed", "part", stratum).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(targets, stratum).groupBy("task_id", "fit", "seed", "part", "target").agg(F.sum("n").alias("n"))


def incomplete_tasks(splits: DataFrame, k: int = K_FOLDS) -> DataFrame:
    """Tasks whose number of fits is not k + 1; ``splits`` has task and fit in any number of rows."""
    fits = splits.select("task_id", "fit").distinct().groupBy("task_id").agg(F.count(F.lit(1)).alias("n_fits"))
    return fits.where(F.col("n_fits") != k + 1)


def fold_balance(assigned: DataFrame, k: int = K_FOLDS, stratum: str = "set_id", fold: str = "test_fold") -> DataFrame:
    """Per stratum: records, smallest and largest fold. The two differ by at most one."""
    sizes = assigned.groupBy(stratum, fold).agg(F.count(F.lit(1)).alias("n"))
    smallest = F.when(F.count(F.lit(1)) == k, F.min("n")).otherwise(F.lit(0))
    return sizes.groupBy(stratum).agg(F.sum("n").alias("n_records"), smallest.alias("smallest_fold"),
                                      F.max("n").alias("largest_fold"))
