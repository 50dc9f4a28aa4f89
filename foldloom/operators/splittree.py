"""Split plans as digest trees: composed from the members of each stratum, stored with their branches, compared from the root down.

A task does not choose its own members: its fits hold the strata that it names. So members are summed once per (fit, part, stratum), at most one row per
record and fit, and the digests of all tasks are composed from these sums and the tasks' targets. Sums of strata with one target add up, so two tasks
have equal digests exactly if their rows (part, record, target, seed) are equal, whatever strata they come from.

A stored tree keeps the levels below as well: buckets of each (fit, part, stratum) by the first hex digits of the record's hash, and the members. A
comparison descends only where digests differ: fits to read are named as partition filters, strata and buckets as joins with the differing branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldloom.functions.text import record_line
from foldloom.plans.digests import add_members, hash_lines, member_sums, sums_digest
from foldloom.plans.stage import stage

# Hex digits of a bucket: 4,096 for every part of every stratum.
BUCKET_DIGITS = 3
LEVELS = ("members", "buckets", "strata", "targets")
BRANCH = ("fit", "part", "set_id")


def stratum_sums(fits: DataFrame) -> DataFrame:
    """Member sums of every (fit, seed, part, stratum) of ``fits(fit, seed, part, set_id, record_id)``."""
    return member_sums(fits, F.col("record_id").cast("string"), ["fit", "seed", "part", "set_id"])


def compose(sums: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """Digests of every fit, every task and the plan from stratum sums and ``targets(task_id, set_id, target)``; no member is read."""
    kept = sums.join(targets, "set_id")
    added = add_members(kept, ["task_id", "fit", "seed", "part", "target"])
    # A fit has one line per part and target.
    lines = added.select("task_id", "fit", "n_members", record_line(
        "part", "target", "seed", "n_members", sums_digest(F.col("n_members"), F.col("lanes"))).alias("line"))
    fits = lines.groupBy("task_id", "fit").agg(F.sum("n_members").alias("n_lines"), hash_lines("line").alias("digest"))
    tasks = fits.withColumn("line", record_line("fit", "digest")).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_lines"), hash_lines("line").alias("digest"))
    plan = tasks.withColumn("line", record_line("task_id", "digest")).agg(F.count(F.lit(1)).alias("n_lines"), hash_lines("line").alias("digest"))
    return {"fit": fits, "task": tasks, "plan": plan}


def composed_split_digests(fits: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """Digests of every fit, every task and the whole plan (``n_lines, digest``); the lines of a fit are its members, those of a task its fits."""
    return compose(stage(stratum_sums(fits)), targets)


def write_split_tree(fits: DataFrame, targets: DataFrame, path: str) -> None:
    """Stores members and all levels above them. Members lie in folders by fit and part, in ranges of stratum and bucket, so a branch is a few row groups."""
    hashed = F.sha2(F.col("record_id").cast("string"), 256)
    rows = fits.select("fit", "seed", "part", "set_id", "record_id", F.substring(hashed, 1, BUCKET_DIGITS).alias("bucket"))
    order = ["fit", "part", "set_id", "bucket"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("fit", "part").parquet(f"{path}/members")
    spark = fits.sparkSession
    members = spark.read.parquet(f"{path}/members")
    sums = member_sums(members, F.col("record_id").cast("string"), ["fit", "part", "set_id", "seed", "bucket"])
    sums.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("fit", "part").parquet(f"{path}/buckets")
    add_members(spark.read.parquet(f"{path}/buckets"), ["fit", "part", "set_id", "seed"]).write.parquet(f"{path}/strata")
    targets.select("task_id", "set_id", "target").write.parquet(f"{path}/targets")


def read_split_tree(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {level: spark.read.parquet(f"{path}/{level}") for level in LEVELS}


def tree_digests(tree: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The digests of ``composed_split_digests`` from the strata of a stored tree."""
    return compose(tree["strata"], tree["targets"])


def _uneven(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys whose member sums differ; a key that one side lacks differs. A key may have several seeds."""
    def packed(table: DataFrame, name: str) -> DataFrame:
        whole = add_members(table, list(keys))
        return whole.select(*keys, F.concat_ws(",", "n_members", F.col("lanes").cast("array<string>")).alias(name))

    both = packed(left, "_a").join(packed(right, "_b"), list(keys), "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def branches(table: DataFrame, differing: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of a stored level below the differing branches: fits and parts are partition filters, deeper keys a join.

    The names of differing fits and parts are collected: the k + 1 fits of a plan and its three parts.
    """
    names = differing.agg(F.collect_set("fit").alias("fit"), F.collect_set("part").alias("part")).first()
    for column in ("fit", "part"):
        table = table.where(F.col(column).isin(sorted(names[column])))
    return table.join(differing, list(keys), "left_semi")


def differing_records(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """(fit, record_id, left_set, left_part, right_set, right_part): records whose place in a fit differs, found by descending both trees.

    A place that a side lacks is NULL. Repeated rows of a record in one part are one place, unless the sides repeat it unequally: then the record is listed.
    """
    strata = stage(_uneven(left["strata"], right["strata"], BRANCH))
    keys = (*BRANCH, "bucket")
    buckets = stage(_uneven(branches(left["buckets"], strata, BRANCH), branches(right["buckets"], strata, BRANCH), keys))

    def places(tree: dict[str, DataFrame], side: str) -> DataFrame:
        found = branches(tree["members"], buckets, keys).groupBy("fit", "record_id", "set_id", "part").agg(F.count(F.lit(1)).alias("_n"))
        return found.groupBy("fit", "record_id").agg(F.array_sort(F.collect_list(F.struct("set_id", "part", "_n"))).alias(side))  # its few places

    both = places(left, "_a").join(places(right, "_b"), ["fit", "record_id"], "full")
    part = lambda side, field: F.array_join(F.transform(F.col(side), lambda p: p[field]), "+")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        "fit", "record_id", part("_a", "set_id").alias("left_set"), part("_a", "part").alias("left_part"),
        part("_b", "set_id").alias("right_set"), part("_b", "part").alias("right_part"))


def differing_fits(left: dict[str, DataFrame], right: dict[str, DataFrame], examples: int = 3) -> DataFrame:
    """One row per task and fit whose digests differ: ``task_id, fit, side, seed_differs, targets_differ, n_records, first_records``.

    ``side`` tells fits that one side lacks. ``n_records`` counts the task's records whose part differs; ``first_records`` names the first of them by id. Where
    neither seed nor targets nor records differ, the sides repeat rows unequally or place equal records in other strata.
    """
    def digests(tree: dict[str, DataFrame], name: str) -> DataFrame:
        return compose(tree["strata"], tree["targets"])["fit"].select("task_id", "fit", F.col("digest").alias(name))

    both = digests(left, "_a").join(digests(right, "_b"), ["task_id", "fit"], "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    fits = stage(both.select("task_id", "fit", F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").otherwise("both").alias("side")))

    def lines(rows: DataFrame, keys: list[str], line: Column, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(hash_lines(line).alias(name))

    def seeds(tree: dict[str, DataFrame], name: str) -> DataFrame:
        return lines(tree["strata"].select("fit", "seed").distinct(), ["fit"], F.col("seed").cast("string"), name)

    def goals(tree: dict[str, DataFrame], name: str) -> DataFrame:
        return lines(tree["targets"], ["task_id"], record_line("set_id", "target"), name)

    apart = ~F.col("_x").eqNullSafe(F.col("_y"))
    seeded = seeds(left, "_x").join(seeds(right, "_y"), "fit", "full").select("fit", apart.alias("seed_differs"))
    goaled = goals(left, "_x").join(goals(right, "_y"), "task_id", "full").select("task_id", apart.alias("targets_differ"))
    moved = stage(differing_records(left, right))
    one = [moved.select("fit", "record_id", F.explode(F.split(f"{side}_set", "[+]")).alias("set_id")).join(tree["targets"].select("task_id", "set_id"), "set_id")
           for side, tree in (("left", left), ("right", right))]
    touched = one[0].unionByName(one[1]).select("task_id", "fit", "record_id").distinct()
    counts = touched.groupBy("task_id", "fit").agg(F.count(F.lit(1)).alias("n_records"))
    rank = F.row_number().over(Window.partitionBy("task_id", "fit").orderBy("record_id"))
    first = touched.withColumn("_r", rank).where(F.col("_r") <= examples).groupBy("task_id", "fit").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "record_id"))), lambda x: x["record_id"].cast("string")), ", ").alias("first_records"))
    found = fits.join(seeded, "fit", "left").join(goaled, "task_id", "left").join(counts, ["task_id", "fit"], "left").join(first, ["task_id", "fit"], "left")
    return found.select("task_id", "fit", "side", "seed_differs", "targets_differ", F.coalesce("n_records", F.lit(0)).alias("n_records"),
                        F.coalesce("first_records", F.lit("")).alias("first_records"))
