"""Fingerprints of records, plans and splits, and the comparison of two sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.functions.text import normalize_hash, record_line
from foldloom.plans.digests import add_members, hash_lines, member_sums, minus_lanes, sums_digest, tree_digest, tree_parts
from foldloom.plans.stage import stage

SCHEMA_VERSION = "1"


def record_id_line() -> Column:
    return record_line("record_id", "group_id", "case_id", "label")


def records_digest(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ids, owners and labels, whatever the row order."""
    return tree_digest(records, record_id_line(), by)


def payload_digest(records: DataFrame, payload_hash: str = "payload_hash", by: Sequence[str] = ()) -> DataFrame:
    return tree_digest(records, record_line("record_id", normalize_hash(payload_hash)), by)


def signal_label_digest(records: DataFrame, payload_hash: str = "payload_hash") -> DataFrame:
    return tree_digest(records, F.concat_ws(":", payload_hash, F.col("label").cast("string")))


def owner_digest(records: DataFrame, payload_hash: str = "payload_hash") -> DataFrame:
    return tree_digest(records, F.concat_ws(":", payload_hash, "group_id", "case_id"))


def ordered_digest(df: DataFrame, ordinal: str, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Order-sensitive digest: the explicit position is part of every line."""
    return tree_digest(df, record_line(ordinal, value), by)


def keyed_digests(df: DataFrame, lines: dict[str, Column]) -> DataFrame:
    """Several digests of one table in one pass: ``key, n_lines, digest``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("line")) for k, v in lines.items()])
    long = df.select(F.explode(pairs).alias("p")).select("p.key", "p.line")
    return tree_digest(long, F.col("line"), ["key"])


def recording_digests(recordings: DataFrame) -> DataFrame:
    """Load order of signals, their set, file bytes and names: ``key, n_lines, digest``.

    ``recordings(ordinal, set_id, record_id, payload_hash, file_hash)``.
    """
    return keyed_digests(recordings, {
        "data_order": record_line("ordinal", "set_id", "payload_hash"),
        "signal_set": record_line("set_id", "payload_hash"),
        "file_order": record_line("ordinal", "set_id", "file_hash"),
        "record_order": record_line("ordinal", "record_id")})


def split_digests(splits: DataFrame) -> dict[str, DataFrame]:
    """Digest of every fit, every task and the whole split plan, from one pass over the rows."""
    return _upper_digests(tree_digest(splits, member_line(), ["task_id", "fit"]))


def member_line() -> Column:
    return record_line("part", "record_id", "target", "seed")


def task_digests(fits: DataFrame) -> DataFrame:
    """Digest of every task from those of its fits."""
    return stage(tree_digest(fits, record_line("fit", "digest"), ["task_id"]))


def _upper_digests(fits: DataFrame) -> dict[str, DataFrame]:
    fits = stage(fits)
    tasks = task_digests(fits)
    return {"fit": fits, "task": tasks, "plan": tree_digest(tasks, record_line("task_id", "digest"))}


def planned_fit_digests(fits: DataFrame, targets: DataFrame) -> DataFrame:
    """``task_id, fit, n_lines, digest``: the fit digests of ``split_digests(fits.join(targets, "set_id"))``, without a row per task and record before a shuffle.

    The line of a member depends on its target and not on the task, so each member is hashed and shuffled once per target of its set; the tasks take
    their lines out of every branch. ``targets`` has one row per task and set; the list of tasks is a single value.
    """
    kind = record_line("set_id", "target")
    wanted = targets.groupBy("task_id").agg(F.collect_set(kind).alias("kinds")).agg(F.collect_list(F.struct("task_id", "kinds")))
    lines = fits.join(F.broadcast(targets.select("set_id", "target").distinct()), "set_id")
    parts = tree_parts(lines.select("fit", kind.alias("kind"), member_line().alias("line")), "line", "kind", ["fit"], wanted.scalar(), "kinds")
    return parts.groupBy("part.task_id", "fit").agg(F.sum("n").alias("n_lines"), hash_lines("entry").alias("digest"))


def planned_split_digests(fits: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """``split_digests`` of a plan given by its fits and the targets of its tasks."""
    return _upper_digests(planned_fit_digests(fits, targets))


def plan_part_sums(members: DataFrame, line: Column, positive: Column | None = None) -> DataFrame:
    """Member sums per (fold, part) of a plan in row form."""
    return member_sums(members, line, ["fold", "part"], positive)


def case_sums(records: DataFrame, line: Column) -> DataFrame:
    """Member sums per (group, case): the base of all fold digests."""
    return stage(member_sums(records, line, ["group_id", "case_id"], F.col("label") == 1))


PARTS = ("train", "val", "test")


def rule_part_sums(folds: DataFrame, sums: DataFrame) -> DataFrame:
    """Member sums per (fold, part) of a plan given by its heads: no member list is built.

    Sums subtract, so training is all records minus the validation and test groups.
    """
    def packed(table: DataFrame, name: str, *keys: str) -> DataFrame:
        return table.select(*keys, F.struct("n_members", "n_pos", "lanes").alias(name))

    groups = add_members(sums, ["group_id"])
    # A case has one owner, so case ids and group ids can be looked up in one table of units.
    units = (add_members(sums, ["case_id"]).withColumnRenamed("case_id", "test_unit").withColumn("unit_kind", F.lit("case"))
             .unionByName(groups.withColumnRenamed("group_id", "test_unit").withColumn("unit_kind", F.lit("group"))))
    whole = packed(add_members(sums), "all").scalar()
    wide = (folds.select("fold", "unit_kind", "test_unit", "test_group", "val_group")
            .join(packed(units, "test", "unit_kind", "test_unit"), ["unit_kind", "test_unit"])
            .join(packed(groups.withColumnRenamed("group_id", "test_group"), "own", "test_group"), "test_group")
            .join(packed(groups.withColumnRenamed("group_id", "val_group"), "val", "val_group"), "val_group")
            .withColumn("all", whole))

    def rest(field: str) -> Column:
        return F.col(f"all.{field}") - F.col(f"own.{field}") - F.col(f"val.{field}")

    train = F.struct(rest("n_members").alias("n_members"), rest("n_pos").alias("n_pos"),
                     minus_lanes(F.col("all.lanes"), F.col("own.lanes"), F.col("val.lanes")).alias("lanes"))
    parts = F.array(*[F.struct(F.lit(name).alias("part"), side.alias("s"))
                      for name, side in zip(PARTS, (train, F.col("val"), F.col("test")))])
    return wide.select("fold", F.explode(parts).alias("p")).select("fold", "p.part", "p.s.n_members", "p.s.n_pos", "p.s.lanes")


def part_digests(part_sums: DataFrame) -> DataFrame:
    return part_sums.select("fold", "part", "n_members", "n_pos",
                            sums_digest(F.col("n_members"), F.col("lanes")).alias("digest"))


def fold_digests(folds: DataFrame, digests: DataFrame) -> DataFrame:
    """One digest per fold over its head, part sizes, positives and part digests."""
    wide = digests.groupBy("fold").agg(*[
        F.max(F.when(F.col("part") == p, record_line("n_members", "n_pos", "digest"))).alias(p) for p in PARTS])
    head = record_line("fold", "test_unit", "val_group", "seed", *PARTS)
    return folds.select("fold", "test_unit", "val_group", "seed").join(wide, "fold").select(
        "fold", F.sha2(head, 256).alias("digest"))


def fold_table_digest(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return tree_digest(per_fold, record_line("fold", "digest"), by)


def fingerprint(records: DataFrame, folds: DataFrame, payload_hash: str | None = None,
                ordinal: str | None = None) -> DataFrame:
    """Long digest table ``level, scope, key, value`` of a data set and its fold plan.

    Levels: ``meta`` decides whether two tables can be compared; ``record`` is keyed by record ids; ``payload``
    exists when payload hashes are given, and then decides alone; ``note`` never decides.
    """
    spark = records.sparkSession
    lines = {"record/records": record_id_line()}
    fold_lines = {"record": record_line("record_id")}
    if payload_hash:
        signal = F.concat_ws(":", normalize_hash(payload_hash), F.col("label").cast("string"))
        lines["payload/signals"] = signal
        lines["payload/owners"] = F.concat_ws(":", normalize_hash(payload_hash), "group_id", "case_id")
        fold_lines["payload"] = normalize_hash(payload_hash)
        if ordinal:
            lines["note/row_order"] = record_line(ordinal, signal)
    per_fold = None
    for level, line in fold_lines.items():
        rows = fold_digests(folds, part_digests(rule_part_sums(folds, case_sums(records, line))))
        rows = rows.withColumn("level", F.lit(level))
        per_fold = rows if per_fold is None else per_fold.unionByName(rows)
    per_fold = stage(per_fold)
    label = F.split("key", "/")
    meta = spark.createDataFrame(
        [("meta", "meta", "kind", "grouped-plan"), ("meta", "meta", "schema", SCHEMA_VERSION)],
        "level string, scope string, key string, value string")
    data = keyed_digests(records, lines).select(
        label[0].alias("level"), F.lit("dataset").alias("scope"), label[1].alias("key"), F.col("digest").alias("value"))
    tables = fold_table_digest(per_fold, ["level"]).select(
        "level", F.lit("dataset").alias("scope"), F.lit("fold_table").alias("key"), F.col("digest").alias("value"))
    single = per_fold.select("level", F.lit("fold").alias("scope"), F.col("fold").cast("string").alias("key"),
                             F.col("digest").alias("value"))
    return stage(meta.unionByName(data).unionByName(tables).unionByName(single))
