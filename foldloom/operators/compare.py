"""Comparison of two sides: digest tables, recordings, arbitrary keyed tables, task lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldloom.plans.stage import stage

MATCH, MISMATCH, INCOMPARABLE = "MATCH", "MISMATCH", "INCOMPARABLE"


def diff_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per differing cell: keys, ``column``, ``left_value``, ``right_value``.

    A row that only one side has appears once, under the column ``<row>``; a column that only one side has appears once for each row of both,
    under ``<column> name``.
    """
    if columns is None:
        lonely = [c for c in [*left.columns, *right.columns] if c not in keys and (c in left.columns) != (c in right.columns)]
        note = lambda c: F.lit(f"<column> {c}").alias("column")
        value = lambda df, c: (F.lit("present") if c in df.columns else F.lit(None).cast("string"))
        shared = left.select(*keys).join(right.select(*keys), list(keys), "left_semi")
        notes = [shared.select(*keys, note(c), value(left, c).alias("left_value"), value(right, c).alias("right_value")) for c in lonely]
        found = diff_tables(left, right, keys, [c for c in left.columns if c not in keys and c in right.columns])
        for rows in notes:
            found = found.unionByName(rows)
        return found
    columns = list(columns)

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(F.lit(1).alias("_"), *[F.col(c).cast("string").alias(c) for c in columns]).alias(name))

    # The right keys get names of their own: both sides may come from one table.
    a, b = packed(left, "_l"), packed(right, "_r").withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    joined = a.join(b, condition, "full").select(*[F.coalesce(k, f"_right_{k}").alias(k) for k in keys], "_l", "_r")
    lonely = F.col("_l").isNull() | F.col("_r").isNull()

    def cell(name: str, x: Column, y: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), x.alias("left_value"), y.alias("right_value"))

    row = cell("<row>", F.when(F.col("_l").isNotNull(), "present"), F.when(F.col("_r").isNotNull(), "present"))
    cells = F.array_compact(F.array(*[
        F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), cell(c, F.col(f"_l.{c}"), F.col(f"_r.{c}")))
        for c in columns]))
    exploded = joined.select(*keys, F.explode(F.when(lonely, F.array(row)).otherwise(cells)).alias("_c"))
    return exploded.select(*keys, "_c.column", "_c.left_value", "_c.right_value")


def bucket_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    """(bucket, n, a, b): rows of each bucket of keys and two sums of 64-bit row hashes, whatever the row order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in [*keys, *columns]]
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)"))
    return df.groupBy(_bucket(keys, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), wide(1).alias("a"), wide(2).alias("b"))


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets))


def diff_large_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, buckets: int = 4_096) -> DataFrame:
    """The result of ``diff_tables`` for tables that hardly differ: buckets of keys are compared by their sums, and only rows of differing buckets are joined.

    Equal tables are read once and never joined. Tables with other column names go to ``diff_tables``, which reports these. Each key is on one row of a side.
    """
    if columns is None:
        if set(left.columns) != set(right.columns):
            return diff_tables(left, right, keys)
        columns = [c for c in left.columns if c not in keys]
    a, b = bucket_sums(left, keys, columns, buckets), bucket_sums(right, keys, columns, buckets)
    both = a.join(b.withColumnsRenamed({c: f"_{c}" for c in ("n", "a", "b")}), "bucket", "full")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b"))
    uneven = stage(both.where(~same).select("bucket"))  # at most ``buckets`` rows
    own = lambda df: df.join(uneven, _bucket(keys, buckets) == uneven["bucket"], "left_semi")
    return diff_tables(own(left), own(right), keys, columns)


def compare_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side with ``side``: ``both``, ``only_left`` or ``only_right``."""
    a = left.select(F.col(key), F.lit(1).alias("_s"))
    b = right.select(F.col(key), F.lit(2).alias("_s"))
    sides = a.unionByName(b).groupBy(key).agg(F.bit_or("_s").alias("_s"))
    return sides.select(key, F.when(F.col("_s") == 3, "both").when(F.col("_s") == 1, "only_left")
                        .otherwise("only_right").alias("side"))


def missing_per_set(left: DataFrame, right: DataFrame, key: str = "payload_hash", by: str = "set_id") -> DataFrame:
    """Payloads of the left side that the right side lacks, counted per set."""
    here, there = left.select(by, key).distinct(), right.select(by, key).distinct()
    return here.join(there, [by, key], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("n_missing"))


def diff_fingerprints(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two digest tables: ``level, scope, key, left_value, right_value, same``."""
    keys = ["level", "scope", "key"]
    a = left.select(*keys, F.col("value").alias("left_value"))
    b = right.select(*keys, F.col("value").alias("right_value"))
    return a.join(b, keys, "full").withColumn("same", F.col("left_value").eqNullSafe(F.col("right_value")))


def compare_fingerprints(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: ``status``, the level that decided, and how many digests differ.

    Different kind or schema: INCOMPARABLE. Payload digests decide when both sides have them, else record digests.
    """
    diff = diff_fingerprints(left, right)
    meta_differs = F.count_if((F.col("level") == "meta") & ~F.col("same"))
    payload = F.col("level") == "payload"
    both = (F.count_if(payload & F.col("left_value").isNotNull()) > 0) & (
        F.count_if(payload & F.col("right_value").isNotNull()) > 0)

    def differing(level: str, scope: str) -> Column:
        return F.count_if((F.col("level") == level) & (F.col("scope") == scope) & ~F.col("same"))

    base = diff.agg(meta_differs.alias("meta"), both.alias("payload_level"),
                    *[differing(lv, sc).alias(f"{lv}_{sc}") for lv in ("record", "payload") for sc in ("dataset", "fold")])
    chosen = {sc: F.when(F.col("payload_level"), F.col(f"payload_{sc}")).otherwise(F.col(f"record_{sc}"))
              for sc in ("dataset", "fold")}
    status = (F.when(F.col("meta") > 0, INCOMPARABLE).when(chosen["dataset"] + chosen["fold"] > 0, MISMATCH)
              .otherwise(MATCH))
    return base.select(status.alias("status"), F.when(F.col("payload_level"), "payload").otherwise("record").alias("level"),
                       chosen["dataset"].alias("n_dataset_differs"), chosen["fold"].alias("n_folds_differ"))


def comparison_lines(left: DataFrame, right: DataFrame, folds_shown: int = 5) -> DataFrame:
    """Report lines: every data set digest, and the first differing folds in fold order; where these are cut, a line with the key ``...`` tells how many more differ."""
    diff = diff_fingerprints(left, right)
    word = F.when(F.col("same"), MATCH).otherwise(MISMATCH)
    top = diff.where("scope <> 'fold'").select("level", "scope", "key", word.alias("result"))
    number = F.col("key").cast("bigint")
    rank = F.row_number().over(Window.partitionBy("level").orderBy(number))
    side = F.when(F.col("left_value").isNull() | F.col("right_value").isNull(), "present in only one plan").otherwise(MISMATCH)
    ranked = diff.where("scope = 'fold' AND NOT same").withColumns({"_r": rank, "_n": F.count(F.lit(1)).over(Window.partitionBy("level"))})
    shown, more = F.col("_r") <= folds_shown, F.concat((F.col("_n") - folds_shown).cast("string"), F.lit(" more"))
    folds = ranked.where(F.col("_r") <= folds_shown + 1).select("level", "scope", F.when(shown, F.col("key")).otherwise("...").alias("key"), F.when(shown, side).otherwise(more).alias("result"))
    return top.unionByName(folds)


def explain_recordings(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: why two recording tables differ, from their four digests (``key, digest``)."""
    a = left.select("key", F.col("digest").alias("a"))
    b = right.select("key", F.col("digest").alias("b"))
    same = a.join(b, "key", "full").agg(*[
        F.bool_or((F.col("key") == k) & F.col("a").eqNullSafe(F.col("b"))).alias(k)
        for k in ("data_order", "signal_set", "file_order", "record_order")])
    cause = (F.when(F.col("data_order") & F.col("file_order") & F.col("record_order"), "identical")
             .when(F.col("data_order") & F.col("record_order"), "same signals, other file bytes")
             .when(F.col("data_order") & F.col("file_order"), "same signals, other names")
             .when(F.col("data_order"), "same signals, other file bytes and names")
             .when(F.col("signal_set"), "same signals, other order").otherwise("different signals"))
    return same.select(F.when(F.col("data_order"), MATCH).otherwise(MISMATCH).alias("status"), cause.alias("cause"))


def compare_splits(left: DataFrame, right: DataFrame, names_shown: int = 6) -> DataFrame:
    """Task digests of two sides (``task_id, digest``): counts, and the first differing task names, with ``...`` where there are more."""
    a = left.select("task_id", F.col("digest").alias("a"))
    b = right.select("task_id", F.col("digest").alias("b"))
    joined = a.join(b, "task_id", "full")
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    differs = common & (F.col("a") != F.col("b"))
    first = joined.where(differs).select("task_id").orderBy("task_id").limit(names_shown)
    names = first.agg(F.array_join(F.array_sort(F.collect_list("task_id")), ", ")).scalar()
    return joined.agg(F.count_if(common).alias("n_common"), F.count_if(differs).alias("n_differing"),
                      F.count_if(F.col("b").isNull()).alias("n_only_left"),
                      F.count_if(F.col("a").isNull()).alias("n_only_right")).withColumn("first_differing", F.concat(names, F.when(F.col("n_differing") > names_shown, " ...").otherwise("")))
