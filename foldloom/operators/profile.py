"""Counts and summaries of a record table (``record_id, case_id, group_id, label``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.functions.text import natural_key
from foldloom.plans.ordering import bracketed_percentiles, positions
from foldloom.plans.stage import stage

def _negatives() -> Column:
    return F.count_if(F.col("label") == 0).alias("n_neg")


def _positives() -> Column:
    return F.count_if(F.col("label") == 1).alias("n_pos")


def class_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("n_total"), _negatives(), _positives())


def case_counts(records: DataFrame) -> DataFrame:
    """Class counts per (group, case), written once: every fold operator starts from this small table.

    ``n_bad`` counts the records whose label is not 0 or 1; fold operators refuse them.
    """
    bad = F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("n_bad")
    return stage(records.groupBy("group_id", "case_id").agg(_negatives(), _positives(), bad))


def group_counts(cases: DataFrame, min_per_class: int = 5) -> DataFrame:
    """Class counts per group and whether the group can serve as validation set."""
    need = max(1, int(min_per_class))
    sums = cases.groupBy("group_id").agg(F.sum("n_neg").alias("n_neg"), F.sum("n_pos").alias("n_pos"),
                                         F.count(F.lit(1)).alias("n_cases"))
    return sums.withColumn("eligible", F.least("n_neg", "n_pos") >= need)


def group_cases(cases: DataFrame) -> DataFrame:
    """(group_id, ordinal, case_id): the cases of every group in natural order, one row each, whatever the size of the group.

    The order is a global one, so no group has to fit into a task; a group's ordinals count from its first place.
    """
    placed = positions(cases.select("group_id", "case_id", natural_key("case_id").alias("_key")), "group_id", "_key", "case_id", name="_p")
    first = placed.groupBy("group_id").agg(F.min("_p").alias("_first"))
    return placed.join(first, "group_id").select("group_id", (F.col("_p") - F.col("_first") + 1).alias("ordinal"), "case_id")


def group_table(cases: DataFrame, min_per_class: int = 5) -> DataFrame:
    """Per group: class counts, number of cases, eligibility. The cases themselves are the rows of ``group_cases``."""
    return group_counts(cases, min_per_class)


def class_pivot(records: DataFrame, label_column: str, names: Sequence[str]) -> DataFrame:
    """Records per (group, case) and class name; absent classes count 0."""
    wide = records.groupBy("group_id", "case_id").pivot(label_column, list(names)).count()
    return wide.na.fill(0, subset=list(names))


def single_class_units(cases: DataFrame) -> DataFrame:
    """Cases and groups in which only one class occurs."""
    by_case = cases.select(F.lit("case").alias("unit_kind"), F.col("case_id").alias("unit"), "n_neg", "n_pos")
    by_group = group_counts(cases).select(F.lit("group").alias("unit_kind"), F.col("group_id").alias("unit"),
                                          "n_neg", "n_pos")
    return by_case.unionByName(by_group).where((F.col("n_neg") == 0) | (F.col("n_pos") == 0))


def amplitude_stats(values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median, 99th percentile and maximum of absolute values; ``values`` has one sample per row."""
    absolute = values.select(*by, F.abs(value).alias("_abs"))
    return bracketed_percentiles(absolute, "_abs", {"median_abs": 0.5, "p99_abs": 0.99, "max_abs": 1.0}, by)


def samples(df: DataFrame, signal: str, *keep: str) -> DataFrame:
    """One row per value of a flat signal."""
    return df.select(*keep, F.explode(signal).alias("sample"))


def duplicate_payloads(df: DataFrame, payload_hash: str, record: str = "record_id") -> DataFrame:
    """Every record whose payload occurs more than once, with the number of copies."""
    repeated = df.groupBy(payload_hash).agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return df.select(record, payload_hash).join(repeated, payload_hash)


def duplicate_summary(df: DataFrame, payload_hash: str) -> DataFrame:
    copies = df.groupBy(payload_hash).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.count_if(F.col("n") > 1).alias("n_duplicate_groups"),
                      F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_duplicate_records"))


def dataset_report(records: DataFrame, payload_hash: str | None = None) -> DataFrame:
    """The validation summary in long form: one row per (section, key) with a count.

    A long table keeps lists such as "all cases" or "all duplicates" whole at any size; a writer of a small
    data set can fold it into one document.
    """
    cases = case_counts(records)
    groups = group_counts(cases)
    n = F.col("n_neg") + F.col("n_pos")
    totals = cases.agg(F.sum(n).alias("total"), F.sum("n_neg").alias("negative"), F.sum("n_pos").alias("positive"))
    counts = totals.unpivot([], ["total", "negative", "positive"], "key", "n").select(
        F.lit("counts").alias("section"), "key", "n")
    parts = [counts,
             cases.select(F.lit("case").alias("section"), F.col("case_id").alias("key"), n.alias("n")),
             groups.select(F.lit("group").alias("section"), F.col("group_id").alias("key"), n.alias("n")),
             single_class_units(cases).select(F.concat(F.lit("single_class_"), "unit_kind").alias("section"),
                                              F.col("unit").alias("key"), n.alias("n"))]
    if payload_hash:
        parts.append(duplicate_payloads(records, payload_hash).select(
            F.lit("duplicate_record").alias("section"), F.col("record_id").cast("string").alias("key"),
            F.col("n_copies").alias("n")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
