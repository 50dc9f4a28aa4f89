"""Result tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.functions.scores import json_safe
from foldloom.operators.folds import excluded_units
from foldloom.operators.profile import group_cases

# The columns of a fold manifest file, in order, and where they come from here.
MANIFEST_FILE = {
    "fold": "fold", "test_unit": "test_unit", "validation_unit": "val_group", "fit_seed": "seed", "n_train_nonseizure": "n_train_neg",
    "n_train_seizure": "n_train_pos", "n_val_nonseizure": "n_val_neg", "n_val_seizure": "n_val_pos", "n_test_nonseizure": "n_test_neg",
    "n_test_seizure": "n_test_pos", "n_train": "n_train", "n_val": "n_val", "n_test": "n_test", "n_excluded": "n_excluded",
    "test_subject": "test_group", "validation_cases": "validation_cases", "excluded_units": "excluded_units", "n_train_subjects": "n_train_groups",
    "test_single_class": "test_single_class", "name": "name", "lopo_unit": "lopo_unit",
}
UNIT_NAMES = {"group": "subject", "case": "case"}


def write_fold_manifest(manifest: DataFrame, cases: DataFrame, path: str) -> None:
    """CSV in fold order. The file form has lists of cases as text, so hand over the folds that are to be read."""
    def text(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("ordinal", value)))
        return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x[value]), ";").alias(name))

    validation = text(group_cases(cases).withColumnRenamed("group_id", "val_group"), "val_group", "case_id", "validation_cases")
    excluded = text(excluded_units(manifest, cases), "fold", "excluded_unit", "excluded_units")
    unit = F.when(F.col("unit_kind") == "group", UNIT_NAMES["group"]).otherwise(UNIT_NAMES["case"])
    rows = (manifest.join(validation, "val_group", "left").join(excluded, "fold", "left").withColumn("lopo_unit", unit)
            .withColumn("excluded_units", F.coalesce("excluded_units", F.lit(""))))
    rows.select(*[F.col(ours).alias(theirs) for theirs, ours in MANIFEST_FILE.items()]).orderBy("fold").write.mode(
        "overwrite").option("header", "true").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """The long data set report as JSON lines, in section and key order."""
    json_safe(report).orderBy("section", "key").write.mode("overwrite").json(path)


def write_eval_tables(tables: dict[str, DataFrame], path: str, predictions: DataFrame | None = None) -> None:
    """One Parquet folder per table of an evaluation; ``predictions`` are its out-of-fold rows, with the columns that they have."""
    rows = {} if predictions is None else {"out_of_fold_predictions": predictions}
    for name, table in (tables | rows).items():
        table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
