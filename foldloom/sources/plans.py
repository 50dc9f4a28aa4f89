"""Fold plans on disk: a folder with heads and members as Parquet, and one line of JSON that says what they were built on.

Digests are trees over rows, so a plan of any size is written and checked without passing through the driver. A plan kept as a single JSON
document can be read, and written again as a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions.text import normalize_hash
from foldloom.operators.fingerprints import record_id_line, record_line
from foldloom.operators.folds import FoldPlanError
from foldloom.operators.plancheck import HEAD_FIELDS, check_plan
from foldloom.plans.digests import tree_digest

PLAN_FORMAT = "foldloom-plan/1"
INFO_SCHEMA = ("format string, unit_kind string, min_per_class bigint, seed bigint, n_folds bigint, n_records bigint, plan_digest string, "
               "records_digest string, payload_digest string")
# Folds lie in folders of their own; a fold's rows are as many as the records, so they are written by several tasks.
FILES_A_FOLD = 8

# The fields of a plan document.
_FOLD = ("fold bigint, name string, unit string, test_unit string, test_subject string, val_subject string, "
         "excluded_units array<string>, seed bigint, train array<string>, val array<string>, test array<string>")
PLAN_SCHEMA = (f"format string, record_id_column string, params struct<lopo_unit:string,min_val_per_class:bigint,"
               f"seed:bigint>, n_records bigint, n_folds bigint, records_sha256 string, signals_sha256 string, "
               f"plan_sha256 string, folds array<struct<{_FOLD}>>")


def plan_digest(folds: DataFrame, members: DataFrame) -> str:
    """One digest over the heads and all members, whatever their order and partitioning."""
    heads = tree_digest(folds, record_line("fold", "unit_kind", *[c for c in HEAD_FIELDS if c in folds.columns])).first()["digest"]
    rows = tree_digest(members, record_line("fold", "part", "record_id")).first()
    return f"{heads}:{rows['n_lines']}:{rows['digest']}"


def data_digests(records: DataFrame, payload_hash: str | None = None) -> dict[str, str | None]:
    """Digests of the record table (ids, owners, labels) and, if given, of its payloads."""
    out = {"records_digest": tree_digest(records, record_id_line()).first()["digest"], "payload_digest": None}
    if payload_hash:
        line = F.concat_ws("\t", F.col("record_id").cast("string"), normalize_hash(payload_hash))
        out["payload_digest"] = tree_digest(records, line).first()["digest"]
    return out


def write_plan_table(folds: DataFrame, members: DataFrame, records: DataFrame, path: str, min_per_class: int, seed: int,
                     payload_hash: str | None = None) -> None:
    """Heads, members by fold, and the line of settings and digests."""
    path, spark = path.rstrip("/"), folds.sparkSession
    folds.write.mode("overwrite").parquet(f"{path}/heads")
    part = F.pmod(F.xxhash64("record_id"), F.lit(FILES_A_FOLD))
    members.select("fold", "part", "record_id").repartition("fold", part).write.mode("overwrite").partitionBy("fold").parquet(f"{path}/members")
    info = {"format": PLAN_FORMAT, "unit_kind": folds.agg(F.min("unit_kind")).first()[0], "min_per_class": min_per_class, "seed": seed,
            "n_folds": folds.count(), "n_records": records.count(), "plan_digest": plan_digest(folds, members), **data_digests(records, payload_hash)}
    spark.createDataFrame([info], INFO_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/info")


def read_plan_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(info, folds, members)`` of a plan folder."""
    path = path.rstrip("/")
    members = spark.read.parquet(f"{path}/members").withColumn("fold", F.col("fold").cast("bigint"))
    return spark.read.schema(INFO_SCHEMA).json(f"{path}/info"), spark.read.parquet(f"{path}/heads"), members.select("fold", "part", "record_id")


def read_plan_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(info, folds, members)`` of a plan document."""
    body = spark.read.schema(PLAN_SCHEMA).option("multiLine", "true").json(path)
    info = body.drop("folds")
    entry = body.select(F.explode("folds").alias("f"))
    kind = F.when(F.col("f.unit") == "subject", "group").otherwise(F.col("f.unit"))
    folds = entry.select("f.fold", "f.name", kind.alias("unit_kind"), "f.test_unit",
                         F.col("f.test_subject").alias("test_group"), F.col("f.val_subject").alias("val_group"),
                         F.coalesce("f.excluded_units", F.array().cast("array<string>")).alias("excluded_units"), "f.seed")
    parts = F.map_from_arrays(F.array(*[F.lit(p) for p in ("train", "val", "test")]),
                              F.array("f.train", "f.val", "f.test"))
    members = entry.select("f.fold", F.explode(parts).alias("part", "ids")).select(
        "fold", "part", F.explode("ids").alias("record_id"))
    return info, folds, members


def replay_plan(spark: SparkSession, path: str, records: DataFrame, payload_hash: str | None = None,
                wanted: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Heads and members of a saved plan after all checks; raises ``FoldPlanError`` on the first failure.

    Checked in turn: format, digest of the contents, number of records, data digests, requested settings, plan rules. Row order and
    partitioning of the data do not matter.
    """
    info, folds, members = read_plan_table(spark, path)
    head = info.first()
    if head is None or head["format"] != PLAN_FORMAT:
        raise FoldPlanError(f"unknown plan format; expected {PLAN_FORMAT}")
    if plan_digest(folds, members) != head["plan_digest"]:
        raise FoldPlanError("plan_digest does not match the fold contents: the plan was modified")
    n = records.count()
    if head["n_records"] != n:
        raise FoldPlanError(f"the plan covers {head['n_records']} records, the data has {n}")
    for key, value in data_digests(records, payload_hash).items():
        if value is not None and head[key] is not None and head[key] != value:
            raise FoldPlanError(f"{key} differs: this is not the data the plan was built on")
    differ = {k: (head[k] if k in head.asDict() else None, v) for k, v in (wanted or {}).items() if head.asDict().get(k) != v}
    if differ:
        raise FoldPlanError(f"the plan was built with different settings (plan, requested): {differ}")
    broken = check_plan(members, folds, records, head["min_per_class"] or 1)
    counts = broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy("rule").collect()  # one row a rule at most
    if counts:
        raise FoldPlanError(f"plan rules are broken: {[tuple(r) for r in counts]}; check_plan lists the folds")
    return folds, members
