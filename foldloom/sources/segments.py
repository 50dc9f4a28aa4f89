"""Segment exports: one CSV per record, its manifest, and the metadata table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.functions import signal as sig
from foldloom.functions import text as tx
from foldloom.operators import rules
from foldloom.sources.constants import CHANNELS, N_SAMPLES
from foldloom.sources.files import relative_path


def read_segments(spark: SparkSession, root: str, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """One row per ``<class>/<case>/<file>.csv`` below ``root``.

    A file is one row, so its samples keep their order. Values go from text over double to float. ``header``,
    ``n_rows`` and ``labels`` are kept for ``segment_rules``.
    """
    files = (spark.read.format("binaryFile").load(root.rstrip("/") + "/*/*/*.csv")
             .withColumn("record_id", relative_path(root)))
    lines = F.filter(F.split(F.decode("content", "UTF-8"), "\r?\n", -1), lambda x: x != "")
    parsed = files.select(
        "record_id", tx.path_class("record_id").alias("label_name"), tx.path_case("record_id").alias("case_id"),
        F.sha2("content", 256).alias("file_sha256"), lines.alias("_lines"))
    rows = parsed.select(
        "*", F.split(F.col("_lines")[0], ",").alias("header"),
        F.transform(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))), lambda x: F.split(x, ",", -1)).alias("_cells"))
    n = len(channels)
    numbers = F.transform("_cells", lambda r: F.transform(
        F.slice(r, 1, n), lambda x: x.try_cast("double").cast("float")))
    return rows.select(
        "record_id", "label_name", "case_id", "file_sha256", "header", F.size("_cells").alias("n_rows"),
        F.array_distinct(F.transform("_cells", lambda r: F.get(r, F.lit(n)).try_cast("int"))).alias("labels"),
        numbers.alias("_n")).select("*", sig.to_channel_major("_n", n).alias("signal")).drop("_n").withColumn(
        "label", F.get("labels", F.lit(0)))


def segment_rules(channels: Sequence[str] = CHANNELS, samples: int = N_SAMPLES) -> list[rules.Rule]:
    """Rules of one segment file: header order, row count, one label, label = folder, finite values."""
    header = F.array(*[F.lit(c) for c in [*channels, "label"]])
    return [
        rules.Rule("segment_header", ~F.col("header").eqNullSafe(header), F.array_join("header", ",")),
        rules.Rule("segment_rows", F.col("n_rows") != samples, F.col("n_rows").cast("string")),
        rules.Rule("segment_labels", F.size("labels") != 1, F.array_join(F.col("labels").cast("array<string>"), ",", "NULL")),
        rules.label_name_agrees(),
        rules.Rule("non_finite", ~sig.is_finite(F.flatten("signal")), F.lit("NaN, infinite or missing value")),
    ]


def read_segment_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The all-text segment manifest; backslashes in ``segment_file`` become slashes."""
    table = spark.read.option("header", "true").csv(path)
    return table.withColumn("segment_file", F.replace("segment_file", F.lit("\\"), F.lit("/")))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The all-text metadata table: empty text stays text, ``segment_index`` is coerced, ``record_id`` is added."""
    table = spark.read.option("header", "true").csv(path)
    table = table.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in table.columns])
    if "segment_index" in table.columns:
        table = table.withColumn("segment_index", tx.coerce_index("segment_index"))
    return table.withColumn("record_id", F.col("segment_id"))


def read_channel_sources(spark: SparkSession, reports: dict[str, tuple[str, str]]) -> DataFrame:
    """Declared channel lists ``name, channels`` from JSON documents: ``{name: (path, key)}``."""
    parts = []
    for name, (path, key) in reports.items():
        schema = f"`{key}` array<string>"
        parts.append(spark.read.schema(schema).option("multiLine", "true").json(path)
                     .where(F.col(key).isNotNull())
                     .select(F.lit(name).alias("record_id"), F.col(key).alias("channels")))
    return rules.union_violations(parts)


def check_channel_sources(sources: DataFrame, channels: Sequence[str] = CHANNELS, required: bool = True) -> DataFrame:
    """Violations of the channel order rule; without any source the rule is broken too, unless waived."""
    found = rules.check_records(sources, [rules.channels_agree("channels", channels)])
    if not required:
        return found
    none = sources.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("channel_order").alias("rule"), F.lit("error").alias("severity"), F.lit("all").alias("record_id"),
        F.lit("no channel list found").alias("detail"))
    return found.unionByName(none)


def read_report_settings(spark: SparkSession, path: str) -> DataFrame:
    """Declared ``fs`` and ``n_samples`` of an export report; only the declared ones are checked."""
    return (spark.read.schema("fs int, n_samples int").option("multiLine", "true").json(path)
            .select(F.lit("report").alias("record_id"), "fs", "n_samples"))


def settings_rules(fs: int, samples: int) -> list[rules.Rule]:
    return [rules.Rule(f"declared_{name}", F.col(name).isNotNull() & (F.col(name) != value), rules.shown(name))
            for name, value in (("fs", fs), ("n_samples", samples))]


def write_segments(df: DataFrame, path: str, buckets: int = 64, group: str = "group_id") -> None:
    """Parquet partitioned by a bucket of the group: a fold reads few buckets, a hot group spans many files."""
    bucketed = df.withColumn("group_bucket", F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int"))
    bucketed.write.mode("overwrite").partitionBy("group_bucket").parquet(path)
