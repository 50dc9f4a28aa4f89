"""Single-channel recordings: text files of one number per line, in one folder per set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.plans.ordering import positions
from foldloom.sources.constants import RECORDING_SETS
from foldloom.sources.files import list_files


class LayoutError(ValueError):
    """A set folder is missing or occurs under several names."""


def read_recordings(spark: SparkSession, root: str, sets: dict[str, tuple[str, ...]] = RECORDING_SETS) -> DataFrame:
    """``ordinal, set_id, record_id, signal, file_hash``; load order is set by set, then by path."""
    names = [(alias, set_id, i) for i, (set_id, aliases) in enumerate(sets.items()) for alias in aliases]
    folders = spark.createDataFrame(names, "folder string, set_id string, set_pos int")
    files = (list_files(spark, root, "*.[tT][xX][tT]")
             .where(~F.array_contains(F.split("rel", "/"), "__MACOSX"))
             .withColumn("folder", F.substring_index("rel", "/", 1)).join(F.broadcast(folders), "folder"))
    found = files.groupBy("set_id").agg(F.count_distinct("folder").alias("n")).collect()
    counts = {r["set_id"]: r["n"] for r in found}
    wrong = {s: counts.get(s, 0) for s in sets if counts.get(s, 0) != 1}
    if wrong:
        raise LayoutError(f"expected exactly one folder per set, found {wrong}")
    order = positions(files.select("set_pos", "rel"), "set_pos", "rel", name="ordinal").select("rel", "ordinal")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    tokens = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    # The signal is the text's double values in float32, as the payload hash is defined on float32.
    return files.select(
        "rel", "set_id", F.transform(tokens, lambda x: x.try_cast("double").cast("float")).alias("signal"),
        F.sha2("content", 256).alias("file_hash")).join(order, "rel").select(
        "ordinal", "set_id", F.col("rel").alias("record_id"), "signal", "file_hash")
