"""Files as rows: relative paths, content hashes, manifests.

``binaryFile`` gives one row per file (2 GB at most per file); the content column is only read when used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.plans.stage import stage
from foldloom.sources.constants import SKIPPED_NAMES, SKIPPED_SUFFIXES


def relative_path(root: str, path: Column | None = None) -> Column:
    """Path below ``root``."""
    column = F.col("path") if path is None else path
    base = root.rstrip("/") + "/"
    return F.substr(column, F.locate(base, column) + F.lit(len(base)))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """All files below ``root`` whose name matches, with ``path, modificationTime, length, content``."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(root).withColumn("rel", relative_path(root)))


def _kept(files: DataFrame) -> DataFrame:
    parts = F.split("rel", "/")
    name = F.element_at(parts, -1)
    skipped = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in SKIPPED_NAMES])) | name.startswith("._")
    for suffix in SKIPPED_SUFFIXES:
        skipped = skipped | name.endswith(suffix)
    return files.where(~skipped)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, sha256`` of every file except junk names and suffixes."""
    files = _kept(list_files(spark, root))
    return files.select(F.col("rel").alias("path"), "length", F.sha2("content", 256).alias("sha256"))


STATE = "path string, length bigint, modified timestamp, sha256 string"
# Changed files that are named to Spark in one read.
PATHS_AT_ONCE = 5_000


def scan_changed(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """(path, length, modified, sha256, hashed) of every file of ``scan_files``: hashes of files that ``known`` lists with the same length and time are taken over.

    ``known`` has the first four columns, as an earlier scan gave them and the caller stored them (None: nothing is known). Only files that are new or changed are
    opened: over an unchanged tree nothing is hashed. Their names reach the driver in blocks.
    """
    if known is None:
        found = _kept(list_files(spark, root))
        return found.select(F.col("rel").alias("path"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.lit(True).alias("hashed"))
    listed = _kept(list_files(spark, root)).select(F.col("path").alias("at"), F.col("rel").alias("path"), "length", F.col("modificationTime").alias("modified"))
    judged = stage(listed.join(known.select("path", "length", "modified", "sha256"), ["path", "length", "modified"], "left"))
    out = judged.where("sha256 IS NOT NULL").select("path", "length", "modified", "sha256", F.lit(False).alias("hashed"))
    fresh = judged.where("sha256 IS NULL").select("at", F.pmod(F.xxhash64("at"), F.lit(max(1, -(-judged.where("sha256 IS NULL").count() // PATHS_AT_ONCE)))).alias("block"))
    for block in range(fresh.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]):
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["at"]) for r in fresh.where(F.col("block") == block).collect()]
        if paths:
            rows = spark.read.format("binaryFile").load(paths).withColumn("rel", relative_path(root))
            out = out.unionByName(rows.select(F.col("rel").alias("path"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.lit(True).alias("hashed")))
    return out


def read_file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``sha256  path`` lines as ``path, sha256``; a leading ``*`` of the path marks binary mode."""
    line = F.trim("value")
    pieces = F.regexp_extract(line, r"^(\S+)\s+\*?(.*)$", 2)
    return (spark.read.text(path).where(line != "")
            .select(pieces.alias("path"), F.regexp_extract(line, r"^(\S+)", 1).alias("sha256")))
