"""Record tables bucketed by their key: joins and groupings by record between them need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def write_store(df: DataFrame, name: str, path: str, key: str = "record_id", buckets: int = BUCKETS) -> DataFrame:
    """Writes ``df`` as the table ``name`` below ``path``, sorted inside ``buckets`` files by ``key``, and returns it.

    Rows are dealt once, by the hash that the buckets use, so every bucket is one file. Stores that are to be joined take the same number of buckets, chosen
    so that a bucket fits a task. An existing table or folder is not overwritten.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("errorifexists").saveAsTable(name)
    return df.sparkSession.table(name)


def attach_store(spark: SparkSession, name: str, path: str, schema: str, key: str = "record_id", buckets: int = BUCKETS) -> DataFrame:
    """A store that another application has written, under ``name`` in this session's catalog. ``schema`` and buckets are those it was written with."""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS")
    return spark.table(name)
