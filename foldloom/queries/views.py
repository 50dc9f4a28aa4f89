"""The given tables as record tables, once as DataFrames and once as SQL (CTE bodies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# High enough that some groups cannot serve as validation set.
MIN_PER_CLASS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefixed(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: user = case, pairs of users = group, error = positive."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"), prefixed("u", user).alias("case_id"),
        prefixed("g", F.floor(user / 2)).alias("group_id"), (F.col("event_type") == "error").cast("int").alias("label"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("prob"))


RECORDS = """records AS (
  SELECT event_id AS record_id, 'u' || user_id AS case_id, 'g' || (user_id // 2) AS group_id, user_id,
         user_id // 2 AS gid, CAST(event_type = 'error' AS INT) AS label, least(value / 100, 1.0) AS prob
  FROM events)"""


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items scored by discount (11 scores): supplier = case, nation = group, returned = positive."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_discount")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
    return joined.select(prefixed("s", F.col("l_suppkey")).alias("case_id"), prefixed("n", F.col("s_nationkey")).alias("group_id"),
                         (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 10).alias("prob"))


TIES = """ties AS (
  SELECT 's' || l_suppkey AS case_id, 'n' || s_nationkey AS group_id, CAST(l_returnflag = 'R' AS INT) AS label,
         l_discount * 10 AS prob
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: source = group, source and language = case, quality = label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("record_id"), F.col("source").alias("group_id"),
        F.concat_ws("-", "source", "lang").alias("case_id"), F.col("quality").alias("label"),
        F.sha2("text", 256).alias("payload_hash"))


TEXTS = """texts AS (
  SELECT d.doc_id AS record_id, source AS group_id, source || '-' || lang AS case_id, quality AS label,
         sha256(text) AS payload_hash, CAST(substr(source, 4) AS INT) AS gid
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as recordings: label modulo 5 = set; the sum of every tenth value from the c-th on = score of class c."""
    letters = F.array(*[F.lit(s) for s in "ZONFS"])
    own = lambda c: F.filter("embedding", lambda _, i: i % 10 == c)
    scores = F.array(*[F.round(F.aggregate(own(c), F.lit(0.0), lambda s, x: s + x.cast("double")), 6) for c in range(10)])
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record_id"), F.element_at(letters, (F.col("label") % 5 + 1).cast("int")).alias("set_id"),
        F.col("label").alias("truth"), F.col("embedding").alias("signal"), scores.alias("probs"),
        (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("pred"))


VECTORS = """vectors AS (
  SELECT vec_id AS record_id, ['Z','O','N','F','S'][label % 5 + 1] AS set_id, label AS truth, embedding AS signal,
         probs, list_position(probs, list_max(probs)) - 1 AS pred
  FROM (SELECT *, list_transform(range(10), lambda c: round(list_sum(list_transform(
    range(c + 1, len(embedding) + 1, 10), lambda i: CAST(embedding[i] AS DOUBLE))), 6)) AS probs FROM embeddings))"""


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
