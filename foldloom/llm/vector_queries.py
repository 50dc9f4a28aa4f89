"""The registered queries on embeddings by integer products, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldloom.llm import centroid_clustering, hard_negatives

_FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_INTEGERS_SQL = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x))"
K, ROUNDS = 40, 5


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds from 40 hashed first centroids."""
    return centroid_clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=K, rounds=ROUNDS)


def _assigned_sql(n: int) -> str:
    return f"""a{n} AS MATERIALIZED (SELECT r, c, CAST(d AS BIGINT) AS d FROM (
  SELECT r, c, list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c{n}.q) + list_inner_product(c{n}.q, c{n}.q) AS d FROM v CROSS JOIN c{n})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""


def _moved_sql(n: int) -> str:
    return f"""c{n} AS MATERIALIZED (SELECT c{n - 1}.c, coalesce(m.q, c{n - 1}.q) AS q FROM c{n - 1} LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS q FROM (
    SELECT c, i, sum(CAST(q[i] AS BIGINT)) AS s, count(*) AS n FROM a{n - 1} JOIN v USING (r) CROSS JOIN range(1, 65) t(i) GROUP BY c, i) GROUP BY c) m
  ON m.c = c{n - 1}.c)"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, {_INTEGERS_SQL} AS q FROM embeddings WHERE {_FINITE_SQL} AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) - 1 AS INTEGER) AS c, q FROM v QUALIFY c < {K}),
{_assigned_sql(0)}, {", ".join(f"{_moved_sql(n)}, {_assigned_sql(n)}" for n in range(1, ROUNDS + 1))},
named AS (SELECT c, sha256(array_to_string(list_transform(q, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM c{ROUNDS})
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN named USING (c)"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hardest negatives of every positive of every hundredth row."""
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_INTEGERS_SQL} AS q
                        FROM embeddings WHERE {_FINITE_SQL} AND label IS NOT NULL),
s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, e.vec_id, e.label = a.label AS same, CAST(list_inner_product(a.q, e.q) AS BIGINT) AS score
                   FROM e a JOIN e ON a.r <> e.r AND len(a.q) = len(e.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""

QUERIES = {
    "op12_centroid_clustering": (op12_centroid_clustering, OP12_SQL),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}
