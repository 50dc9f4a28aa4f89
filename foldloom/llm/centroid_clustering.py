"""Centroid clustering over an incremental distance matrix of exact integers.

Vectors become integers, and every vector keeps its dot products with all centroids beside it in a written table. A round takes the
sums of each cluster (added up inside each task first), moves the centroids, and changes the stored products only by the components in which a centroid
moved: dot(v, new) = dot(v, old) + sum over moved components of v[i] * (new[i] - old[i]). The nearest centroid follows from |v|^2 - 2 dot + |c|^2, so no
distance is computed anew. All numbers are integers: a result does not depend on the order of rows, tasks or retries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.plans.stage import drop_staged, stage

#: Squared lengths of vectors stay below this, so that distances and the products of two vectors fit a long.
MAX_SQUARE = 2**58
#: Products are exact in doubles below this; from there on they are computed in 64-bit integers, which is slower.
EXACT = 2**53


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if the vector is null or holds a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x)))


def bounded(square: Column) -> Column:
    """True, or an error for a vector that is too long for 64-bit results."""
    return F.when(square >= float(MAX_SQUARE), F.raise_error(F.lit("a vector is too long for 64-bit distances")).cast("boolean")).otherwise(True)


def quantised(df: DataFrame, key: str, vector: str, scale: int, dims: int | None) -> DataFrame:
    """(key, q): the vectors that take part, as integers."""
    x = F.col(vector).cast("array<double>")
    right = x.isNotNull() if dims is None else F.size(x) == dims
    whole = df.select(F.col(key).alias("key"), F.when(right, integers(x, scale)).alias("q")).where("q is not null")
    square = F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return whole.where(bounded(square))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integers, exactly."""
    if not a.size or not b.size:
        return np.zeros((len(a), b.shape[1]), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of their key: bounded by k. Null keys come last, equal hashes by components."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    found = rows.select(rank.alias("rank"), "q").orderBy(F.asc_nulls_last("rank"), "q").limit(k).collect()
    return np.array([r["q"] for r in found], dtype=np.int64)


def _assign(dots: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of several), and |c|^2 - 2 dot with it."""
    gap = lengths[None, :] - 2 * dots
    nearest = gap.argmin(axis=1)
    return nearest, gap[np.arange(len(gap)), nearest]


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1] if values.size else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _updated(table: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """(key, q, dots, cluster, distance) with products brought from the ``old`` centroids (None: there are no products yet) to the ``new`` ones."""
    change = new if old is None else new - old
    shared = table.sparkSession.sparkContext.broadcast((change, (new * new).sum(axis=1)))  # k x dims integers

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        delta, lengths = shared.value
        moved = [np.flatnonzero(row) for row in delta]
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column(1))
            if batch.num_columns > 2:
                dots = matrix(batch.column(2)).copy()
                for j, own in enumerate(moved):
                    if len(own):
                        dots[:, j] += products(q[:, own], delta[j, own][:, None])[:, 0]
            else:
                dots = products(q, delta.T)
            cluster, gap = _assign(dots, lengths)
            distance = gap + (q * q).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             names=["key", "q", "dots", "cluster", "distance"])

    wanted = table.select("key", "q") if old is None else table.select("key", "q", "dots")
    return wanted.mapInArrow(step, T.StructType([
        table.schema["key"], T.StructField("q", T.ArrayType(T.LongType())), T.StructField("dots", T.ArrayType(T.LongType())),
        T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid as the exact floor of its cluster's mean; empty clusters keep theirs. One row a cluster comes back."""
    dims = centroids.shape[1]
    sums = table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.get("q", F.lit(i))).alias(f"s{i}") for i in range(dims)))
    new = centroids.copy()
    for row in sums.collect():
        new[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return new


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, seed: int = 2, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dims`` components, none null or non-finite.

    Other vectors (null, empty, of another length) have no row. Repeated rows count as often as they occur. With fewer than ``k`` vectors each is a
    centroid; equal centroids share no vector, the smaller number takes all. Null keys take part and are first centroids only behind all
    others. An empty table gives an empty result. Vectors whose squared integer length reaches 2^58 raise an error, as a distance would not fit a long.
    Further columns play no part.
    """
    spark = df.sparkSession
    rows = stage(quantised(df, key, vector, scale, dims))
    centroids = _first_centroids(rows, k, seed)
    kind = df.schema[key].dataType
    if not len(centroids):
        return spark.createDataFrame([], T.StructType([
            T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")),
            T.StructField("centroid_sha256", T.StringType())]))
    table = stage(_updated(rows, None, centroids))
    drop_staged(rows)  # every round's table holds all that the next one needs
    for _ in range(rounds):
        new = _moved(table, centroids)
        if (new == centroids).all():
            break  # later rounds would change nothing
        former, table = table, stage(_updated(table, centroids, new))
        drop_staged(former)
        centroids = new
    inertia = {r["cluster"]: int(r["d"]) for r in table.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row a cluster
    named = [(c, own, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, own in sorted(inertia.items())]
    summary = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.select("key", "cluster", "distance").join(F.broadcast(summary), "cluster").select(  # one row a cluster
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
