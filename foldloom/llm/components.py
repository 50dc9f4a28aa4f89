"""Connected components of a distributed graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldloom.plans.stage import drop_staged, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), undirected: one root for all nodes that are connected.

    Each round points every node to its smallest neighbour by a hashed order, follows that pointer once more, and draws the edges between
    the nodes pointed at; loops go. A constant part of the nodes goes with each round, so the work stays in proportion to the edges and
    the rounds to the logarithm of the longest chain. Minima are taken before the shuffle; joins of a much linked node can be split.
    Every round is written to the shared folder, so a lost executor costs nothing that is done. Null ends are ignored.
    """
    mixed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    pairs = edges.where("a is not null and b is not null")
    nodes = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    labels = nodes.select("node", F.col("node").alias("root"))
    # Both directions, without loops.
    links = stage(pairs.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                                               .alias("e")).select("e.a", "e.b").distinct())
    while not links.isEmpty():
        up = stage(links.groupBy("a").agg(F.min(mixed("b")).alias("least"))
                   .select(F.col("a").alias("v"), F.least(mixed("a"), F.col("least"))["v"].alias("up")))
        higher = up.select(F.col("v").alias("up"), F.col("up").alias("top"))
        nearest, up = up, stage(up.join(higher, "up").select("v", F.col("top").alias("up")))
        former, labels = labels, stage(labels.join(up, labels["root"] == up["v"], "left").select("node", F.coalesce("up", "root").alias("root")))
        drop_staged(nearest, former)
        one, two = up.select(F.col("v").alias("a"), F.col("up").alias("x")), up.select(F.col("v").alias("b"), F.col("up").alias("y"))
        former, links = links, stage(links.join(one, "a").join(two, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        drop_staged(former, up)
    return labels
