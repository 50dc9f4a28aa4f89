"""Hard-negative mining by slots of scores.

An anchor's positives are its best rows of the same label; each positive allows negatives within a window of scores. The upper limits of the windows cut
the scores into disjoint slots: slot j lies between the limits of the positives j and j + 1. Every task keeps the best few rows of each slot (a combiner),
tasks are merged per slot, and the answer to a positive is the start of its slot followed by all lower ones: a suffix of one descending list.
So overlapping windows share one search, and a row is looked at once for all windows of an anchor.

Anchors are a stated query set. They are divided into blocks of bounded size; each block is sent to all tasks, which read their rows in tiles. What a
task emits is bounded by anchors x slots x k, and a first search over one row in 16 gives every slot a floor that keeps most of that from being emitted: no row
below the k-th best of some rows can be among the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.centroid_clustering import bounded, integers, products
from foldloom.plans.stage import stage

#: Anchors in a block, about, and blocks searched in one job: what is sent to the tasks at once.
BLOCK, BLOCKS_AT_ONCE = 4_096, 8
#: Anchors and rows of a tile of scores.
TILE_ANCHORS, TILE_ROWS = 512, 4_096
#: One row in so many is searched first, for the floors.
FLOOR_SHARE = 16
LOWEST, HIGHEST = -(2**62), 2**62


class Best:
    """The ``k`` best (score, smaller id first, null ids last) of every group, fed in any order."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, LOWEST, dtype=np.int64)
        self.kept = self.waiting = None
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, group: np.ndarray, score: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((group, score, absent, ids))
        self.size += len(group)
        if self.size > 200_000 + 2 * self.k * len(self.floor):
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, ...]:
        group, score, absent, ids = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        order = np.lexsort((ids, absent, -score, group))
        group = group[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
        kept = rank < self.k
        order = order[kept]
        last = rank[kept] == self.k - 1
        self.floor[group[kept][last]] = score[order][last]
        self.parts = [(group[kept], score[order], absent[order], ids[order])]
        self.size = len(order)
        return self.parts[0]


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (places, matrix) of the lists of a column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.r_[0, sizes])[:-1]
    found = {}
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        found[int(d)] = (own, flat[starts[own][:, None] + np.arange(d)[None, :]].astype(np.int64))
    return found


def _lists_of(column: pa.Array, slots: int, missing: int) -> np.ndarray:
    out = np.full((len(column), slots), missing, dtype=np.int64)
    for at, values in enumerate(column.to_pylist()):
        out[at, :len(values)] = values
    return out


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    absent = np.asarray(column.is_null())
    return absent, np.asarray(column.fill_null(0)).astype(np.int64)


def _search(rows: DataFrame, anchors: pa.Table, same: bool, k: int) -> DataFrame:
    """(arid, slot, score, id): in each task the ``k`` best rows of every slot of the given anchors (rid, label, q, hi, low)."""
    anchors = anchors.combine_chunks()
    whole = {name: anchors.column(name).chunk(0) for name in anchors.column_names}
    slots = max(map(len, whole["hi"].to_pylist()))
    shared = rows.sparkSession.sparkContext.broadcast((
        np.asarray(whole["rid"]), np.asarray(whole["label"]), _by_length(whole["q"]), _lists_of(whole["hi"], slots, LOWEST), _lists_of(whole["low"], slots, HIGHEST)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid, label, vectors, hi, low = shared.value
        best = Best(hi.size, k)

        def tile(a: np.ndarray, va: np.ndarray, b: np.ndarray, vb: np.ndarray, columns: tuple[np.ndarray, ...]) -> None:
            row_rid, row_label, absent, ids = columns
            score = products(va, vb.T)
            right = label[a][:, None] == row_label[b][None, :] if same else label[a][:, None] != row_label[b][None, :]
            right &= rid[a][:, None] != row_rid[b][None, :]
            for slot in range(slots):
                group = a * slots + slot
                least = np.maximum(low[a, slot], best.floor[group])
                x, y = np.nonzero(right & (score <= hi[a, slot][:, None]) & (score >= least[:, None]))
                if len(x):
                    best.add(group[x], score[x, y], absent[b[y]], ids[b[y]])

        for batch in batches:
            columns = (np.asarray(batch.column(0)), np.asarray(batch.column(2)), *_ids(batch.column(1)))
            for d, (b, vb) in _by_length(batch.column(3)).items():
                a, va = vectors.get(d, (None, None))
                for i in range(0, 0 if a is None else len(a), TILE_ANCHORS):
                    for j in range(0, len(b), TILE_ROWS):
                        tile(a[i:i + TILE_ANCHORS], va[i:i + TILE_ANCHORS], b[j:j + TILE_ROWS], vb[j:j + TILE_ROWS], columns)
        group, score, absent, ids = best.reduce()
        yield pa.RecordBatch.from_arrays([pa.array(rid[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(ids, mask=absent)],
                                         names=["arid", "slot", "score", "id"])

    return rows.select("rid", "key", "label", "q").mapInArrow(step, "arid long, slot int, score long, id long")


def _merged(rows: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(arid, slot, score, id, rank): the ``k`` best rows of every slot over all tasks."""
    blocks = max(1, -(-anchors.count() // BLOCK))
    dealt = stage(anchors.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).repartition("block").sortWithinPartitions("block"))
    parts = []
    for start in range(0, blocks, BLOCKS_AT_ONCE):
        found = None
        for block in range(start, min(start + BLOCKS_AT_ONCE, blocks)):
            own = dealt.where(F.col("block") == block).drop("block").toArrow()  # about BLOCK anchors
            if own.num_rows:
                part = _search(rows, own, same, k)
                found = part if found is None else found.unionByName(part)
        if found is not None:
            parts.append(stage(found))
    order = Window.partitionBy("arid", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    every = parts[0] if parts else rows.sparkSession.createDataFrame([], "arid long, slot int, score long, id long")
    for part in parts[1:]:
        every = every.unionByName(part)
    return stage(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def best_rows(rows: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """As ``_merged``, with floors from one row in ``FLOOR_SHARE``."""
    some = _merged(rows.where(F.pmod(F.xxhash64("rid"), F.lit(FLOOR_SHARE)) == 0), anchors, same, k)
    floors = some.where(F.col("rank") == k).groupBy("arid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floors"))  # one entry a slot
    raised = anchors.join(floors, F.col("rid") == F.col("arid"), "left").withColumn(
        "low", F.transform("low", lambda x, i: F.greatest(x, F.try_element_at("floors", i))))
    return _merged(rows, raised.drop("arid", "floors"), same, k)


def mine(df: DataFrame, positives: int = 5, negatives: int = 10, lower: tuple[int, int] = (3, 10), upper: tuple[int, int] = (9, 10), anchor_every: int = 100,
         relabel_every: int | None = 7, labels: int = 10, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every positive of every anchor.

    Scores are inner products of floor(``scale`` * x). Higher scores come first, ties by smaller key. Anchors are the rows whose key is divisible by
    ``anchor_every``, positives the first other rows of an anchor's label, negatives the first rows of another label with ``lower`` * positive <= negative <=
    ``upper`` * positive (fractions). Where the key is divisible by ``relabel_every``, label becomes (label + 1) % ``labels`` first.

    Rows with a null label or vector, or with a null or non-finite component, take no part. Rows with a null key are no anchors and come last among
    ties. Repeated rows are rows of their own; each of several anchors with the same key has its own answers. Vectors meet those of their length
    only; empty vectors score 0. A positive without negatives (all, if its score is below 0) has no row. An empty table gives an empty result. Vectors
    whose squared integer length reaches 2^58 raise an error, as the limits would not fit a long. Further columns play no part.
    """
    own = F.col(label).cast("long")
    if relabel_every:
        own = F.when(F.col(key) % relabel_every == 0, (own + 1) % labels).otherwise(own)
    x = F.col(vector).cast("array<double>")
    square = F.aggregate("q", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = stage(df.select(F.col(key).cast("long").alias("key"), own.alias("label"), F.when(x.isNotNull(), integers(x, scale)).alias("q")).where(
        "q is not null and label is not null").where(bounded(square)).select(F.monotonically_increasing_id().alias("rid"), "key", "label", "q"))
    one = lambda value: F.array(F.lit(value).cast("long"))
    anchors = stage(rows.where(F.col("key") % anchor_every == 0).withColumns({"hi": one(HIGHEST), "low": one(LOWEST)}))
    first = best_rows(rows, anchors.drop("key"), True, positives).select("arid", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    (a, b), (c, d) = lower, upper
    first = stage(first.withColumns({"lo": F.expr(f"({a} * positive_score + pmod(-{a} * positive_score, {b})) div {b}"),
                                     "top": F.expr(f"({c} * positive_score - pmod({c} * positive_score, {d})) div {d}")}))
    limits = first.groupBy("arid").agg(F.sort_array(F.collect_list(F.struct("place", "top", "lo"))).alias("w"))  # at most ``positives`` entries
    # Slot j holds what lies above the next limit and not below its own window.
    below = F.transform("w", lambda v, i: F.greatest(v["lo"], F.get(F.col("w"), i + 1)["top"] + 1))
    slotted = anchors.drop("hi", "low", "key").join(limits, F.col("rid") == F.col("arid")).select(
        "rid", "label", "q", F.transform("w", lambda v: v["top"]).alias("hi"), below.alias("low"))
    found = best_rows(rows, stage(slotted), False, negatives)
    # All slots of an anchor in descending order: at most positives x negatives entries.
    lists = found.groupBy("arid").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("falling"))
    suffix = F.filter(F.slice(F.filter("falling", lambda v: v["slot"] >= F.col("place") - 1), 1, negatives), lambda v: v["negative_score"] >= F.col("lo"))
    named = first.join(anchors.select(F.col("rid").alias("arid"), F.col("key").alias("anchor_id")), "arid").join(lists, "arid")
    return named.select("anchor_id", "positive_id", "positive_score", F.posexplode(suffix).alias("at", "v")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "v.negative_id", "positive_score", "v.negative_score")
