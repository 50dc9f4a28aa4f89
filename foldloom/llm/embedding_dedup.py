"""Embedding near-dedup: a dual traversal of cover trees finds all pairs of vectors above a cosine threshold.

Equal vectors become one class with a weight. The upper levels of the tree are a table: classes are divided into cells around spread-out centres, crowded
cells around centres of their own, and so on until a chunk fits a task. Every chunk gets a cover tree: nested levels with halving radii over unit vectors,
each node with the exact radius that covers what is below it. Pairs of chunks, unless their radii keep them apart, meet in work units, those of two blocks of
neighbouring chunks in one: a dual traversal goes down both trees and drops node pairs that are too far apart. Node pairs that are close as a whole link without being taken apart, so a dense
group costs no pair per link. Only between are cosines computed: in single precision first, and in double precision wherever that could decide otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldloom.llm.components import components
from foldloom.plans.stage import drop_staged, stage

# Bounds of what the driver handles at once: sampled vectors for the centres, and centres of the top level. Every vector is assigned to its nearest centre.
SAMPLE, MAX_CENTRES = 4_000, 1_000
# How often crowded cells are divided by place; what is crowded still then has hardly any extent and is divided by hash.
DIVISIONS = 6
# Vectors in a chunk, about; two chunks with their trees fit easily in a task.
CHUNK_ROWS = 8_192
# Radii of the levels below the root, which covers everything (unit vectors are at most 2 apart).
RADII = (1.0, 0.5, 0.25, 0.125)
# Bounds of the radii that share a tile.
CLASSES = (0.0, 0.125, 0.25, 0.5, 1.0)
# Bounds by the triangle inequality are trusted only this far from the threshold; nearer pairs are computed.
MARGIN = 1e-5
TILE = 1_024
# Values of vectors that are gathered at once.
MAX_VALUES = 2**21
# Node pairs with so many pairs of points below them, or fewer, are compared point by point.
LEAF_PAIRS = 65_536
# So many pairs of points take about as long to compare as a comparison of its own costs besides.
CALL_PAIRS = 16_384
# Blocks of chunks meet as a whole, so that a chunk travels once a block and not once a chunk: so many chunks in one at most, and about so many
# values of vectors; below so many blocks, smaller ones give work to more tasks.
BLOCK_CHUNKS, BLOCK_VALUES, MIN_BLOCKS = 8, 2**22, 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest component first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1)[:, None]
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(single: np.ndarray, places: np.ndarray, first: np.ndarray, radius: float) -> np.ndarray:
    """Those of ``places`` that become nodes besides ``first``: none lies within ``radius`` of a node, all others do. In single precision, to its accuracy."""
    least = np.float32(1 - radius**2 / 2)
    chosen = np.empty((len(places) + len(first), single.shape[1]), dtype=np.float32)
    chosen[:len(first)] = single[first]
    count, fresh = len(first), []
    for at in range(0, len(places), 256):
        own = places[at:at + 256]
        for low in range(0, count, 8 * TILE):
            own = own[(single[own] @ chosen[low:min(low + 8 * TILE, count)].T).max(axis=1, initial=-2) < least]
        near = single[own] @ single[own].T >= least
        taken = np.zeros(len(own), dtype=bool)
        for i in range(len(own)):
            if not (near[i] & taken).any():
                taken[i] = True
        chosen[count:count + taken.sum()] = single[own[taken]]
        count += int(taken.sum())
        fresh.append(own[taken])
    return np.concatenate(fresh) if fresh else places[:0]


def entry_levels(points: np.ndarray) -> np.ndarray:
    """The level at which each point becomes a node: 0 for the root, then by halving radii; the last level takes what is left."""
    single = points.astype(np.float32)
    level = np.full(len(points), len(RADII) + 1, dtype=np.int64)
    level[0] = 0
    for depth, radius in enumerate(RADII, 1):
        left = np.flatnonzero(level > depth)
        if not len(left):
            break
        level[net(single, left, np.flatnonzero(level < depth), radius)] = depth
    return level


class CoverTree:
    """Nested levels over unit vectors sorted by entry level: the nodes of a level are the points up to some place.

    Level 0 is one root, the last level holds all points. ``children`` are nodes of the next level, a node being its own child;
    ``below`` are all points under a node, ``radius`` the largest distance to them.
    """

    def __init__(self, points: np.ndarray, level: np.ndarray):
        self.points, self.single = points, points.astype(np.float32)
        self.sizes = sorted({int(np.searchsorted(level, depth, "right")) for depth in range(len(RADII) + 2)} - {0})
        self.last = len(self.sizes) - 1
        self.children: list[list[np.ndarray]] = []
        for upper, lower in zip(self.sizes, self.sizes[1:]):
            parent = np.arange(lower)
            for at in range(upper, lower, TILE):
                parent[at:at + TILE] = distances(points[at:min(at + TILE, lower)], points[:upper]).argmin(axis=1)
            order = np.argsort(parent, kind="stable")
            self.children.append(np.split(order, np.cumsum(np.bincount(parent, minlength=upper))[:-1]))
        self.children.append([np.array([i]) for i in range(len(points))])
        self.below, self.radius = [self.children[-1]], [np.zeros(len(points))]
        for depth in range(self.last - 1, -1, -1):
            parts = [self.below[0][own[0]] if len(own) == 1 else np.concatenate([self.below[0][c] for c in own]) for own in self.children[depth]]
            self.radius.insert(0, np.array([0.0 if len(own) == 1 else distances(points[[n]], points[own]).max() for n, own in enumerate(parts)]))
            self.below.insert(0, parts)
        # Children of like radius stand together, so that few of a tile decide how far all of it reaches.
        for depth in range(self.last):
            radius = self.radius[depth + 1]
            self.children[depth] = [own if len(own) == 1 else own[np.argsort(radius[own], kind="stable")] for own in self.children[depth]]

        self.flat = [np.concatenate(parts) for parts in self.below]
        self.ends = [np.cumsum([0, *map(len, parts)]) for parts in self.below]

    def under(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """All points below the given nodes of a level."""
        ends = self.ends[level]
        sizes = ends[nodes + 1] - ends[nodes]
        if (sizes == 1).all():
            return self.flat[level][ends[nodes]]
        return self.flat[level][np.repeat(ends[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    def tiles(self, level: int, nodes: np.ndarray) -> Iterator[np.ndarray]:
        """Nodes sorted by radius, in parts of bounded size whose radii are of one class."""
        edges = np.flatnonzero(np.diff(np.searchsorted(CLASSES, self.radius[level][nodes], side="left"))) + 1
        for part in np.split(nodes, edges):
            for at in range(0, len(part), TILE):
                yield part[at:at + TILE]


def cosines(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the unit vectors a[x] and b[y] in double precision, by parts of bounded size."""
    out, step = np.empty(len(x)), max(1, MAX_VALUES // a.shape[1])
    for at in range(0, len(x), step):
        own = slice(at, at + step)
        out[own] = np.einsum("ij,ij->i", a[x[own]], b[y[own]])
    return out


def linked(a: CoverTree, pa: np.ndarray, b: CoverTree, pb: np.ndarray, threshold: float) -> np.ndarray | None:
    """Which of the given points link, None if none does."""
    cosine = a.single[pa] @ b.single[pb].T
    doubt = cosine.dtype.type(a.points.shape[1] * 2.0**-22)  # more than single precision can be off
    hits = cosine >= np.float32(threshold) - doubt
    if not hits.any():
        return None
    x, y = np.nonzero(hits & (cosine <= np.float32(threshold) + doubt))
    hits[x, y] = cosines(a.points, pa[x], b.points, pb[y]) >= threshold
    return hits if hits.any() else None


def traverse(a: CoverTree, b: CoverTree, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(points of a, points of b, which link): all of them link where the last is None. Each linked pair comes once.

    For a tree with itself (``a is b``) pairs come in both orders, points with themselves included.
    """
    reach, doubt = float(np.sqrt(2 - 2 * threshold)), np.float32(a.points.shape[1] * 2.0**-22)
    waiting = [(0, 0, 0, 0)]
    while waiting:
        la, i, lb, j = waiting.pop()
        pa, pb = a.below[la][i], b.below[lb][j]
        if len(pa) * len(pb) <= LEAF_PAIRS:
            hits = linked(a, pa, b, pb, threshold)
            if hits is not None:
                yield pa, pb, hits
            continue
        ca, cb = a.children[la][i], b.children[lb][j]
        la, lb = min(la + 1, a.last), min(lb + 1, b.last)
        ends = la == a.last and lb == b.last
        for own in a.tiles(la, ca):
            for other in b.tiles(lb, cb):
                if ends:
                    hits = linked(a, own, b, other, threshold)
                    if hits is not None:
                        yield own, other, hits
                    continue
                # Single precision is enough here: what it may be off is granted to both bounds.
                cosine = a.single[own] @ b.single[other].T
                ra, rb = a.radius[la][own].astype(np.float32), b.radius[lb][other].astype(np.float32)
                spread = ra[:, None] + rb[None, :] if ra.any() or rb.any() else np.float32(0)
                near = cosine >= 1 - np.minimum(spread + np.float32(reach + MARGIN), 2) ** 2 / 2 - doubt  # the others are too far apart
                alone = near.any(axis=1)
                if not alone.any():
                    continue
                if ra.min() + rb.min() <= reach - MARGIN:  # wider nodes never link as a whole
                    p, q = np.nonzero(near)
                    far = np.sqrt(np.maximum(2 - 2 * (cosine[p, q] - doubt), 0)) + ra[p] + rb[q]
                    p, q = p[far <= reach - MARGIN], q[far <= reach - MARGIN]
                    for x, y in zip(own[p], other[q]):
                        yield a.below[la][x], b.below[lb][y], None
                    near[p, q], alone[p] = False, False
                # Nodes without such a partner are compared with all of theirs at once, where that is less than a call for each costs.
                if alone.any():
                    pa, pb = a.under(la, own[alone]), b.under(lb, other[near[alone].any(axis=0)])
                    if len(pa) * len(pb) <= CALL_PAIRS * alone.sum():
                        hits = linked(a, pa, b, pb, threshold)
                        if hits is not None:
                            yield pa, pb, hits
                        near[alone] = False
                p, q = np.nonzero(near)
                p, q = own[p], other[q]
                # A node and all its near partners are compared at once, if these are few points.
                for group in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1) if len(p) else ():
                    pa, pb = a.below[la][p[group[0]]], b.under(lb, q[group])
                    if len(pa) * len(pb) > LEAF_PAIRS:
                        waiting += [(la, int(p[group[0]]), lb, int(n)) for n in q[group]]
                        continue
                    hits = linked(a, pa, b, pb, threshold)
                    if hits is not None:
                        yield pa, pb, hits


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` indices, each the farthest from those before."""
    chosen, gap = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, unit vectors) of the lists of a column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(np.r_[0, sizes])[:-1]
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        yield int(d), own, unit(flat[starts[own][:, None] + np.arange(d)[None, :]])


def _assigned(cells: DataFrame, centres: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``cells`` with those rows moved whose (length, cell) has ``centres`` (ids, vectors): to the nearest, with the distance to it."""
    shared = cells.sparkSession.sparkContext.broadcast(centres)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, gap = batch.column(4).to_numpy().copy(), batch.column(5).to_numpy().copy()
            for d, own, points in _by_length(batch.column(2)) if batch.num_rows else ():
                for former in np.unique(cell[own]):
                    if (d, int(former)) not in shared.value:
                        continue
                    ids, vectors = shared.value[d, int(former)]
                    rows = np.flatnonzero(cell[own] == former)
                    for at in range(0, len(rows), TILE):
                        part = rows[at:at + TILE]
                        far = distances(points[part], vectors)
                        cell[own[part]], gap[own[part]] = ids[far.argmin(axis=1)], far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cell), pa.array(gap)], names=["cid", "weight", "vector", "d", "cell", "gap"])

    kind = cells.schema["vector"].dataType.simpleString()
    return cells.select("cid", "weight", "vector", "d", "cell", "gap").mapInArrow(step, f"cid long, weight long, vector {kind}, d int, cell long, gap double")


def _samples(cells: DataFrame, rows: int) -> dict[tuple[int, int], np.ndarray]:
    """Sampled unit vectors by (length, cell), ``SAMPLE`` in all."""
    some = cells.select("d", "cell", "vector").sample(min(1.0, 2 * SAMPLE / max(rows, 1)), seed=7).limit(SAMPLE).collect()
    found: dict[tuple[int, int], list] = {}
    for r in some:
        found.setdefault((r["d"], r["cell"]), []).append(r["vector"])
    return {k: unit(np.array(v, dtype=np.float64)) for k, v in found.items()}


def divided(classes: DataFrame, rows: int) -> tuple[DataFrame, dict[int, np.ndarray], dict[int, int]]:
    """Classes (cid, weight, vector, d) with their cell, the centres of the cells that have one, and of each cell the top cell it comes from.

    A length that no sampled vector has is one cell without a centre: number -1 - length.
    """
    limit = lambda n: -(-n // CHUNK_ROWS)
    start = classes.select("cid", "weight", "vector", "d", (-1 - F.col("d")).cast("long").alias("cell"), F.lit(float("inf")).alias("gap"))
    centres: dict[int, np.ndarray] = {}
    origin: dict[int, int] = {}

    def chosen(samples: dict, sizes: dict) -> dict:
        table = {}
        for key, points in samples.items():
            picks = points[spread_out(points, min(2 * limit(sizes[key]) if sizes[key] > CHUNK_ROWS else 1, MAX_CENTRES))]
            ids = np.arange(len(centres), len(centres) + len(picks))
            table[key] = (ids, picks)
            for i, c in zip(ids.tolist(), picks, strict=True):
                centres[i] = c
                origin[i] = origin.get(key[1], i) if key[1] >= 0 else i
        return table

    cells = start
    for number in range(DIVISIONS):
        sizes = {(r["d"], r["cell"]): r["n"] for r in cells.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        crowded = {k: n for k, n in sizes.items() if n > CHUNK_ROWS}
        if number and not crowded:
            break
        wanted = sizes if not number else crowded
        pool = cells if not number else cells.join(F.broadcast(cells.sparkSession.createDataFrame(list(crowded), "d int, cell long")), ["d", "cell"], "left_semi")
        table = {k: v for k, v in chosen(_samples(pool, sum(wanted.values())), sizes).items() if not number or len(v[0]) > 1}
        if not table:
            break
        former, cells = cells, stage(_assigned(cells, table))
        drop_staged(former)
    return cells, centres, origin


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same ids as (a, b): each id with the smallest of its component."""
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[:len(a)], places[len(a):]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[own]], ids[own]


def _sides(table: pa.Table) -> tuple[dict[int, tuple[CoverTree, np.ndarray, np.ndarray]], list[tuple[int, int]]]:
    """Tree, ids and weights of each chunk of a unit that has rows, and the pairs of these chunks that are to meet."""
    chunk, level, cid, weight = (table.column(c).to_numpy() for c in ("chunk", "level", "cid", "weight"))
    vectors = table.column("vector").combine_chunks()
    out, pairs = {}, set()
    for name in np.unique(chunk).tolist():
        own = np.flatnonzero(chunk == name)
        own = own[np.lexsort((cid[own], level[own]))]
        (_, _, points), = _by_length(vectors.take(pa.array(own)))
        out[name] = (CoverTree(points, level[own]), cid[own], weight[own])
        pairs |= {(min(name, other), max(name, other)) for other in table.column("others")[int(own[0])].as_py()}
    return out, sorted(pair for pair in pairs if pair[0] in out and pair[1] in out)


def _links(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one work unit: (a, b, n). Rows with b tell that a and b are connected, n is the weight linked to a."""
    sides, pairs = _sides(table)
    counts = {name: np.zeros(len(cid), dtype=np.int64) for name, (_, cid, _) in sides.items()}
    a, b, ends, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
    for low, high in pairs:
        (tree, cid, weight), (other_tree, other_cid, other_weight) = sides[low], sides[high]
        for p, q, hits in traverse(tree, other_tree, threshold):
            if hits is None:  # the first of each side connects all of them
                counts[low][p] += other_weight[q].sum()
                if low != high:
                    counts[high][q] += weight[p].sum()
                x, y = cid[p], other_cid[q]
                ends.append((np.concatenate([x, np.full(len(y), x[0])]), np.concatenate([np.full(len(x), y[0]), y])))
            else:
                rows, columns = np.nonzero(hits)
                x, y = p[rows], q[columns]
                np.add.at(counts[low], x, other_weight[y])
                if low != high:
                    np.add.at(counts[high], y, weight[x])
                ends.append((cid[x], other_cid[y]))
            held += len(ends[-1][0])
            if held > 2_000_000:
                a, b = _spanning(np.concatenate([a, *(e for e, _ in ends)]), np.concatenate([b, *(e for _, e in ends)]))
                ends, held = [], 0
    a, b = _spanning(np.concatenate([a, *(e for e, _ in ends)]), np.concatenate([b, *(e for _, e in ends)]))
    linked_to = [(cid[n > 0], n[n > 0]) for (_, cid, _), n in zip(sides.values(), counts.values(), strict=True)]
    own = np.concatenate([a, *(c for c, _ in linked_to)])
    other = pa.array(np.concatenate([b, np.zeros(len(own) - len(b), np.int64)]), mask=np.arange(len(own)) >= len(b))
    return pa.table({"a": own, "b": other, "n": np.concatenate([np.zeros(len(a), np.int64), *(n for _, n in linked_to)])})


def _levels(table: pa.Table) -> pa.Table:
    """The rows of one chunk with their entry levels."""
    table = table.sort_by("cid")
    (_, _, points), = _by_length(table.column("vector").combine_chunks())
    return table.append_column("level", pa.array(entry_levels(points)))


def link_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) over classes (cid, weight, vector, d): edges (b set), and the weight linked to each class (n, to be summed), its own included."""
    spark, rows = classes.sparkSession, classes.count()
    if not rows:
        return spark.createDataFrame([], "a long, b long, n long")
    cells, centres, origin = divided(classes, rows)
    # A cell that is crowded still is divided by hash.
    sizes = stage(cells.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("r")).withColumn("parts", F.ceil(F.col("n") / CHUNK_ROWS).cast("int")))
    placed = cells.join(sizes.select("d", "cell", "parts"), ["d", "cell"]).select(
        "cid", "weight", "vector", F.xxhash64("d", "cell", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("chunk"))
    kind = cells.schema["vector"].dataType.simpleString()
    trees = stage(placed.groupBy("chunk").applyInArrow(_levels, f"cid long, weight long, vector {kind}, chunk long, level long"))
    # Cells whose radii let vectors of both link, met by their top cells: at most MAX_CENTRES of these for a length.
    reach = float(np.sqrt(2 - 2 * threshold)) + MARGIN
    top_radius: dict[int, float] = {}
    for i, c in centres.items():
        top_radius[origin[i]] = max(top_radius.get(origin[i], 0.0), float(np.linalg.norm(c - centres[origin[i]])))
    extent = {r["cell"]: r["r"] for r in sizes.groupBy("cell").agg(F.max("r").alias("r")).collect()}
    for i, r in extent.items():
        if i >= 0:
            top_radius[origin[i]] = max(top_radius[origin[i]], float(np.linalg.norm(centres[i] - centres[origin[i]])) + r)
    by_length: dict[int, list[int]] = {}
    for i in sorted(set(origin.values())):
        by_length.setdefault(len(centres[i]), []).append(i)
    pairs = []
    for tops in by_length.values():
        gaps, r = distances(np.array([centres[i] for i in tops]), np.array([centres[i] for i in tops])), np.array([top_radius[i] for i in tops])
        x, y = np.nonzero(gaps <= r[:, None] + r[None, :] + reach)
        pairs += [(tops[i], tops[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    known = spark.createDataFrame([(i, origin[i], c.tolist()) for i, c in centres.items()], "cell long, top long, centre array<double>")
    lone = F.array().cast("array<double>")
    table = (sizes.join(known, "cell", "left").select("d", "cell", "r", F.coalesce("top", "cell").alias("top"), F.coalesce("centre", lone).alias("centre"), F.explode(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.xxhash64("d", "cell", k.cast("bigint")))).alias("chunk")))
    # Blocks of neighbouring chunks: cells of a top cell stand together.
    by_place = Window.partitionBy("d")
    fitting = F.greatest(F.lit(1), F.least(F.lit(BLOCK_CHUNKS), F.floor(F.count(F.lit(1)).over(by_place) / MIN_BLOCKS), F.floor(F.lit(BLOCK_VALUES // CHUNK_ROWS) / F.col("d"))))
    table = stage(table.withColumn("block", F.floor((F.row_number().over(by_place.orderBy("top", "cell", "chunk")) - 1) / fitting)))
    near_tops = spark.createDataFrame(pairs, "top long, near long").unionByName(table.where("top < 0").select("top", F.col("top").alias("near")).distinct())
    other = table.select(F.col("d").alias("e"), F.col("cell").alias("cell2"), F.col("r").alias("r2"), F.col("top").alias("near"), F.col("centre").alias("centre2"), F.col("chunk").alias("other"),
                         F.col("block").alias("block2"))
    gap = F.sqrt(F.aggregate(F.zip_with("centre", "centre2", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, u: t + u))
    met = table.join(near_tops, "top").join(other, "near").where(F.col("d") == F.col("e")).where(
        (F.col("cell") == F.col("cell2")) | (gap <= F.col("r") + F.col("r2") + reach))
    # A pair of chunks is met from both sides, in one unit.
    units = stage(met.select("d", "chunk", "other", F.least("block", "block2").alias("low"), F.greatest("block", "block2").alias("high")).distinct()
                  .groupBy("d", "chunk", "low", "high").agg(F.collect_list("other").alias("others")))
    copies = trees.join(units, "chunk").select("cid", "weight", "vector", "chunk", "level", "others", "d", "low", "high")
    return copies.groupBy("d", "low", "high").applyInArrow(lambda rows: _links(rows, threshold), "a long, b long, n long")


def near_duplicates(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row: rows link when the cosine of their vectors is at least ``threshold``.

    Vectors that are null, empty, all zero, or hold null or non-finite components link with nothing: 0 links, their own key as component. Vectors
    of different lengths never link. Repeated rows are vectors of their own and link with each other. Rows with a null key link like others, but
    have no part in the smallest key; a component of null keys has a null id and kept is null. Further columns play no part.
    """
    exact = df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col(vector) if exact else F.col(vector).cast("array<double>")
    good = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(
        "vector", lambda x: x != 0)
    rows = stage(df.select(F.col(key).alias("key"), v.alias("vector")).withColumn("vector", F.when(good, F.col("vector")))
                 .select("key", "vector", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g"), F.size("vector").alias("d")))
    some = rows.where("vector is not null")
    classes = stage(some.groupBy("h", "g", "d").agg(F.count(F.lit(1)).alias("weight"), F.min("key").alias("least"), F.first("vector").alias("vector"))
                    .withColumn("cid", F.monotonically_increasing_id()))
    links = stage(link_classes(classes, threshold))
    roots = components(links.where("b is not null").select("a", "b"))
    counts = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    per_class = (classes.select("cid", "h", "g", "weight", "least").join(counts, F.col("cid") == F.col("a"), "left")
                 .join(roots, F.col("cid") == F.col("node"), "left").select("h", "g", F.coalesce("n", "weight").alias("linked"), "least", F.coalesce("root", "cid").alias("root")))
    per_class = stage(per_class)
    best = per_class.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = stage(per_class.join(best, "root").select("h", "g", "linked", "component_id"))
    out = some.select("key", "h", "g").join(classed, ["h", "g"]).select(
        "key", (F.col("linked") - 1).alias("n_links"), "component_id").unionByName(
        rows.where("vector is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))
