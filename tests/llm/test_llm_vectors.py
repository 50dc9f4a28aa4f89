"""Centroid clustering and hard negatives against plain twins in whole numbers."""

import hashlib
import math
import random

import pytest

from foldloom.llm import centroid_clustering, hard_negatives


def integers(vector, scale=256):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def odd_rows(rng, dims, n):
    """Vectors with ties, repeats, nulls, other lengths and clashing columns: (vec_id, embedding, label, cluster)."""
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.001, 0.5, 2.0]) for _ in range(dims)], rng.choice([0, 1, 2]), "x") for i in range(n)]
    rows += [(i, rows[i][1], rows[i][2], "y") for i in (0, 3, 10)] + [(n + 5, rows[7][1], 1, "x"), (None, rows[2][1], 0, "x")]
    rows += [(n + 10, None, 1, ""), (n + 11, [], 1, ""), (n + 12, [1.0] * (dims - 1) + [None], 1, ""), (n + 13, [float("nan")] + [1.0] * (dims - 1), 2, ""),
             (n + 14, [float("-inf")] + [1.0] * (dims - 1), 2, ""), (n + 15, [1.0] * (dims + 1), 0, ""), (n + 16, [0.5] * (dims + 1), 1, ""), (n + 17, rows[1][1], None, "")]
    rng.shuffle(rows)
    return rows


def clustered(rows, k, rounds, dims):
    kept = [(key, q) for key, v, *_ in rows if (q := integers(v)) is not None and len(q) == dims]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [q for _, q in first[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centroids = [[sum(column) // len(groups[i]) for column in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centroids)]
    found = [(key, *reversed(near(q))) for key, q in kept]
    inertia = {c: sum(d for _, own, d in found if own == c) for _, c, _ in found}
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return [(key, c, d, inertia[c], sum(inertia.values()), name(c)) for key, c, d in found]


@pytest.mark.parametrize(("k", "rounds"), [(5, 4), (1, 1), (500, 2)])
def test_clusters_against_plain_rounds(spark, k, rounds):
    rows = odd_rows(random.Random(k), 4, 60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string").repartition(5)
    got = [tuple(r) for r in centroid_clustering.cluster(df, k=k, rounds=rounds, dims=4).collect()]
    plain = [(i, [None if x is None else float(x) for x in r[1]] if r[1] is not None else None) for r in df.collect() for i in [r[0]]]
    assert sorted(map(str, got)) == sorted(map(str, clustered(plain, k, rounds, 4)))


def test_clusters_of_nothing_and_of_too_much(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<double>")
    empty = centroid_clustering.cluster(df, dims=4)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    # Products beyond 2^53 stay exact, squares beyond 2^58 are refused.
    big = spark.createDataFrame([(1, [1e6, 1.0]), (2, [1e6, 2.0]), (3, [-1e6, 3.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, centroid_clustering.cluster(big, k=2, dims=2).collect())) == sorted(clustered([tuple(r) for r in big.collect()], 2, 5, 2))
    huge = spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too long"):
        centroid_clustering.cluster(huge, dims=2).collect()


def mined(rows, anchor_every, relabel_every=7, labels=10, n_pos=5, n_neg=10):
    own = []
    for place, (key, vector, label) in enumerate(rows):
        q = integers(vector)
        if q is not None and label is not None:
            own.append((place, key, (label + 1) % labels if key is not None and key % relabel_every == 0 else label, q))
    best = lambda found: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    out = []
    for place, key, label, q in own:
        if key is None or key % anchor_every:
            continue
        scored = [(sum(a * b for a, b in zip(q, v, strict=True)), i, other) for p, i, other, v in own if p != place and len(v) == len(q)]
        rest = best([(s, i) for s, i, other in scored if other != label])
        for p, positive in best([(s, i) for s, i, other in scored if other == label])[:n_pos]:
            window = [(s, i) for s, i in rest if 30 * p <= 100 * s <= 90 * p][:n_neg]
            out += [(key, positive, rank, i, p, s) for rank, (s, i) in enumerate(window, 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, small):
    if small:  # many blocks, tiles and jobs
        for name, value in (("BLOCK", 4), ("BLOCKS_AT_ONCE", 2), ("TILE_ANCHORS", 2), ("TILE_ROWS", 5), ("FLOOR_SHARE", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(7)
    rows = [r[:3] for r in odd_rows(rng, 6, 150)]
    centre = [rng.uniform(-1, 1) for _ in range(6)]  # a dense part: windows overlap and hold many rows
    rows += [(200 + i, [c + rng.choice([0, 0, .1, .3]) * rng.uniform(-1, 1) for c in centre], rng.choice([0, 1])) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("x", "y").repartition(4)
    got = [tuple(r) for r in hard_negatives.mine(df, anchor_every=5).collect()]
    want = mined(rows, 5)
    assert len(want) > 500 and sorted(map(str, got)) == sorted(map(str, want))
    assert hard_negatives.mine(df.limit(0)).count() == 0
