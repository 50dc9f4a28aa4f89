"""Line dedup, SimHash, embeddings, components against plain twins that look at every pair."""

import random

import numpy as np
import pytest

import brute
from foldloom.llm import embedding_dedup, line_dedup, simhash_dedup
from foldloom.llm.components import components

LINES = ["alpha beta", "gamma", "  delta\t", "", "epsilon zeta", "eta", "theta iota", " "]


def documents(rng, n):
    return [(i, "\n".join(rng.choice(LINES) for _ in range(rng.choice([0, 1, 2, 3, 5, 12])))) for i in range(n)]


def test_line_dedup_against_twin(spark):
    rng = random.Random(1)
    rows = documents(rng, 40) + [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n".join(["same"] * 50)), (104, "\n".join(f"own {i}" for i in range(3000))),
                                 (105, "a\r\nb\r\nc\r\nd"), (106, "a\nb\nc"), (-5, "a\nb\nc"), (107, "x\na\n\nb\n \nc\ny"), (None, "a\nb\nc\nnull key")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_lines string, at int")
    out = line_dedup.remove_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "at", "n_lines", "n_removed"]
    want = {row[0]: w for row, w in zip(rows, brute.line_dedup(rows))}
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()}
    assert got == want and len(got) == len(rows)
    assert line_dedup.remove_repeated_lines(df.limit(0)).count() == 0


def test_repeated_rows_keep_their_lines(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")] * 3 + [(None, "d\ne\nf")] * 2, "doc_id long, text string")
    assert {(r["n_removed"], len(r["text"])) for r in line_dedup.remove_repeated_lines(df).collect()} == {(0, 5)}


def test_probes_of_fingerprints_are_not_broadcast(spark):
    """Each fingerprint asks for about 34 halves, which Spark's size of the exploded table does not show."""
    plan = simhash_dedup.near_pairs(spark.range(1000).toDF("simhash"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def near_texts():
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(120)) for _ in range(4)]
    texts = [None, "", " \n ", "one", "ONE", "one two", "one two three", "Ünï cödé Wörds here"]
    for text in base:
        for _ in range(8):
            own = text.split()
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = "zz"
            texts.append(rng.choice([" ", "\n", "  "]).join(own))
    return texts


def test_simhash_against_twin(spark):
    rows = [(i + 10, t) for i, t in enumerate(near_texts())] + [(None, "one"), (7, "one two"), (7, "one two"), (3, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, simhash int, component_id string")
    prints, roots = brute.simhash_components(rows)
    got = simhash_dedup.near_duplicates(df).collect()
    key = lambda t: (str(t[0]), t[1], str(t[2]))
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=key) == sorted(((d, p, c) for (d, _), p, c in zip(rows, prints, roots)), key=key)
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_simhash_of_long_text():
    text = " ".join(str(i % 977) for i in range(210_000))
    assert simhash_dedup.fingerprint(text.encode()) % 2**64 == brute.simhash(text)


def test_near_pairs_finds_all_and_each_once(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(25):
        center = rng.getrandbits(64)
        for _ in range(8):
            flipped = center
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                flipped ^= 1 << bit
            prints.append(flipped)
    signed = [p - 2**64 if p >= 2**63 else p for p in [*prints, 0, 7, 2**64 - 1]]
    found = [tuple(r) for r in simhash_dedup.near_pairs(spark.createDataFrame([(s,) for s in signed], "simhash long")).collect()]
    own = sorted(set(signed))
    want = {(a, b) for a in own for b in own if a < b and ((a ^ b) % 2**64).bit_count() <= 3}
    assert len(found) == len(set(found)) and set(found) == want


def test_first_of_each_keeps_one_row(spark):
    rows = [(i + 10, t) for i, t in enumerate(near_texts())] + [(None, "one"), (7, "one two"), (7, "one two"), (None, "alone null"), (None, "alone null")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, source string")
    out = simhash_dedup.first_of_each(df)
    _, roots = brute.simhash_components(rows)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(c) for c in set(roots))


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((1, 0), (30, 20), (60, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges += [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(30)] + [(5, 5)]
        near = {frozenset(e) for e in edges}
        nodes = sorted({x for e in edges for x in e})
        want = brute.components(nodes, lambda a, b: frozenset((a, b)) in near)
        got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
        assert set(got) == set(nodes)
        assert len({(want[v], got[v]) for v in nodes}) == len(set(want.values())) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def links(rows, threshold=0.9):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    cosine = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))
    linked = lambda i, j: len(rows[i][1]) == len(rows[j][1]) and cosine(np.array(rows[i][1], float), np.array(rows[j][1], float)) >= threshold
    near = {(i, j) for i in good for j in good if i != j and linked(i, j)}
    roots = brute.components(range(len(rows)), lambda a, b: (a, b) in near)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[roots[i]] = min(key, least.get(roots[i], key))
    return [(key, sum((i, j) in near for j in good), least.get(roots[i])) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("chunk", [16, 8192])
def test_embeddings_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(embedding_dedup, "LEAF_PAIRS", chunk // 4)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 6))
    spread = rng.choice([0, .01, .1, .3, .8], 130)
    vectors = [base[rng.integers(8)] + s * rng.normal(size=6) for s in spread]
    rows = [(i + 1, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, []), (902, [0.0] * 6), (903, [float("nan")] + [1.0] * 5), (904, [float("inf")] + [1.0] * 5), (905, [None] + [1.0] * 5),
             (0, [2 * x for x in rows[4][1]]), (6, rows[5][1]), (None, rows[6][1]), (None, [5.0, 1.0]), (77, [10.0, 2.0]), (78, [10.0, 2.0]), (910, [-1e-30] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, n_links string, cid int")
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted(map(str, ((r[0], r[1], r[2]) for r in got))) == sorted(map(str, links(rows)))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_many_lengths_and_tiny_ones(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(1, 121):
        v = rng.normal(size=d)
        rows += [(len(rows), v.tolist()), (len(rows) + 1, (v * 3).tolist())]
    rows += [(1000, [1e-170, 2e-170, 0.0]), (1001, [1e170, 2e170, 0.0]), (1002, [2e-170, -1e-170, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[i][0] >= 1 and got[i][1] == i - i % 2 for i in range(6, 240)) and None not in {n for n, _ in got.values()}
    assert got[1000][1] == got[1001][1] and got[1002][1] != got[1000][1]


def test_cover_tree_levels_nest_and_cover(monkeypatch):
    rng = np.random.default_rng(6)
    points = embedding_dedup.unit(np.concatenate([rng.normal(size=(60, 5)), np.repeat(rng.normal(size=(3, 5)), 20, axis=0) + 0.02 * rng.normal(size=(60, 5))]))
    level = embedding_dedup.entry_levels(points)
    order = np.argsort(level, kind="stable")
    points, level = points[order], level[order]
    tree = embedding_dedup.CoverTree(points, level)
    for depth, radius in enumerate(embedding_dedup.RADII, 1):
        nodes = points[level <= depth]
        assert (embedding_dedup.distances(points, nodes).min(axis=1) <= radius + 1e-5).all()  # nets are in single precision
        gaps = embedding_dedup.distances(nodes, nodes) + 9 * np.eye(len(nodes))
        assert gaps.min() > radius - 1e-5
    for parts, radii in zip(tree.below, tree.radius):
        assert sorted(np.concatenate(parts)) == list(range(len(points)))
        assert all(embedding_dedup.distances(points[[n]], points[own]).max() <= r + 1e-7 for n, (own, r) in enumerate(zip(parts, radii)))
    for leaf in (0, 50, 10**6):
        monkeypatch.setattr(embedding_dedup, "LEAF_PAIRS", leaf)
        pairs = np.zeros((len(points), len(points)), int)
        for p, q, hits in embedding_dedup.traverse(tree, tree, 0.9):
            pairs[np.ix_(p, q)] += 1 if hits is None else hits
        assert (pairs == (points @ points.T >= 0.9)).all()


@pytest.mark.parametrize("call", [0, 16_384])
def test_nodes_of_a_tile_are_compared_together(monkeypatch, call):
    """Every linked pair comes once, by calls for single nodes and by calls for whole tiles; the latter are far fewer than the nodes."""
    rng = np.random.default_rng(11)
    points = rng.normal(size=(400, 12))
    points = embedding_dedup.unit(np.concatenate([points, points[:60] + 0.03 * rng.normal(size=(60, 12)), points[:60] + 0.12 * rng.normal(size=(60, 12))]))
    level = embedding_dedup.entry_levels(points)
    order = np.argsort(level, kind="stable")
    tree = embedding_dedup.CoverTree(points[order], level[order])
    calls, plain = [], embedding_dedup.linked
    monkeypatch.setattr(embedding_dedup, "linked", lambda *args: calls.append(1) or plain(*args))
    monkeypatch.setattr(embedding_dedup, "LEAF_PAIRS", 2_000)
    monkeypatch.setattr(embedding_dedup, "CALL_PAIRS", call)
    pairs = np.zeros((len(points), len(points)), int)
    for p, q, hits in embedding_dedup.traverse(tree, tree, 0.9):
        pairs[np.ix_(p, q)] += 1 if hits is None else hits
    assert (pairs == (points[order] @ points[order].T >= 0.9)).all()
    assert not call or len(calls) < tree.sizes[1] / 2


def test_chunks_meet_in_blocks(spark, monkeypatch):
    """Units of several chunks give the links of all pairs, from fewer copies of each chunk than it meets chunks."""
    monkeypatch.setattr(embedding_dedup, "CHUNK_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "MIN_BLOCKS", 2)
    staged, plain = [], embedding_dedup.stage
    monkeypatch.setattr(embedding_dedup, "stage", lambda df: staged.append(plain(df)) or staged[-1])
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:40] + 0.05 * rng.normal(size=(40, 6)), base[:9]]))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r[:3]) for r in got) == sorted(links(rows))
    units = [df for df in staged if "others" in df.columns][0].collect()
    assert {len(r["others"]) for r in units} != {1} and all(r["low"] <= r["high"] for r in units)
    assert len(units) < sum(len(r["others"]) for r in units) / 2
