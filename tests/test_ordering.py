import numpy as np
import pytest
from pyspark.sql import functions as F

from foldloom.plans.ordering import RANGE, bracketed_percentiles, exact_percentiles, first_by_hash, hash_positions, in_ranges, positions, running_totals


def test_running_totals_with_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [(("hot" if i % 3 else f"k{i % 7}"), float(i), int(rng.integers(0, 5)), int(rng.integers(0, 5))) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v double, a bigint, b bigint").repartition(7)
    got = {(r["k"], r["v"]): (r["before_a"], r["total_a"], r["before_b"], r["total_b"])
           for r in running_totals(df, ["v"], ["a", "b"], ["k"], ranges=5).collect()}
    assert len(got) == len(rows)
    for k, v, _, _ in rows:
        mine = [(x, a, b) for kk, x, a, b in rows if kk == k]
        assert got[(k, v)] == (sum(a for x, a, _ in mine if x < v), sum(a for _, a, _ in mine),
                               sum(b for x, _, b in mine if x < v), sum(b for _, _, b in mine))


def test_running_totals_without_key_and_null_key(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 2), ("x", 1.0, 4)], "k string, v double, a bigint")
    got = {(r["k"], r["v"]): (r["before_a"], r["total_a"]) for r in running_totals(df, ["v"], ["a"], ["k"]).collect()}
    assert got == {(None, 1.0): (0, 3), (None, 2.0): (1, 3), ("x", 1.0): (0, 4)}
    plain = df.groupBy("v").agg(F.sum("a").alias("a"))
    assert sorted((r["v"], r["before_a"], r["total_a"]) for r in running_totals(plain, ["v"], ["a"]).collect()) == [
        (1.0, 0, 7), (2.0, 5, 7)]


def test_positions_do_not_depend_on_ranges_or_partitions(spark):
    df = spark.range(257).select(F.sha2(F.col("id").cast("string"), 256).alias("v"))
    expected = {v: i + 1 for i, v in enumerate(sorted(r[0] for r in df.collect()))}
    for ranges, parts in ((1, 3), (4, 9), (300, 2)):
        got = {r["v"]: r["position"] for r in positions(df.repartition(parts), "v", ranges=ranges).collect()}
        assert got == expected


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(np.round(v, 1))) for v in rng.normal(size=301)] + [("b", 4.0), ("b", 8.0), ("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in exact_percentiles(df, "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9, "top": 1.0}, ["k"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for key in got:
        values = [v for k, v in rows if k == key]
        assert np.allclose([got[key][c] for c in ("q1", "q2", "q9", "top")], np.percentile(values, [25, 50, 90, 100]))


def test_hash_positions_number_every_stratum(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") < 400, "hot").otherwise("cold").alias("s"))
    a = {r["id"]: (r["position"], r["n_stratum"]) for r in hash_positions(df, "id", ["s"], F.lit(42)).collect()}
    b = {r["id"]: (r["position"], r["n_stratum"]) for r in hash_positions(df.repartition(11), "id", ["s"], F.lit(42)).collect()}
    other = {r["id"]: r["position"] for r in hash_positions(df, "id", ["s"], F.lit(43)).collect()}
    assert a == b and {k: v[0] for k, v in a.items()} != other
    assert sorted(a[i][0] for i in range(400)) == list(range(1, 401)) and a[450][1] == 100


def test_a_hot_key_is_cut_by_range_and_hash(spark):
    """No range and no slot holds more than a small part of a key with almost all rows."""
    df = spark.range(3000).select(F.when(F.col("id") % 30 == 0, "cold").otherwise("hot").alias("k"), F.col("id").alias("v"))
    sizes = [r["count"] for r in in_ranges(df, "k", "v", ranges=8).where("k = 'hot'").groupBy(RANGE).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1000


def test_ranges_follow_the_size(spark):
    """Few rows end up in one range, and totals stay right either way."""
    df = spark.range(40).select(F.col("id").alias("v"), F.lit(1).cast("bigint").alias("a"))
    assert in_ranges(df, "v").select(RANGE).distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(r["before_a"] == r["v"] for r in running_totals(df, ["v"], ["a"]).collect())
    assert all(r["position"] == r["v"] + 1 for r in positions(df, "v").collect())


@pytest.mark.parametrize("by", [(), ("k",)])
def test_bracketed_percentiles_are_exact(spark, by):
    rng = np.random.default_rng(8)
    keys = rng.choice(["a", "b", "c"], 4000, p=[0.9, 0.09, 0.01])
    values = np.where(rng.random(4000) < 0.2, 1.5, rng.normal(size=4000))
    rows = [(str(k), float(v)) for k, v in zip(keys, values)] + [("a", None), ("z", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    wanted = {"least": 0.0, "low": 0.1, "median": 0.5, "p99": 0.99, "largest": 1.0}
    for accuracy in (200, 100_000):  # the first brackets by sketch, the second takes all values in
        got = {tuple(r[c] for c in by): r for r in bracketed_percentiles(df, "v", wanted, by, accuracy).collect()}
        groups = {(k,) for k, _ in rows} if by else {()}
        assert set(got) == groups
        for group in groups:
            own = [v for k, v in rows if v is not None and group in ((k,), ())]
            for name, q in wanted.items():
                assert got[group][name] == pytest.approx(np.quantile(own, q), abs=1e-12), (group, name, accuracy)


def test_first_by_hash_needs_no_sort_of_the_rows(spark):
    """The same rows as ranked positions give, for hot and small keys, cuts of nothing and of everything, rows left out and null keys."""
    df = spark.range(3000).select(F.when(F.col("id") % 50 == 0, "cold").when(F.col("id") % 997 == 3, F.lit(None)).otherwise("hot").alias("k"), F.col("id"), (F.col("id") % 3 == 0).alias("out"))
    for fraction in (0.0, 0.15, 0.5, 1.0):
        size = lambda n: F.round(n * F.lit(fraction)).cast("bigint")  # noqa: B023, E731
        ranked = hash_positions(df.where(~F.col("out")), "id", ["k"], F.lit(7)).where(F.col("position") <= size(F.col("n_stratum")))
        chosen = first_by_hash(df, "id", ["k"], F.lit(7), size, "first", ~F.col("out"))
        assert chosen.count() == 3000 and chosen.columns == [*df.columns, "first"]
        assert {r["id"] for r in chosen.where("first").collect()} == {r["id"] for r in ranked.collect()}
    assert "rangepartitioning" not in chosen._jdf.queryExecution().executedPlan().toString()
