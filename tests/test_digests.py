import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foldloom.functions.text import record_line
from foldloom.operators import compare as co
from foldloom.operators import fingerprints as fp
from foldloom.operators import folds as fo
from foldloom.operators import plancheck as pc
from foldloom.operators import profile as pr
from foldloom.operators import stratified as st
from foldloom.plans.digests import tree_digest
from tables import NINE, records


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(lines):
    """Twin of the digest tree."""
    counts = {}
    for line in lines:
        counts[sha(line)] = counts.get(sha(line), 0) + 1
    level = {h: f"{h}:{n}" for h, n in counts.items()}
    for width in (6, 3):
        groups = {}
        for h, entry in level.items():
            groups.setdefault(h[:width], []).append(entry)
        level = {p: f"{p}:" + sha("\n".join(sorted(e))) for p, e in groups.items()}
    return sha("\n".join(sorted(level.values())))


def test_tree_digest(spark):
    lines = [f"line {i % 150}" for i in range(400)]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    expected = tree(lines)
    for shape in (df, df.orderBy(F.rand(3)).repartition(7)):
        assert tree_digest(shape, F.col("x")).first()[:] == (400, expected)
    assert tree_digest(df.where("x <> 'line 3'"), F.col("x")).first()["digest"] != expected
    assert tree_digest(df.unionByName(df.limit(1)), F.col("x")).first()["digest"] != expected
    keyed = df.withColumn("k", F.length("x"))
    got = {r["k"]: r["digest"] for r in tree_digest(keyed, F.col("x"), ["k"]).collect()}
    assert got == {k: tree([x for x in lines if len(x) == k]) for k in (6, 7, 8)}


@pytest.mark.parametrize("unit", ["group", "case"])
def test_digests_from_heads_equal_digests_from_rows(spark, unit):
    data = records(spark, NINE)
    folds = fo.logo_folds(pr.case_counts(data), unit)
    rule = fp.part_digests(fp.rule_part_sums(folds, fp.case_sums(data, record_line("record_id"))))
    rows = pc.expand_plan(data, folds).join(data.select("record_id", "label"), "record_id")
    listed = fp.part_digests(fp.plan_part_sums(rows, record_line("record_id"), F.col("label") == 1))
    a, b = ({(r["fold"], r["part"]): (r["n_members"], r["n_pos"], r["digest"]) for r in x.collect()} for x in (rule, listed))
    assert a == b and len(a) == 3 * folds.count() and len({v[2] for v in a.values()}) > 10


def with_payload(data):
    return data.withColumn("payload_hash", F.sha2("record_id", 256))


def test_compare_fingerprints(spark):
    data = with_payload(records(spark, NINE))
    folds = fo.logo_folds(pr.case_counts(data), "group")
    mine = fp.fingerprint(data, folds, "payload_hash")

    def status(other):
        return co.compare_fingerprints(mine, other).first()

    assert status(fp.fingerprint(data.repartition(9), folds, "payload_hash"))[:] == ("MATCH", "payload", 0, 0)
    renamed = fp.fingerprint(data.withColumn("record_id", F.concat(F.lit("x"), "record_id")), folds, "payload_hash")
    assert status(renamed)["status"] == "MATCH"
    assert status(fp.fingerprint(data, folds))[:] == ("MATCH", "record", 0, 0)
    moved = folds.withColumn("val_group", F.when(F.col("fold") == 2, "chb06").otherwise(F.col("val_group")))
    other = status(fp.fingerprint(data, moved, "payload_hash"))
    assert (other["status"], other["n_folds_differ"]) == ("MISMATCH", 1)
    schema = mine.withColumn("value", F.when(F.col("key") == "schema", "0").otherwise(F.col("value")))
    assert status(schema)["status"] == "INCOMPARABLE"
    short = fp.fingerprint(data, folds.where("fold > 1"), "payload_hash")
    lines = {(r["level"], r["scope"], r["key"]): r["result"] for r in co.comparison_lines(mine, short).collect()}
    assert lines[("payload", "fold", "1")] == "present in only one plan" and lines[("payload", "dataset", "signals")] == "MATCH"


def test_recordings_are_explained(spark):
    base = spark.createDataFrame([(i, "ZS"[i % 2], f"r{i}", f"p{i}", f"f{i}") for i in range(10)],
                                 "ordinal int, set_id string, record_id string, payload_hash string, file_hash string")
    mine = fp.recording_digests(base)

    def cause(other):
        return co.explain_recordings(mine, fp.recording_digests(other)).first()[:]

    assert cause(base.repartition(3)) == ("MATCH", "identical")
    assert cause(base.withColumn("file_hash", F.lit("x")).withColumn("record_id", F.lit("y"))) == ("MATCH", "same signals, other file bytes and names")
    assert cause(base.withColumn("ordinal", 9 - F.col("ordinal"))) == ("MISMATCH", "same signals, other order")
    changed = base.withColumn("payload_hash", F.when(F.col("ordinal") == 3, "new").otherwise(F.col("payload_hash")))
    assert cause(changed) == ("MISMATCH", "different signals")
    assert [tuple(r) for r in co.missing_per_set(changed, base).collect()] == [("S", 1)]


def test_split_digests_and_comparison(spark):
    rows = spark.createDataFrame([(f"{s}{i}", s) for s in "ZONFS" for i in range(20)], "record_id string, set_id string")
    tasks = ("Z_vs_O", "Z+O_vs_S")
    plan = st.plan_tasks(st.preset_tasks(spark, tasks), rows)
    one = fp.split_digests(plan)
    again = fp.split_digests(plan.repartition(5))
    assert one["plan"].first() == again["plan"].first() and one["fit"].count() == 22
    edited = plan.withColumn("part", F.when((F.col("task_id") == "Z_vs_O") & (F.col("part") == "val"), "train").otherwise(F.col("part")))
    row = co.compare_splits(one["task"], fp.split_digests(edited)["task"]).first()
    assert (row["n_common"], row["n_differing"], row["first_differing"]) == (2, 1, "Z_vs_O")


def test_diff_tables(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5), (3, "z", 6)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 1), (2, "y", 5), (4, "w", 6)], "k int, s string, n int")
    got = {tuple(r) for r in co.diff_tables(a, b, ["k"]).collect()}
    assert got == {(1, "n", None, "1"), (3, "<row>", "present", None), (4, "<row>", None, "present")}
    assert {tuple(r) for r in co.compare_keys(a, b, "k").collect()} == {(1, "both"), (2, "both"), (3, "only_left"), (4, "only_right")}


def test_diff_large_tables_reads_differing_buckets_only(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.choice([None, 1, 2])) for i in range(400)]
    a = spark.createDataFrame(rows, "k int, s string, n int")
    for edits in (0, 1, 7, 60):
        other = dict((r[0], r) for r in rows)
        for _ in range(edits):
            k = rng.randrange(400)
            other.pop(k, None) if rng.random() < .3 else other.update({k: (k, rng.choice("abcd"), rng.choice([None, 1]))})
        other |= {1000 + i: (1000 + i, "new", None) for i in range(edits // 5)}
        b = spark.createDataFrame(list(other.values()), "k int, s string, n int")
        assert sorted(map(str, co.diff_large_tables(a, b, ["k"], buckets=64).collect())) == sorted(map(str, co.diff_tables(a, b, ["k"]).collect()))
    again = a.repartition(7)
    assert co.diff_large_tables(a, again, ["k"]).count() == 0
    sums = [sorted(map(tuple, co.bucket_sums(x, ["k"], ["s", "n"], 16).collect())) for x in (a, again)]
    assert sums[0] == sums[1] and len(sums[0]) == 16
    # One edited row: the join reads the rows of one bucket of 64.
    b = a.withColumn("s", F.when(F.col("k") == 77, "z").otherwise(F.col("s")))
    seen = {}
    plain = co.diff_tables
    try:
        co.diff_tables = lambda left, right, *rest: seen.update(n=left.count() + right.count()) or plain(left, right, *rest)
        assert [tuple(r)[:2] for r in co.diff_large_tables(a, b, ["k"], buckets=64).collect()] == [(77, "s")]
    finally:
        co.diff_tables = plain
    assert 0 < seen["n"] < 60
    assert {r["column"] for r in co.diff_large_tables(a, a.withColumnRenamed("n", "m"), ["k"]).collect()} == {"<column> n", "<column> m"}


def test_cut_lines_say_how_many_more(spark):
    rows = [("record", "fold", str(i), f"x{i}") for i in range(9)] + [("record", "dataset", "records", "r")]
    a = spark.createDataFrame(rows, "level string, scope string, key string, value string")
    b = a.withColumn("value", F.when(F.col("key") != "3", F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    lines = {(r["key"], r["result"]) for r in co.comparison_lines(a, b).where("scope = 'fold'").collect()}
    assert lines == {(k, "MISMATCH") for k in "01245"} | {("...", "3 more")}
    sides = [spark.createDataFrame([(f"t{i}", f"{s}{i % 2 or s}") for i in range(20)], "task_id string, digest string") for s in "ab"]
    row = co.compare_splits(*sides).first()
    assert row["n_differing"] == 20 and row["first_differing"] == "t0, t1, t10, t11, t12, t13 ..."
