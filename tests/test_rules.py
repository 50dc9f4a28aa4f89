import pytest
from pyspark.sql import functions as F

from foldloom.functions.signal import is_finite
from foldloom.operators import rules as ru
from tables import SMALL, records


@pytest.fixture(scope="module")
def good(spark):
    data = records(spark, SMALL).withColumn("mapped_group", F.col("group_id"))
    signal = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (i * F.length("record_id") + F.abs(F.hash("record_id")) % 97).cast("float"))
    data = data.withColumn("signal", signal).withColumn("computed", F.sha2("record_id", 256)).withColumn("stored", F.col("computed"))
    return data


RULES = lambda: [
    ru.not_blank("case_id"), ru.not_blank("stored"), ru.label_domain(), ru.label_name_agrees(), ru.group_agrees(),
    ru.path_agrees(), ru.finite_payload("signal"), ru.payload_length("signal", 8), ru.hash_agrees("stored", "computed")]


def rules_broken(df):
    return {r["rule"] for r in ru.check_records(df, RULES()).collect()}


def edit(df, column, value):
    """Changes one record."""
    target = df.agg(F.min("record_id")).first()[0]
    return df.withColumn(column, F.when(F.col("record_id") == target, value).otherwise(F.col(column)))


def test_good_records_pass(good):
    assert rules_broken(good) == set()
    ru.assert_valid(ru.check_records(good, RULES()))


@pytest.mark.parametrize("column,value,expected", [
    ("stored", lambda: F.lit(" "), {"blank_stored", "payload_hash"}),
    ("label", lambda: F.lit(7), {"label_domain", "label_name"}),
    ("label", lambda: F.lit(None).cast("int"), {"label_domain", "label_name"}),
    ("label_name", lambda: F.lit("seizure"), {"label_name", "path_folders"}),
    ("mapped_group", lambda: F.lit("chb99"), {"group_mapping"}),
    ("case_id", lambda: F.lit("chb99"), {"path_folders"}),
    ("signal", lambda: F.array(*[F.lit(float("nan")).cast("float")] * 8), {"non_finite"}),
    ("signal", lambda: F.array(*[F.lit(1.0).cast("float")] * 7), {"payload_length"}),
    ("stored", lambda: F.sha2(F.lit("other"), 256), {"payload_hash"}),
    ("stored", lambda: F.upper("stored"), set()),
])
def test_one_mutation_breaks_its_rule(good, column, value, expected):
    changed = edit(good, column, value())
    assert rules_broken(changed) == expected
    if expected:
        with pytest.raises(ru.DataRuleError):
            ru.assert_valid(ru.check_records(changed, RULES()))


def test_table_rules(good, spark):
    assert ru.missing_columns(good, ["record_id", "nope"]) == ["nope"]
    with pytest.raises(ru.DataRuleError):
        ru.require_columns(good, ["nope"])
    assert ru.duplicate_ids(good, "record_id").count() == 0
    assert ru.duplicate_ids(good.unionByName(good.limit(1)), "record_id").first()["detail"] == "2 rows"
    assert ru.split_owner(good).count() == 0
    assert ru.split_owner(edit(good, "group_id", F.lit("chb02"))).first()["record_id"] == "chb01"
    n = good.count()
    pos = good.where("label = 1").count()
    assert ru.counts_differ(good, {"total": n, "negative": n - pos, "positive": pos}).count() == 0
    assert {r["record_id"] for r in ru.counts_differ(good, {"total": n, "negative": n, "positive": pos}).collect()} == {"negative"}
    assert ru.counts_differ(good, None).count() == 0
    other = edit(good, "label", 1 - F.col("label"))
    assert ru.column_differs(good, other, "record_id", "label", "payload_label").count() == 1
    assert {r["detail"] for r in ru.key_sets_differ(good, other.where("case_id <> 'chb02'"), "record_id", "manifest", "files", "manifest")
            .collect()} == {"only in files"}


def test_shared_payload_across_groups(good):
    assert ru.cross_group_payloads(good, "stored").count() == 0
    copied = good.withColumn("stored", F.when(F.col("case_id").isin("chb02", "chb21"), F.lit("same")).otherwise(F.col("stored")))
    assert ru.cross_group_payloads(copied, "stored").count() == sum(SMALL["chb02"]) + sum(SMALL["chb21"])
    within = good.withColumn("stored", F.when(F.col("case_id").isin("chb01", "chb21"), F.lit("same")).otherwise(F.col("stored")))
    assert ru.cross_group_payloads(within, "stored").count() == 0


def test_hash_mismatch_kinds(good):
    assert ru.classify_hash_mismatch(good, "stored", "computed").first()["status"] == "match"
    a, b = [r[0] for r in good.select("computed").orderBy("record_id").limit(2).collect()]
    swapped = good.withColumn("stored", F.when(F.col("stored") == a, b).when(F.col("stored") == b, a).otherwise(F.col("stored")))
    assert ru.classify_hash_mismatch(swapped, "stored", "computed").first()[:] == (2, 0, "misaligned")
    changed = edit(good, "stored", F.lit("ff"))
    assert ru.classify_hash_mismatch(changed, "stored", "computed").first()[:] == (1, 2, "changed")


def test_summary_lists_first_five(good):
    found = ru.check_records(good.withColumn("label", F.lit(3)), [ru.label_domain()])
    row = ru.summarize_violations(found.repartition(7)).first()
    ids = sorted(r[0] for r in good.select("record_id").collect())
    assert row["n_bad"] == len(ids) and row["examples"] == ", ".join(ids[:5])


def test_amplitude_recordings_and_settings(spark):
    stats = spark.createDataFrame([(3e-5,)], "median_abs double")
    assert ru.implausible_amplitude(stats, 1e6).count() == 0
    assert ru.implausible_amplitude(stats, 1.0).first()["severity"] == "warning"
    ru.assert_valid(ru.implausible_amplitude(stats, 1.0))
    rows = [(f"{s}{i}", s, f"h{s}{i}", 4097, True) for s in "ZO" for i in range(3)]
    df = spark.createDataFrame(rows, "record_id string, set_id string, payload_hash string, length int, finite boolean")
    assert ru.recording_sets(df, 3, "payload_hash", "length", "finite").count() == 0
    bad = df.where("record_id <> 'Z0'").unionByName(spark.createDataFrame([("O9", "O", "hO1", 4096, False)], df.schema))
    assert {r["rule"] for r in ru.recording_sets(bad, 3, "payload_hash", "length", "finite").collect()} == {
        "recordings_per_set", "recording_lengths", "recording_copies"}
    conf = spark.createDataFrame([("r", ["a", "b"], 256)], "record_id string, channels array<string>, fs int")
    assert ru.check_records(conf, [ru.channels_agree("channels", ["a", "b"]), ru.equals_constant("fs", "fs", 256)]).count() == 0
    assert {r["rule"] for r in ru.check_records(conf, [ru.channels_agree("channels", ["b", "a"]), ru.equals_constant("fs", "fs", 128)]).collect()} == {
        "channel_order", "fs"}


def test_shape_rule_and_predictions(spark):
    df = spark.createDataFrame([("r", [[1.0, 2.0]], 2, None)], "record_id string, s array<array<float>>, target int, prob double")
    assert {r["rule"] for r in ru.check_records(df, [ru.payload_shape("s", 2, 2), ru.valid_target(), ru.finite_score()]).collect()} == {
        "payload_shape", "prediction_target", "prediction_score"}
    assert df.select(is_finite(F.flatten("s"))).first()[0]


def test_record_rules_run_on_a_stream(spark, tmp_path):
    """Rules about one record are plain expressions, so a streaming table takes them too."""
    from foldloom.operators.rules import check_records, label_domain

    spark.createDataFrame([("a", 1), ("b", 5)], "record_id string, label int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("record_id string, label int").parquet(str(tmp_path / "in"))
    query = (check_records(stream, [label_domain()]).writeStream.format("memory").queryName("rule_rows")
             .trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert [r["record_id"] for r in spark.table("rule_rows").collect()] == ["b"]
