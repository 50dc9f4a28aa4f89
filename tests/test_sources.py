import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldloom.functions.signal import payload_sha256
from foldloom.operators import folds as fo
from foldloom.operators import metrics as me
from foldloom.operators import plancheck as pc
from foldloom.operators import profile as pr
from foldloom.operators import reconcile as rc
from foldloom.operators import rules as ru
from foldloom.sources import files, ledger, plans, recordings, segments, sinks
from foldloom.sources.constants import CHANNELS
from tables import NINE, records


def write_segments(root, n=6):
    rng = np.random.default_rng(4)
    truth = {}
    for case, label in (("chb01", 0), ("chb01", 1), ("chb02", 0), ("chb21", 1)):
        folder = root / ("nonseizure", "seizure")[label] / case
        folder.mkdir(parents=True, exist_ok=True)
        values = rng.normal(size=(n, len(CHANNELS))) * 2e-5
        lines = [",".join([*CHANNELS, "label"])] + [",".join([repr(float(v)) for v in row] + [str(label)]) for row in values]
        path = folder / f"{case}_01.csv"
        path.write_text("\n".join(lines) + "\n")
        truth[f"{folder.parent.name}/{case}/{case}_01.csv"] = (values.T.astype("<f4"), path)
    (root / "segment_manifest.csv").write_text("segment_file,patient,label\n" + "".join(
        f"{k.replace('/', chr(92))},{k.split('/')[1]},{int(k.startswith('s'))}\n" for k in truth))
    return truth


def test_segments(spark, tmp_path):
    truth = write_segments(tmp_path)
    df = segments.read_segments(spark, str(tmp_path))
    rows = {r["record_id"]: r for r in df.withColumn("sha", payload_sha256(F.flatten("signal"))).collect()}
    assert set(rows) == set(truth)
    for key, (signal, path) in truth.items():
        assert np.array_equal(np.array(rows[key]["signal"], dtype="<f4"), signal)
        assert rows[key]["sha"] == hashlib.sha256(np.ascontiguousarray(signal).tobytes()).hexdigest()
        assert rows[key]["file_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
        assert rows[key]["label"] == int(key.startswith("s")) and rows[key]["case_id"] == key.split("/")[1]
    rule_set = segments.segment_rules(samples=6)
    assert ru.check_records(df, rule_set).count() == 0
    manifest = segments.read_segment_manifest(spark, str(tmp_path / "segment_manifest.csv"))
    listed = manifest.select(F.col("segment_file").alias("record_id"), F.col("label").cast("int").alias("label"))
    assert ru.key_sets_differ(df, listed, "record_id").count() == 0
    assert ru.column_differs(df, listed, "record_id", "label", "manifest_label").count() == 0
    # One file with swapped channels, a missing row, mixed labels and a wrong folder.
    path = truth["seizure/chb21/chb21_01.csv"][1]
    lines = path.read_text().splitlines()
    head = lines[0].split(",")
    bad = [",".join([head[1], head[0], *head[2:]])] + [x[:-1] + "0" for x in lines[1:4]] + lines[4:6]
    path.write_text("\n".join(bad))
    found = {r["rule"] for r in ru.check_records(segments.read_segments(spark, str(tmp_path)), rule_set).collect()}
    assert found == {"segment_header", "segment_rows", "segment_labels", "label_name"}
    path.write_text(lines[0] + "\n" + "\n".join(["nan" + x[x.index(","):] for x in lines[1:]]))
    assert {r["rule"] for r in ru.check_records(segments.read_segments(spark, str(tmp_path)), rule_set).collect()} == {"non_finite"}


def test_segment_table_and_metadata(spark, tmp_path):
    data = records(spark, NINE)
    segments.write_segments(data, str(tmp_path / "t"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "t")).drop("group_bucket").exceptAll(data).count() == 0
    (tmp_path / "m.csv").write_text('segment_id,patient,subject,label,signal_sha256,segment_index,recording\na,p,s,1,h,7,\nb,p,,0,h,x,""\n')
    rows = segments.read_metadata(spark, str(tmp_path / "m.csv")).orderBy("record_id").collect()
    assert [(r["record_id"], r["subject"], r["segment_index"], r["recording"]) for r in rows] == [("a", "s", 7, ""), ("b", "", None, "")]


def test_channel_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"channels": list(CHANNELS), "fs": 256, "n_samples": 100}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"selected_eeg_channels": list(CHANNELS)[::-1]}))
    both = segments.read_channel_sources(spark, {"report": (str(tmp_path / "r.json"), "channels"),
                                                 "config": (str(tmp_path / "c.json"), "selected_eeg_channels")})
    assert [r["record_id"] for r in segments.check_channel_sources(both).collect()] == ["config"]
    assert segments.check_channel_sources(both.where("record_id = 'report'")).count() == 0
    none = both.where("record_id = 'x'")
    assert segments.check_channel_sources(none).count() == 1 and segments.check_channel_sources(none, required=False).count() == 0
    settings = segments.read_report_settings(spark, str(tmp_path / "r.json"))
    assert [r["rule"] for r in ru.check_records(settings, segments.settings_rules(256, 2560)).collect()] == ["declared_n_samples"]


def test_recordings(spark, tmp_path):
    sets = {"Z": ("Z", "A", "Set_Z"), "S": ("S", "E", "Set_S")}
    (tmp_path / "A" / "Z").mkdir(parents=True)
    (tmp_path / "S" / "__MACOSX").mkdir(parents=True)
    (tmp_path / "A" / "Z" / "Z002.TXT").write_bytes("\ufeff1\r\n2\r\n-3\r\n".encode())
    (tmp_path / "A" / "Z" / "Z001.txt").write_text("4\n5\n6\n")
    (tmp_path / "S" / "S001.txt").write_text("7\n8\n9")
    (tmp_path / "S" / "__MACOSX" / "S001.txt").write_text("junk")
    rows = recordings.read_recordings(spark, str(tmp_path), sets).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["set_id"], r["record_id"], r["signal"]) for r in rows] == [
        (1, "Z", "A/Z/Z001.txt", [4.0, 5.0, 6.0]), (2, "Z", "A/Z/Z002.TXT", [1.0, 2.0, -3.0]), (3, "S", "S/S001.txt", [7.0, 8.0, 9.0])]
    (tmp_path / "E").mkdir()
    (tmp_path / "E" / "x.txt").write_text("1")
    with pytest.raises(recordings.LayoutError):
        recordings.read_recordings(spark, str(tmp_path), sets)


def test_file_scan_against_manifest(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a" / "__pycache__").mkdir(parents=True)
    contents = {"a/x.csv": b"1", "a/y.csv": b"2", "z.bin": bytes(range(200))}
    for name, body in contents.items():
        (root / name).write_bytes(body)
    for junk in ("a/__pycache__/m.bin", "a/w.pt", "a/._x", "a/.DS_Store"):
        (root / junk).write_bytes(b"j")
    found = files.scan_files(spark, str(root))
    assert {r["path"]: r["sha256"] for r in found.collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in contents.items()}
    listed = {**contents, "gone.csv": b"", "a/y.csv": b"other"}
    (tmp_path / "M").write_text("".join(f"{hashlib.sha256(v).hexdigest()}  {'*' if k == 'z.bin' else ''}{k}\n" for k, v in listed.items()) + "\n")
    checked = rc.verify_files(found, files.read_file_manifest(spark, str(tmp_path / "M")))
    assert {r["path"]: r["status"] for r in checked.collect()} == {"a/x.csv": "ok", "z.bin": "ok", "a/y.csv": "different", "gone.csv": "missing"}
    assert rc.verification_summary(checked).first()[:] == (2, 1, 1, 0, False)


@pytest.fixture(scope="module")
def planned(spark):
    data = records(spark, NINE).withColumn("payload_hash", F.sha2("record_id", 256))
    heads = fo.logo_folds(pr.case_counts(data), "case")
    return data, heads, pc.stage(pc.expand_plan(data, heads))


def test_plan_is_written_and_replayed(spark, tmp_path, planned):
    data, folds, members = planned
    path = str(tmp_path / "p")
    plans.write_plan_table(folds, members, data, path, 5, 42, "payload_hash")
    heads, rows = plans.replay_plan(spark, path, data.orderBy(F.rand(2)), "payload_hash", {"unit_kind": "case", "min_per_class": 5, "seed": 42})
    assert heads.exceptAll(folds).count() == 0 and rows.exceptAll(members.select(*rows.columns)).count() == 0
    assert plans.plan_digest(folds.repartition(3), members.repartition(5)) == plans.plan_digest(folds, members)

    def fails(match, source=data, at=path, **kw):
        with pytest.raises(fo.FoldPlanError, match=match):
            plans.replay_plan(spark, at, source, "payload_hash", **kw)

    fails("different settings", wanted={"seed": 7})
    fails("covers", data.where("case_id <> 'chb05'"))
    fails("records_digest", data.withColumn("label", F.when(F.col("case_id") == "chb04", 1).otherwise(F.col("label"))))
    fails("payload_digest", data.withColumn("payload_hash", F.sha2("case_id", 256)))
    one = rows.where("fold = 1 AND part = 'train'").limit(1).first()["record_id"]
    edited = members.withColumn("part", F.when((F.col("fold") == 1) & (F.col("record_id") == one), "test").otherwise(F.col("part")))
    other = str(tmp_path / "q")
    plans.write_plan_table(folds, edited, data, other, 5, 42)
    fails("rules are broken", at=other)
    edited.repartition("fold").write.mode("overwrite").partitionBy("fold").parquet(path + "/members")
    fails("modified")
    (tmp_path / "r").mkdir()
    spark.read.json(path + "/info").withColumn("format", F.lit("other/1")).write.json(str(tmp_path / "r" / "info"))
    folds.write.parquet(str(tmp_path / "r" / "heads"))
    edited.write.partitionBy("fold").parquet(str(tmp_path / "r" / "members"))
    fails("format", at=str(tmp_path / "r"))


def test_plan_document_is_read(spark, tmp_path):
    fold = {"fold": 1, "name": "fold_a", "unit": "subject", "test_unit": "a", "test_subject": "a", "val_subject": "b", "excluded_units": [], "seed": 43,
            "train": ["r3", "r4"], "val": ["r2"], "test": ["r1"]}
    path = tmp_path / "plan.json"
    path.write_text(json.dumps({"format": "x", "n_records": 4, "n_folds": 1, "folds": [fold]}, indent=1))
    info, folds, members = plans.read_plan_document(spark, str(path))
    assert info.first()["n_records"] == 4 and folds.first()["unit_kind"] == "group"
    assert {tuple(r) for r in members.collect()} == {(1, "train", "r3"), (1, "train", "r4"), (1, "val", "r2"), (1, "test", "r1")}


def test_sinks(spark, tmp_path):
    data = records(spark, NINE)
    cases = pr.case_counts(data)
    sinks.write_fold_manifest(fo.fold_manifest(fo.logo_folds(cases, "case")), cases, str(tmp_path / "m"))
    text = [line for f in sorted(os.listdir(tmp_path / "m")) if f.endswith(".csv") for line in (tmp_path / "m" / f).read_text().splitlines()]
    assert text[0].split(",") == list(sinks.MANIFEST_FILE) and len([x for x in text if not x.startswith("fold,")]) == 9
    row = next(dict(zip(text[0].split(","), x.split(","))) for x in text if x.split(",")[1] == "chb21")
    assert (row["excluded_units"], row["validation_cases"], row["lopo_unit"], row["fit_seed"]) == ("chb01", "chb02", "case", "51")
    sinks.write_report(pr.dataset_report(data), str(tmp_path / "r"))
    report = spark.read.json(str(tmp_path / "r"))
    assert report.where("section = 'single_class_case'").first()["key"] == "chb04"
    oof = data.select(F.col("group_id").alias("unit"), F.col("label").alias("target"), (F.abs(F.hash("record_id")) % 10 / 10).alias("prob"))
    sinks.write_eval_tables(me.evaluation_report(oof), str(tmp_path / "e"), oof)
    assert sorted(os.listdir(tmp_path / "e")) == ["fold_metrics", "fold_summary_all", "fold_summary_both_classes", "out_of_fold_predictions", "pooled"]
    assert sorted(spark.read.parquet(str(tmp_path / "e" / "out_of_fold_predictions")).collect()) == sorted(oof.collect())
    assert spark.read.parquet(str(tmp_path / "e" / "fold_metrics")).count() == 7


def test_ledger(spark, tmp_path):
    q = tmp_path / "jobs" / "b"
    for sub in ("done", "failed", "claims/j3"):
        (q / sub).mkdir(parents=True)
    (q / "jobs.jsonl").write_text("".join(json.dumps({"id": f"j{i}", "expect_complete": 2, "params": {}}) + "\n" for i in range(1, 6)))
    for name in ("done/j1", "done/j2", "failed/j2", "failed/j4", "claims/j3/owner"):
        (q / f"{name}.json").write_text("{}")
    for job, study, n in (("j1", "study_a", 2), ("j2", "study_a", 1), ("j4", "study_b", 1)):
        for i in range(n):
            folder = tmp_path / "runs" / "b" / job / study / f"fit_{i}"
            folder.mkdir(parents=True)
            (folder / "complete.json").write_text("{}")
            (folder / "history.csv").write_text("epoch,val_macro_f1\n1,0.5\n2,0.9\n3,0.9\n")
    states = rc.job_states(ledger.read_jobs(spark, str(tmp_path)), ledger.read_job_records(spark, str(tmp_path)))
    outputs = ledger.read_outputs(spark, str(tmp_path))
    assert {r["job_id"]: r["state"] for r in states.collect()} == {
        "j1": "done", "j2": "done", "j3": "interrupted", "j4": "failed", "j5": "waiting"}
    row = rc.completeness(states, rc.output_counts(outputs)).first()
    assert (row["n_jobs"], row["n_done"], row["n_failed"], row["n_expected"], row["n_outputs"], row["incomplete"]) == (5, 2, 1, 10, 4, True)
    done = rc.complete_tasks(states, rc.output_counts(outputs)).orderBy("position").collect()
    assert [(r["job_id"], r["complete"]) for r in done] == [("j1", True), ("j2", False)]
    assert rc.merge_outputs(states, outputs).count() == 3
    other = outputs.withColumn("study_id", F.when(F.col("job_id") == "j2", "study_b").otherwise(F.col("study_id")))
    with pytest.raises(rc.MergeError, match="b"):
        rc.merge_outputs(states, other)
    with pytest.raises(rc.MergeError):
        rc.merge_outputs(states.where("state = 'failed'"), outputs)
    best = me.best_epoch(ledger.read_history(spark, str(tmp_path / "runs")))
    assert {(r["fit"], r["best_epoch"]) for r in best.collect()} == {("fit_0", 2), ("fit_1", 2)}
    rollup = rc.ledger_rollup(states, outputs.withColumn("finished_at", F.lit(1000) + F.length("path") * 0), F.lit(4600)).first()
    assert (rollup["n_outputs"], rollup["n_recent"], rollup["percent"], rollup["overall_rate"]) == (4, 0, 40.0, 4.0)


def test_unchanged_files_are_not_hashed_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PATHS_AT_ONCE", 2)
    root = tmp_path / "tree"
    (root / "sub [1]").mkdir(parents=True)
    names = ["a.txt", "sub [1]/b{x}.txt", "sub [1]/c*.txt", "d.txt", "e.txt"]
    for name in names:
        (root / name).write_text(name)
        os.utime(root / name, (1_700_000_000, 1_700_000_000))
    (root / "._junk").write_text("x")
    stored = lambda df, at: (df.write.parquet(str(tmp_path / at)), spark.read.parquet(str(tmp_path / at)))[1]
    first = stored(files.scan_changed(spark, str(root)), "one")
    assert {r["path"] for r in first.where("hashed").collect()} == set(names)
    again = files.scan_changed(spark, str(root), first)
    assert again.where("hashed").count() == 0 and "content" not in again._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, again.drop("hashed").collect())) == sorted(map(tuple, first.drop("hashed").collect()))
    (root / "sub [1]/b{x}.txt").write_text("other")          # another length
    (root / "d.txt").write_text("D.txt")                     # the same length at another time
    (root / "f?.txt").write_text("new")
    (root / "a.txt").unlink()
    second = stored(files.scan_changed(spark, str(root), first), "two")
    assert {r["path"] for r in second.where("hashed").collect()} == {"sub [1]/b{x}.txt", "d.txt", "f?.txt"}
    whole = {(r["path"], r["sha256"]) for r in files.scan_files(spark, str(root)).collect()}
    assert {(r["path"], r["sha256"]) for r in second.collect()} == whole and len(whole) == 5
