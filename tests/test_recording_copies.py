"""Repeated payloads are part of the recording sets."""

from foldloom.queries import all_queries


def test_recording_sets_show_repeated_payloads(spark, tmp_path):
    rows = [(7, [1.0, 2.0], 0), (3, [1.0, 2.0], 1), (5, [2.0, 1.0], 0), (9, [1.0, 2.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = all_queries()["recording_sets"](spark, str(tmp_path)).where("rule = 'recording_copies'").collect()
    assert [(r["severity"], r["record_id"], r["detail"]) for r in found] == [("error", "3", "3 equal payloads")]
