"""Stores in buckets: joins of two need no shuffle."""

import os
import uuid

from foldloom.operators import reconcile as rc
from foldloom.sources import stores


def test_stores_meet_without_a_shuffle(spark, tmp_path):
    a = spark.range(200).selectExpr("concat('r', id) AS record_id", "cast(id % 3 AS int) AS label")
    b = a.where("record_id <> 'r7'").selectExpr("record_id", "CASE WHEN record_id IN ('r1', 'r2') THEN 9 ELSE label END AS label")
    names = [f"t{uuid.uuid4().hex}" for _ in range(3)]
    left, right = (stores.write_store(df.repartition(5), n, str(tmp_path / n), buckets=4) for df, n in zip((a, b), names))
    found = rc.disagreements(left, right)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in rc.disagreements(left, right)._jdf.queryExecution().executedPlan().toString()
        again = stores.attach_store(spark, names[2], str(tmp_path / names[1]), "record_id string, label int", buckets=4)
        assert "Exchange" not in left.join(again, "record_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(tuple(r) for r in found.collect()) == [("r1", 1, 9, None), ("r2", 2, 9, None), ("r7", 1, None, "right")]
    assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / names[0])) == 4
    for name in names:
        spark.sql(f"DROP TABLE {name}")
