"""Small record tables: how many records of each class a case has follows from its place in the list."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foldloom.functions.text import label_name
from foldloom.sources.constants import SAME_PERSON as OWNERS


def counted(cases, least=5, one_class=(), few=()):
    """Class counts of the listed cases, at least ``least`` of each class, but for cases of one class and cases with few records."""
    out = {case: (least + 3 * i % 7, least + 5 * i % 4) for i, case in enumerate(cases)}
    return out | {case: (least + len(cases), 0) for case in one_class} | {case: (least - 2, least - 1) for case in few}


CASES = [f"chb{i:02d}" for i in range(1, 31)]
SMALL = counted([*CASES[:2], "chb21"])
SINGLE = counted(CASES[:5], one_class=["chb03"])
BELOW_MIN = counted(CASES[:6], few=["chb02", "chb05"])
ONE_ELIGIBLE = counted(CASES[:3], few=["chb01", "chb03"])
NINE = counted([*CASES[:6], "chb17a", "chb17b", "chb21"], one_class=["chb04"], few=["chb05"])
MANY = counted([*CASES[:16], "chb17a", "chb17b", *CASES[17:]], one_class=["chb07", "chb11"], few=["chb16", "chb20", "chb24"])


def records(spark, counts):
    rows = [(case, OWNERS.get(case, case), label, n) for case, sizes in counts.items() for label, n in enumerate(sizes) if n]
    df = spark.createDataFrame(rows, "case_id string, group_id string, label int, n int")
    number = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number")
    named = df.select("case_id", "group_id", "label", label_name("label").alias("label_name"), number)
    return named.select(F.format_string("%s/%s/%s-%d.csv", "label_name", "case_id", "case_id", "number").alias("record_id"), "case_id", "group_id",
                        "label", "label_name")


def natural(value):
    return [(0, int(t), "") if t.isdigit() else (1, 0, t) for t in re.findall(r"\d+|\D+", value)]
