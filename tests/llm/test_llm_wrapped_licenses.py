"""Notices that wrap over lines."""

import textwrap

from foldloom.llm import license_scan


def test_wrapped_notices_meet_their_templates(spark):
    rows = []
    for label, text, *_ in license_scan.TEMPLATES:
        for width, mark in ((24, ""), (40, " * "), (70, "# ")):
            lines = textwrap.wrap(text, width)
            rows.append((len(rows), label, "some code\n" * 30 + "\n".join(mark + x for x in lines) + "\nmore code" * 30))
    df = spark.createDataFrame(rows, "doc_id long, label string, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(df).collect()}
    assert all(label in got[i][0].split(",") and got[i][1] == 1.0 for i, label, _ in rows)


def test_scattered_words_meet_nothing(spark):
    words = license_scan.TEMPLATES[4][1].split()
    df = spark.createDataFrame([(1, ("\n" + "filler " * 9 + "\n").join(words))], "doc_id long, text string")
    assert license_scan.scan_licenses(df).first()["labels"] == ""
