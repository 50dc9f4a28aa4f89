"""Every registered query against its SQL, and the shape of its plan."""

import os
import re

import pytest

from __spark_entry__ import entry
from foldloom.queries import all_queries as queries
from foldloom.queries import all_sql as oracle_sql
from oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The one expression without a built-in form: SHA-256 over float bytes.
PYTHON = {"payload_hashes"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and (name in PYTHON or "ArrowEvalPython" not in plan)
    # A window without a partition may only run over tables with one row per range.
    for line in re.findall(r"Window \[.*", plan):
        if re.search(r"windowspecdefinition\((?:specifiedwindowframe|_range#\d+ (?:ASC|DESC)|lit)", line):
            assert "_range" in line
    if name in oracle_sql():
        assert compare(df, con, oracle_sql()[name]) is None
    else:
        assert df.count() > 0


def test_every_query_without_sql_is_known():
    assert set(queries()) == set(oracle_sql())


def test_heads_are_the_small_side(spark):
    """Staged heads have their true size, so the records stay where they are when a plan is small."""
    plan = queries()["tested_in"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert "BuildRight" in join


def test_entry(spark):
    assert entry(spark).count() > 0
