from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from foldloom.session import local_session

    # Tiny inputs: interpreting a plan is faster than compiling it. The SQL comparison runs compiled.
    session = local_session(cores=4, shuffle_partitions=3, app="foldloom-tests", **{
        "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    yield session
    session.stop()
