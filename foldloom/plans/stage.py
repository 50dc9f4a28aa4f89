"""Tables written once in the shared folder and read back.

What is read back is a plain scan: its size is the true one, so a join may pick the small side, and no partitioning is left over
that would keep a frequent key together. A lost executor costs nothing that was written.
"""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: The folder of the innermost ``staging``.
_SCOPE: contextvars.ContextVar[str | None] = contextvars.ContextVar("staging", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master without it gets a temporary folder, kept for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A folder of its own below the shared one, for tables that are stored for this application only."""
    return f"{_SCOPE.get() or _session_folder(spark)}/{uuid.uuid4().hex}"


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Whatever is staged inside is removed at the end: for work whose result is written before that."""
    folder = new_path(spark)
    token = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        _remove(spark, folder)
        collect_garbage(spark)


def stage(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: later branches start there instead of scanning the sources again."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs that nothing refers to any more. For work that is about to write much."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*tables: DataFrame) -> None:
    """Removes tables that ``stage`` returned, once nothing that is still to run reads them. Other DataFrames are left alone.

    The JVM is asked to collect what refers to the jobs that wrote them: Spark then removes their shuffle files.
    """
    spark = None
    for df in tables:
        path = df.__dict__.pop("_staged_at", None)
        if path:
            spark = df.sparkSession
            _remove(spark, path)
    if spark:
        collect_garbage(spark)


def clear_staged(spark: SparkSession) -> None:
    """Removes what this application has staged. Results that still read it must be written before."""
    _remove(spark, _session_folder(spark))
