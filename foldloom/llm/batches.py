"""Reading text columns of Arrow batches and building the output of ``mapInArrow`` steps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Byte table: A-Z become a-z; the other ASCII characters that are no digit and no letter become spaces.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def release_memory() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and what they hold counts against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def words_of(raw: bytes) -> list[bytes]:
    """Words of letters, digits and any non-ASCII characters, with A-Z lower-cased."""
    return raw.translate(WORD_TABLE).split()


def extended(df: DataFrame, keep: Iterable[str] | None, added: list[T.StructField]) -> tuple[list[str], T.StructType]:
    """Columns that pass through and the schema with ``added`` behind them; an added name replaces a column of that name."""
    names = {f.name for f in added}
    passed = [c for c in (df.columns if keep is None else keep) if c not in names]
    return passed, T.StructType([df.schema[c] for c in passed] + added)


def with_columns(batch: pa.RecordBatch, passed: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The passed columns of ``batch`` followed by ``added``."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in passed]
    return pa.RecordBatch.from_arrays(columns + list(added.values()), names=passed + list(added))
