"""Expressions over numeric payloads (``ARRAY<FLOAT>`` or channel-major ``ARRAY<ARRAY<FLOAT>>``)."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.functions.text import as_column


@F.pandas_udf(T.StringType())
def payload_sha256(signal: pd.Series) -> pd.Series:
    """SHA-256 of the little-endian float32 bytes of a flat signal; Spark has no float-to-bytes function."""
    return signal.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, dtype="<f4").tobytes()).hexdigest())


def is_finite(signal: str | Column) -> Column:
    """True when no value is NULL, NaN or infinite (NaN sorts above infinity, so one comparison is enough)."""
    return F.coalesce(F.forall(as_column(signal), lambda x: F.abs(x) < F.lit(math.inf)), F.lit(False))


def has_length(signal: str | Column, *lengths: int) -> Column:
    return F.coalesce(F.size(as_column(signal)).isin(*lengths), F.lit(False))


def has_shape(signal: str | Column, channels: int, samples: int) -> Column:
    """True for exactly ``channels`` rows of ``samples`` values."""
    column = as_column(signal)
    inner = F.forall(column, lambda row: F.coalesce(F.size(row) == samples, F.lit(False)))
    return F.coalesce((F.size(column) == channels) & inner, F.lit(False))


def check_scale(factor: float) -> float:
    value = float(factor)
    if not (math.isfinite(value) and value > 0):
        raise ValueError(f"the unit scale must be a positive finite number, got {factor!r}")
    return value


def _times(x: Column, factor: float) -> Column:
    """``x`` times ``factor`` in float32; an error where a finite value becomes infinite."""
    y = (x * F.lit(factor).cast("float")).cast("float")
    lost = (F.abs(y) == F.lit(math.inf)) & (F.abs(x) < F.lit(math.inf))
    return F.when(lost, F.raise_error(F.lit(f"a value times {factor} overflows float32")).cast("float")).otherwise(y)


def scale_units(signal: str | Column, factor: float) -> Column:
    """Flat signal times ``factor`` in float32; values that overflow raise an error."""
    scale = check_scale(factor)
    return F.transform(as_column(signal), lambda x: _times(x, scale))


def scale_channels(signal: str | Column, factor: float) -> Column:
    scale = check_scale(factor)
    return F.transform(as_column(signal), lambda row: F.transform(row, lambda x: _times(x, scale)))


def stride_probe(signal: str | Column, step: int = 8) -> Column:
    """Every ``step``-th value, starting with the first."""
    return F.filter(as_column(signal), lambda _, i: i % step == 0)


def to_channel_major(rows: str | Column, channels: int) -> Column:
    """``[time][channel]`` to ``[channel][time]``; a value that a short row lacks becomes NULL."""
    def channel(c: int) -> Column:
        return F.transform(as_column(rows), lambda row: F.get(row, F.lit(c)))

    return F.array(*[channel(c) for c in range(channels)])
