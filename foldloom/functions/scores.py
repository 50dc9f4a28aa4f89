"""Expressions over scores and metric values; undefined is NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldloom.functions.text import as_column

# Fixed value: the decision threshold; a score equal to it counts as positive.
THRESHOLD = 0.5


def decide(prob: str | Column, threshold: float = THRESHOLD) -> Column:
    return (as_column(prob) >= F.lit(threshold)).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL when ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite_or_null(value: str | Column) -> Column:
    column = as_column(value)
    return F.when(F.abs(column) < F.lit(math.inf), column)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL wherever a float stands: in columns, arrays, structs and map values, at any depth."""
    changed = {f.name: _safe(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if _holds_floats(f.dataType)}
    return df.withColumns(changed) if changed else df


def _holds_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_floats(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def _safe(value: Column, kind: T.DataType) -> Column:
    if not _holds_floats(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _safe(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return finite_or_null(value)


def format_mean_sd(mean: Column, sd: Column, n_defined: Column, n_folds: Column, digits: int = 3) -> Column:
    """``0.912 ± 0.050 (n=22/23)``; ``n/a`` for the spread of one fold, ``undefined`` without any."""
    number = f"%.{digits}f"
    spread = F.when(sd.isNull() | F.isnan(sd), "n/a").otherwise(F.format_string(number, sd))
    text = F.concat(F.format_string(number, mean), F.lit(" ± "), spread, F.lit(" (n="),
                    n_defined.cast("string"), F.lit("/"), n_folds.cast("string"), F.lit(")"))
    return F.when(n_defined == 0, "undefined").otherwise(text)
