"""Slices of time, for keys that hold much of the rows.

A window by key puts all rows of a key into one task. Cut by the values of the column that orders it, a key is as many groups
as it has slices, and each begins with what the slices before it amount to: a row a slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key from which it is cut.
HOT_ROWS = 1_000_000

_LAST = 2**63 - 1


def _number(t: Column, kind: T.DataType) -> Column | None:
    """t as a number that ascends with it, seconds for times; None for types that have none."""
    if isinstance(kind, T.NumericType):
        return t.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(t.cast("timestamp")) / 1e6
    return None


def width(rows: DataFrame, keys: list[str], time: str, kind: T.DataType | None = None, most: int | None = None) -> float | None:
    """The length of slices by which the largest key has about `most` rows (HOT_ROWS) in each, if its rows are spread evenly.

    kind: the type of `time`, a column of rows. None if no key has more, if `time` is neither number nor time, or if all rows of the largest key have one time or an infinite
    one. It counts the rows by key, one job.
    """
    most = most or HOT_ROWS
    kind = kind or next((f.dataType for f in rows.schema if f.name == time), T.NullType())
    t = _number(F.col(f"`{time}`"), kind)
    if t is None:
        return None
    by_key = rows.groupBy(*keys).agg(F.count("*").alias("__n"), (F.max(t) - F.min(t)).alias("__span"))
    n, span = by_key.agg(F.max("__n"), F.max_by("__span", "__n")).first()
    return span / -(-n // most) if n and n > most and span and math.isfinite(span) else None


def slot(t: Column, kind: T.DataType, length: float) -> Column:
    """The number of t's slice: it ascends with t, nulls have none and come first, NaN comes last."""
    number = F.floor(_number(t, kind) / F.lit(float(length)))
    return F.when(F.isnan(t), F.lit(_LAST)).otherwise(number) if isinstance(kind, (T.FloatType, T.DoubleType)) else number


def cut(rows: DataFrame, keys: list[str], time: str, length: float) -> DataFrame:
    """rows with __key (a struct, so that null keys are keys too), __slot, and __part, the two together."""
    placed = rows.withColumn("__key", F.struct(*keys)).withColumn("__slot", slot(F.col(f"`{time}`"), rows.schema[time].dataType, length))
    return placed.withColumn("__part", F.struct("__key", "__slot"))
