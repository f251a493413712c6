"""Time functions of the SQL surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_text(ts: Column) -> Column:
    """CAST(ts AS STRING) of a TIMESTAMP(3): always three digits of a second."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def date_format(ts: Column, pattern: str) -> Column:
    """DATE_FORMAT(ts, pattern), for instance 'yyyy-MM-dd HH:00' as an hour's bucket."""
    return F.date_format(ts, pattern)


def proctime() -> Column:
    """Processing time: one value for a statement or micro-batch."""
    return F.current_timestamp()


def at_precision(ts: Column, digits: int) -> Column:
    """TIMESTAMP(digits) of a microsecond timestamp: 0 to whole seconds, 3 to milliseconds, 6 as it is."""
    if digits >= 6:
        return ts
    return F.date_trunc({0: "SECOND", 3: "MILLISECOND"}[digits], ts)
