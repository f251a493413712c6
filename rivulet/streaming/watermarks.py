"""Watermark generators: bounded disorder, a fixed lag behind the clock, and marks carried by events."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import keyed_state

# Spark also loads a processor in a Python process beside the driver, which has neither its sys.path nor files added to the context.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOUNDED_MS = 3500
LAG_MS = 5000


def bounded(df: DataFrame, time: str, delay_ms: int = BOUNDED_MS) -> DataFrame:
    """A stream whose watermark is its largest event time less the delay."""
    return df.withColumn(time, F.col(f"`{time}`").cast("timestamp")).withWatermark(time, f"{delay_ms} milliseconds")


def bounded_value(time_ms: Column, order: list[str], delay_ms: int = BOUNDED_MS) -> Column:
    """The watermark after each row, in order, of a bounded table: the largest time so far less the delay and 1 ms."""
    return F.max(time_ms).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.lit(delay_ms + 1)


def lagging(df: DataFrame, time: str, lag_ms: int = LAG_MS, late: bool = False) -> DataFrame:
    """Rows that aren't behind a watermark that lags the clock by a fixed time, whatever the events (or those that are).

    The clock is that of the micro-batch; rows that pass carry their event time on, so windows over the result need
    a watermark of their own.
    """
    now = F.unix_millis(F.current_timestamp()) - F.lit(lag_ms)
    behind = F.unix_millis(F.col(time).cast("timestamp")) <= now
    return df.where(behind if late else ~behind)


class Punctuated(StatefulProcessor):
    """Per key, the largest mark so far; rows at or before it are late and are flagged."""

    def __init__(self, schema: T.StructType, time: str, marker: str, mark: str):
        self.schema, self.time, self.marker, self.mark = schema, time, marker, mark

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("mark", "mark long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = self.held.get()[0] if self.held.exists() else None
        for row in rows:
            r = row.asDict()
            late = mark is not None and r[self.time] is not None and r[self.time] <= mark
            if r[self.marker] and r[self.mark] is not None:
                mark = r[self.mark] if mark is None else max(mark, r[self.mark])
            yield Row(*self.schema.names, "watermark", "late")(*[r[c] for c in self.schema.names], mark, late)
        if mark is not None:
            self.held.update((mark,))

    def close(self) -> None:
        pass


def punctuated(df: DataFrame, keys: list[str], time_ms: str, marker: str = "watermarkMarker", mark: str = "watermarkTimestamp") -> DataFrame:
    """Rows with `watermark`, the largest mark that marker events of the key have set so far, and `late`."""
    keyed_state(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("watermark", T.LongType()), T.StructField("late", T.BooleanType())])
    return df.groupBy(*keys).transformWithState(Punctuated(df.schema, time_ms, marker, mark), schema, "Append", "None")


def flush_row(df: DataFrame, time: str, after: str = "100 years") -> DataFrame:
    """One row of nulls with an event time far after the last one of a bounded table: appended to a stream, it closes
    every window, as the end of input does."""
    end = df.agg((F.max(time) + F.expr(f"INTERVAL {after}")).alias("__end"))
    return end.select(*[F.col("__end").cast(f.dataType).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
