"""Lookup join with delayed retries, as keyed state with processing-time timers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.joins import RetryPolicy

Lookup = Callable[[tuple], list[dict]]

#: The column with the rows that the first attempt found.
FOUND = "__found"


class RetryLookup(StatefulProcessor):
    """Looks a key up when its row comes; a row that finds nothing waits in list state and is tried again on timers.

    State holds rows with the attempts made and the time of the next. Each row is judged by itself: a row is emitted
    with all that the first successful attempt finds, or after the last one with nulls (left) or not at all (inner).
    An error of the lookup fails the task. Rows and timers are part of the checkpoint. joined: the rows come with what
    the first attempt found, in FOUND, so that only what waits is looked up by key.
    """

    def __init__(self, lookup: Lookup, keys: list[str], rows: T.StructType, found: T.StructType, policy: RetryPolicy, how: str, joined: bool = False):
        self.lookup, self.keys, self.rows, self.found, self.policy, self.how, self.joined = lookup, keys, rows, found, policy, how, joined

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", T.StructType([T.StructField("__attempts", T.IntegerType()), T.StructField("__due", T.LongType()), *self.rows.fields]))

    def _emit(self, row: dict, found: list[dict]) -> Iterator[Row]:
        names = [*self.rows.names, *self.found.names]
        for f in found:
            yield Row(*names)(*[row[c] for c in self.rows.names], *[f.get(c) for c in self.found.names])

    def _null(self, row: dict) -> Iterator[Row]:
        return self._emit(row, [{}] if self.how == "left" else [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        found = [] if self.joined else self.lookup(tuple(key))
        due = now + int(self.policy.delay_seconds * 1000)
        waits = False
        for r in rows:
            row = r.asDict()
            if self.joined:
                found = [{c: f[c] for c in self.found.names} for f in r[FOUND]] if r[FOUND] is not None else []
            if found:
                yield from self._emit(row, found)
            elif self.policy.count < 1:
                yield from self._null(row)
            else:
                self.pending.appendValue((0, due, *[row[c] for c in self.rows.names]))
                waits = True
        if waits:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        found = self.lookup(tuple(key)) if any(r[1] <= now for r in held) else []
        left, due_next = [], now + int(self.policy.delay_seconds * 1000)
        for attempts, due, *values in held:
            row = dict(zip(self.rows.names, values))
            if due > now:
                left.append((attempts, due, *values))
            elif found:
                yield from self._emit(row, found)
            elif attempts + 1 >= self.policy.count:
                yield from self._null(row)
            else:
                left.append((attempts + 1, due_next, *values))
        self.pending.clear()
        if left:
            self.pending.put(left)
            if any(r[1] == due_next for r in left):
                self.handle.registerTimer(due_next)

    def close(self) -> None:
        pass


def retry_lookup_join(stream: DataFrame, lookup: Lookup, keys: list[str], found: T.StructType, policy: RetryPolicy = RetryPolicy(), how: str = "left", dimension: DataFrame | None = None, on: dict[str, str] | None = None) -> DataFrame:
    """stream joined with what `lookup` gives for its keys at the time, with retries.

    lookup: from the key's values to rows (dicts of `found`'s columns); called in the tasks, so it must read the
    dimension anew each time. Waiting rows keep their types. Input is partitioned by key: a key's lookups and waiting rows
    are in one place.
    dimension: a batch frame with `found`'s columns, of the same rows that `lookup` reads. With it the first attempt of all
    rows of a micro-batch is one join, which reads the dimension once; only rows that wait are looked up by key. JDBC
    and table formats are read as they are then; of plain files Spark keeps the list that it had when the frame was made,
    so rows of later files are found by the retries alone.
    on: the columns of keys to those of the dimension, if they are called otherwise.
    """
    schema = T.StructType([*stream.schema.fields, *found.fields])
    processor = RetryLookup(lookup, keys, stream.schema, found, policy, how, dimension is not None)
    if dimension is not None:
        sides = {k: f"__k{i}" for i, k in enumerate(keys)}
        by_key = dimension.select(*[F.col(f"`{(on or {}).get(k, k)}`").alias(s) for k, s in sides.items()], F.struct(*[F.col(f"`{c}`") for c in found.names]).alias("__row"))
        # A key's rows are all emitted with each row of the stream, so they fit one.
        grouped = by_key.groupBy(*sides.values()).agg(F.collect_list("__row").alias(FOUND))
        met = F.lit(True)
        for k, s in sides.items():
            met = met & (F.col(f"`{k}`") == F.col(s))
        stream = stream.join(grouped, met, "left").select(*[F.col(f"`{c}`") for c in stream.columns], FOUND)
    return stream.groupBy(*keys).transformWithState(processor, schema, "Append", "ProcessingTime")


def parquet_lookup(path: str, key_columns: list[str], ttl_seconds: float = 0.0, max_keys: int = 10_000) -> Lookup:
    """A lookup in Parquet files that all executors can read, with a cache of `max_keys` keys for `ttl_seconds`."""
    cache: dict = {}

    def look(key: tuple) -> list[dict]:
        import pyarrow.dataset as ds

        now = time.monotonic()
        if key in cache and now - cache[key][0] < ttl_seconds:
            return cache[key][1]
        wanted = None
        for column, value in zip(key_columns, key):
            one = ds.field(column) == value
            wanted = one if wanted is None else wanted & one
        rows = ds.dataset(path).to_table(filter=wanted).to_pylist()
        if ttl_seconds > 0:
            while len(cache) >= max_keys:
                cache.pop(next(iter(cache)))
            cache[key] = (now, rows)
        return rows

    return look
