"""Event-time as-of join of a stream with a stream of versions, as keyed state."""

from __future__ import annotations

import pickle
import sys
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import keyed_state

# As in watermarks.py: the processor is also loaded beside the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Spark takes what isn't after 1970 for late from the start, so earlier rows have this as their event time.
EPOCH_MS = 1


#: So many rows of a key are one value of its state.
CHUNK = 8192


class AsOf(StatefulProcessor):
    """Left rows wait until the watermark reaches their time; then each meets the key's latest version at or before it.

    Versions at or before the watermark but the latest are dropped, so state is bounded by the disorder. Of versions of
    equal time the last to arrive wins; one of kind -D matches nothing. Null keys and times match nothing and don't wait.
    Times (__t) are in microseconds, the watermark and timers in milliseconds. __side is 1 for left rows, 0 for versions and
    -1 for those of kind -D.

    State is a list of chunks of rows in order of arrival, each pickled as a whole: Spark converts a value, and calls its
    JVM, for each chunk and not for each row.
    """

    def __init__(self, left: T.StructType, right: T.StructType, how: str):
        self.left, self.right, self.how = left, right, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.row = Row(*self.left.names, *self.right.names)
        self.none = (None,) * len(self.right.names)

    def _emit(self, left: tuple, version: tuple | None) -> Iterator[Row]:
        if version is not None or self.how == "left":
            yield self.row(*left, *(version if version is not None else self.none))

    def _packed(self, waiting: list[tuple], versions: list[tuple]) -> tuple[bytes]:
        return (pickle.dumps((waiting, versions), pickle.HIGHEST_PROTOCOL),)

    def _wake(self, first: int | None) -> None:
        """A timer for the first time of the key's new rows; when it expires, the first of those left gets the next."""
        if first is not None:
            self.handle.registerTimer(max(-(-first // 1000), EPOCH_MS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting, versions, first, no_key = [], [], None, any(k is None for k in key)
        left, right = self.left.names, self.right.names
        for r in rows:
            t = r["__t"]
            if no_key or t is None:
                if r["__side"] == 1:
                    yield from self._emit(tuple(r["__left"][c] for c in left), None)
                continue
            first = t if first is None or t < first else first
            side = r["__side"]
            if side == 1:
                row = r["__left"]
                waiting.append((t, tuple([row[c] for c in left])))
            else:
                row = r["__right"]
                versions.append((t, side < 0, tuple([row[c] for c in right])))
            if len(waiting) + len(versions) == CHUNK:
                self.chunks.appendValue(self._packed(waiting, versions))
                waiting, versions = [], []
        if waiting or versions:
            self.chunks.appendValue(self._packed(waiting, versions))
        self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, versions = [], []
        for (packed,) in self.chunks.get():
            some_waiting, some_versions = pickle.loads(packed)
            waiting += some_waiting
            versions += some_versions
        versions.sort(key=itemgetter(0))  # Those of equal time stay in order of arrival.
        times = [v[0] for v in versions]
        left = []
        for row in waiting:
            if row[0] > now:
                left.append(row)
                continue
            at = bisect_right(times, row[0])
            best = versions[at - 1] if at else None
            yield from self._emit(row[1], best[2] if best is not None and not best[1] else None)
        past = bisect_right(times, now)
        kept = versions[max(past - 1, 0) :]
        if len(left) + len(kept) < len(waiting) + len(versions):
            parts = [self._packed(left[i : i + CHUNK], kept[i : i + CHUNK]) for i in range(0, max(len(left), len(kept)), CHUNK)]
            if parts:
                self.chunks.put(parts)
            else:
                self.chunks.clear()
        self._wake(min([r[0] for r in left] + times[past : past + 1], default=None))

    def close(self) -> None:
        pass


def stream_as_of_join(left: DataFrame, right: DataFrame, on: dict[str, str], left_time: str, right_time: str, how: str = "inner", op: str | None = None, delay: str = "2 seconds", condition: Column | None = None) -> DataFrame:
    """left joined with the latest version in right of its key, emitted when the watermark (the lesser of both sides', by
    one shared delay) passes the left row's time. Columns that both sides have are renamed right_<name>.

    condition: tested on the chosen pair, by the names of the result; a pair that fails is no match."""
    names = {c: c if c not in left.columns else f"right_{c}" for c in right.columns}
    keyed_state(left.sparkSession)
    ls, rs = left.schema, T.StructType([T.StructField(names[f.name], f.dataType) for f in right.schema.fields])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    event_time = lambda c: F.when(micros(c) < EPOCH_MS * 1000, F.timestamp_millis(F.lit(EPOCH_MS))).otherwise(F.col(c).cast("timestamp"))
    keys = [f"__k{i}" for i in range(len(on))]
    a = left.select(
        *[F.col(x).alias(k) for x, k in zip(on, keys)], event_time(left_time).alias("__ts"), micros(left_time).alias("__t"), F.lit(1).alias("__side"),
        F.struct(*left.columns).alias("__left"), F.lit(None).cast(rs).alias("__right"),
    )
    b = right.select(
        *[F.col(y).alias(k) for y, k in zip(on.values(), keys)], event_time(right_time).alias("__ts"), micros(right_time).alias("__t"),
        (F.when(F.col(op) == "-D", -1).otherwise(0) if op else F.lit(0)).alias("__side"), F.lit(None).cast(ls).alias("__left"), F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("__right"),
    )
    both = a.withWatermark("__ts", delay).unionByName(b.withWatermark("__ts", delay))
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in ls.fields], *rs.fields])
    joined = both.groupBy(*keys).transformWithState(AsOf(ls, rs, how), out, "Append", "EventTime")
    if condition is None:
        return joined
    if how != "left":
        return joined.where(condition)
    passed = F.coalesce(condition, F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in ls.names], *[F.when(passed, F.col(f"`{c}`")).alias(c) for c in rs.names])
