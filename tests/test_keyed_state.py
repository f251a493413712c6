"""Keyed state in sessions and Python processes that nobody has set up for it."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import types as T

from rivulet import queries
from rivulet.session import keyed_state
from rivulet.streaming import as_of, watermarks

from .oracle import rows, sql_rows
from .test_streaming import Feed, at, collect

STORE = "spark.sql.streaming.stateStore.providerClass"
MARKED = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.LongType())])


@pytest.fixture
def plain(spark):
    """A session with Spark's own state store."""
    session = spark.newSession()
    session.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    return session


def loads_elsewhere(processor, folder):
    """Whether a Python process that knows pyspark only can load the processor."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", "import pickle, sys; pickle.load(sys.stdin.buffer)"], input=cloudpickle.dumps(processor), cwd=folder, env=env, capture_output=True)
    return run.returncode == 0, run.stderr.decode()


@pytest.mark.parametrize("name", ["stream_punctuated", "stream_as_of_left"])
def test_query_with_sparks_own_store(plain, sf, name):
    assert rows(queries.QUERIES[name](plain, sf)) == sql_rows(queries.SQL[name], sf)


@pytest.mark.parametrize("processor", [watermarks.Punctuated(MARKED, "t", "m", "w"), as_of.AsOf(MARKED, MARKED, "left")], ids=["punctuated", "as_of"])
def test_processor_loads_without_the_repository(tmp_path, processor):
    found, why = loads_elsewhere(processor, tmp_path)
    assert found, why


def test_another_store_stays(plain):
    plain.conf.set(STORE, "a.b.OwnProvider")
    keyed_state(plain)
    assert plain.conf.get(STORE) == "a.b.OwnProvider"


T0, OLD = datetime(2024, 1, 1), datetime(1965, 1, 1)
MICRO = timedelta(microseconds=1)
ODD = {
    "microseconds": [(1, T0 + 500 * MICRO, 1, "click"), (2, T0 + 200 * MICRO, 1, "purchase"), (3, T0 + 500 * MICRO, 1, "purchase"), (4, T0 + 600 * MICRO, 1, "click"), (5, T0 + 599 * MICRO, 1, "purchase")],
    "nulls": [(1, T0, None, "click"), (2, T0 + MICRO, None, "purchase"), (3, None, 1, "purchase"), (4, None, 1, "click"), (None, T0, 1, "purchase"), (6, T0, 2, "click"), (7, T0 + MICRO, 2, "purchase"), (8, T0, 2, None)],
    "before 1970": [(1, OLD, 1, "click"), (2, OLD + MICRO, 1, "purchase"), (3, OLD - MICRO, 1, "purchase"), (4, T0, 1, "purchase")],
    "no click": [(1, T0, 1, "purchase"), (2, T0 + MICRO, 2, "purchase")],
    "no purchase": [(1, T0, 1, "click")],
    "no row": [],
}


@pytest.mark.parametrize("case", ODD)
def test_as_of_left_on_odd_events(spark, tmp_path, case):
    events = spark.createDataFrame([(*r, float(i)) for i, r in enumerate(ODD[case])], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "files"))
    next((tmp_path / "files").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert rows(queries.QUERIES["stream_as_of_left"](spark, str(tmp_path))) == sql_rows(queries.SQL["stream_as_of_left"], str(tmp_path))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_as_of_in_steps(spark, tmp_path, how):
    """A key whose rows come due one after another, and null keys and times once the watermark has moved."""
    left, right = Feed(spark, tmp_path / "l", "id string, k string, t timestamp"), Feed(spark, tmp_path / "r", "k string, rt timestamp, v int")
    joined = as_of.stream_as_of_join(left.stream(), right.stream(), {"k": "k"}, "t", "rt", how).select("id", "v")

    def step(lefts, rights):
        return lambda: (right.add(rights), left.add(lefts))

    steps = [
        step([("a", "x", at(1)), ("b", "x", at(20)), ("c", "x", at(50))], [("x", at(0), 0), ("x", at(15), 1), ("x", at(45), 2)]),
        step([("z", "end", at(25))], [("end", at(25), 9)]),
        step([("z", "end", at(60)), ("n", "x", None), ("m", None, at(70)), ("d", "x", at(55))], [("end", at(60), 9), ("x", None, 7), (None, at(65), 7), ("x", at(53), 3)]),
        step([("z", "end", at(900))], [("end", at(900), 9)]),
        step([("z", "end", at(901))], [("end", at(901), 9)]),
    ]
    got = sorted(r for r in collect(joined, f"asof_steps_{how}", steps) if r[0] != "z")
    assert got == [("a", 0), ("b", 1), ("c", 2), ("d", 3), *([("m", None), ("n", None)] if how == "left" else [])]


def test_as_of_has_one_timer_a_key():
    """However many rows of a key wait, it has one timer."""

    class State(list):
        get, clear, exists = lambda self: list(self), list.clear, lambda self: bool(self)
        appendList = put = list.extend
        update = lambda self, v: self.__setitem__(slice(None), v)

        def appendValue(self, v):
            self.append(v)

    class Handle:
        timers = []
        getListState = lambda self, *a: State()
        getValueState = lambda self, *a: type("Value", (State,), {"get": lambda self: tuple(self)})()
        registerTimer = lambda self, t: self.timers.append(t)

    processor = as_of.AsOf(MARKED, MARKED, "left")
    processor.init(Handle())
    row = lambda i: {"__t": i * 1000, "__side": i % 2, "__gone": False, "__left": {"k": 1, "t": i}, "__right": {"k": 1, "t": i}}
    assert not list(processor.handleInputRows((1,), map(row, range(1, 101)), None))
    assert Handle.timers == [1]
    found = list(processor.handleExpiredTimer((1,), type("Mark", (), {"getCurrentWatermarkInMs": lambda self: 50})(), None))
    assert len(found) == 25 and Handle.timers == [1, 51]


def test_as_of_keeps_rows_in_chunks(monkeypatch):
    """Rows of a key are state values by the thousand, not one by one; chunks keep the order of arrival and what is left of it."""

    class State(list):
        get, exists = lambda self: iter(list(self)), lambda self: bool(self)
        appendList = list.extend
        appendValue = list.append

        def put(self, values):
            self[:] = values

    class Handle:
        lists, timers = [], []

        def getListState(self, *a):
            self.lists.append(State())
            return self.lists[-1]

        getValueState = lambda self, *a: type("Value", (State,), {"get": lambda self: tuple(self), "update": lambda self, v: self.put(v)})()
        registerTimer = lambda self, t: self.timers.append(t)

    handle, n = Handle(), 20000
    processor = as_of.AsOf(MARKED, MARKED, "left")
    processor.init(handle)
    row = lambda i, side, v: {"__t": i * 1000, "__side": side, "__gone": False, "__left": {"k": 1, "t": v}, "__right": {"k": 1, "t": v}}
    feed = [row(i, side, i * 10 + side) for i in range(1, n + 1) for side in (0, 1)] + [row(5, 0, -5)]
    assert not list(processor.handleInputRows((1,), iter(feed), None))
    assert sum(map(len, handle.lists)) < len(feed) / 1000
    mark = lambda ms: type("Mark", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    found = [r for ms in (n // 2, n) for r in processor.handleExpiredTimer((1,), mark(ms), None)]
    assert [(r[1], r[3]) for r in found] == [(i * 10 + 1, -5 if i == 5 else i * 10) for i in range(1, n + 1)]
    assert sum(map(len, handle.lists)) == 1  # the latest version stays
    assert handle.timers == [1, n // 2 + 1]
