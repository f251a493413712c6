"""Streams, run to completion over files."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators import windows
from rivulet.operators.joins import RetryPolicy
from rivulet.streaming import as_of, retry_lookup, sinks, sources, watermarks

T0 = datetime(2020, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


class Feed:
    """A folder of files: each `add` is a micro-batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 50).parquet(self.path)


def collect(df, name, steps, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        for step in steps:
            step()
            query.processAllAvailable()
        return [tuple(r) for r in df.sparkSession.table(name).collect()]
    finally:
        query.stop()


def test_tumbling_window_streams_like_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "ts timestamp, v int")
    rows = [(at(1), 1), (at(6), 2), (at(3), 3), (at(8), 4)]
    stream = watermarks.bounded(feed.stream(), "ts", 3500)
    found = windows.aggregate(stream, windows.tumble("ts", "5 seconds"), [], F.sum("v").alias("s")).select("window_start", "s")
    got = collect(found, "tumbling", [lambda: feed.add(rows[:2]), lambda: feed.add(rows[2:]), lambda: feed.add([(at(100), 0)])])
    assert sorted(got) == [(at(0), 4), (at(5), 6)]


def test_count_distinct_streams(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "ts timestamp, u string")
    stream = feed.stream().withWatermark("ts", "1 second")
    found = windows.count_distinct(stream, windows.tumble("ts", "5 seconds"), "u", "uv").select("window_start", "uv")
    got = collect(found, "uv", [lambda: feed.add([(at(1), "a"), (at(2), "a"), (at(3), "b")]), lambda: feed.add([(at(60), "z")]), lambda: feed.add([(at(120), "z")])])
    assert (at(0), 2) in got


def test_retry_lookup(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "id1 string, id2 string")
    dimension = str(tmp_path / "dim")
    city = "cityId string, cityName string"
    spark.createDataFrame([("a", "A")], city).write.parquet(dimension)
    look = retry_lookup.parquet_lookup(dimension, ["cityId"])
    schema = T.StructType([T.StructField("cityId", T.StringType()), T.StructField("cityName", T.StringType())])
    found = retry_lookup.retry_lookup_join(feed.stream(), look, ["id1"], schema, RetryPolicy(4, 6.0), "left")

    # Timers make a batch every time, so the stream never counts as having processed all.
    query = found.writeStream.format("memory").queryName("retried").outputMode("append").start()

    def wait(n):
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("retried").count() < n:
            time.sleep(0.3)

    try:
        feed.add([("a", "1"), ("b", "2"), ("c", "3")])
        wait(1)
        spark.createDataFrame([("b", "B")], city).write.mode("append").parquet(dimension)
        wait(3)
        got = [tuple(r) for r in spark.table("retried").collect()]
    finally:
        query.stop()
    assert sorted(got, key=repr) == [("a", "1", "a", "A"), ("b", "2", "b", "B"), ("c", "3", None, None)]


def test_first_attempts_are_one_join(spark, tmp_path):
    """What the join finds is never looked up by key, and several matches give several rows; a null key matches nothing."""
    feed = Feed(spark, tmp_path / "in", "id1 string, id2 string")
    dimension = spark.createDataFrame([("a", "A"), ("a", "AA"), (None, "N")], "cityId string, cityName string")
    schema = T.StructType([T.StructField("cityId", T.StringType()), T.StructField("cityName", T.StringType())])

    def look(key):
        if key[0] == "a":
            raise ValueError("looked up")
        return [{"cityId": key[0], "cityName": "B"}] if key[0] == "b" else []

    found = retry_lookup.retry_lookup_join(feed.stream(), look, ["id1"], schema, RetryPolicy(1, 1.0), "left", dimension, {"id1": "cityId"})
    query = found.writeStream.format("memory").queryName("joined_first").outputMode("append").start()
    try:
        feed.add([("a", "1"), ("b", "2"), ("c", "3"), (None, "4"), ("a", "5")])
        deadline = time.time() + 90
        while time.time() < deadline and query.isActive and spark.table("joined_first").count() < 7:
            time.sleep(0.3)
        got = [tuple(r) for r in spark.table("joined_first").collect()]
    finally:
        query.stop()
    assert sorted(got, key=repr) == sorted([("a", n, "a", v) for n in "15" for v in ("A", "AA")] + [("b", "2", "b", "B"), ("c", "3", None, None), (None, "4", None, None)], key=repr)


def test_stream_as_of(spark, tmp_path):
    left, right = Feed(spark, tmp_path / "l", "id string, code string, t timestamp"), Feed(spark, tmp_path / "r", "code string, rt timestamp, rate double, _op string")
    joined = as_of.stream_as_of_join(left.stream(), right.stream(), {"code": "code"}, "t", "rt", "left", op="_op", delay="2 seconds")

    def first():
        right.add([("USD", at(1), 0.8, "+I"), ("USD", at(4), 0.9, "+U"), ("GBP", at(2), 2.0, "+I"), ("USD", at(3), 1.0, "+U"), ("GBP", at(5), None, "-D")])
        left.add([("t1", "USD", at(1)), ("t2", "USD", at(2)), ("t3", "USD", at(3)), ("t4", "USD", at(4)), ("e", "USD", at(0)), ("g", "GBP", at(4)), ("h", "GBP", at(6))])

    def end():
        left.add([("z", "end", at(1000))])
        right.add([("end", at(1000), 1.0, "+I")])

    got = collect(joined.select("id", "rate"), "asof", [first, end, lambda: left.add([("z2", "end", at(2000))])])
    assert {r for r in got if not r[0].startswith("z")} == {("t1", 0.8), ("t2", 0.8), ("t3", 1.0), ("t4", 0.9), ("e", None), ("g", 2.0), ("h", None)}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_stream_as_of_condition(spark, tmp_path, how):
    """The condition is tested on the latest version alone: no earlier one takes its place, and left rows are padded."""
    left, right = Feed(spark, tmp_path / "l", "id string, code string, t timestamp"), Feed(spark, tmp_path / "r", "code string, rt timestamp, rate double")
    joined = as_of.stream_as_of_join(left.stream(), right.stream(), {"code": "code"}, "t", "rt", how, condition=F.col("rate") < 0.85)

    def first():
        right.add([("USD", at(1), 0.8), ("USD", at(3), 0.9), ("USD", at(5), None)])
        left.add([("a", "USD", at(0)), ("b", "USD", at(2)), ("c", "USD", at(4)), ("d", "USD", at(6))])

    def end():
        left.add([("z", "end", at(1000))])
        right.add([("end", at(1000), 0.1)])

    got = collect(joined.select("id", "right_code", "rate"), f"asof_condition_{how}", [first, end, lambda: left.add([("z2", "end", at(2000))])])
    padded = {("a", None, None), ("c", None, None), ("d", None, None)} if how == "left" else set()
    assert {r for r in got if not r[0].startswith("z")} == {("b", "USD", 0.8), *padded}


def test_punctuated(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "k string, t long, watermarkMarker boolean, watermarkTimestamp long")
    found = watermarks.punctuated(feed.stream(), ["k"], "t").select("t", "watermark", "late")
    got = collect(found, "marks", [lambda: feed.add([("k", 1, False, 99)]), lambda: feed.add([("k", 5, True, 7)]), lambda: feed.add([("k", 6, False, 0), ("k", 9, False, 0)])])
    assert sorted(got) == [(1, None, False), (5, 7, False), (6, 7, True), (9, 7, False)]


def test_lagging(spark):
    df = spark.sql("SELECT current_timestamp() - INTERVAL '10' SECOND AS ts UNION ALL SELECT current_timestamp() + INTERVAL '1' SECOND")
    assert watermarks.lagging(df, "ts").count() == 1 and watermarks.lagging(df, "ts", late=True).count() == 1


def test_flush_row_closes_the_last_window(spark, tmp_path):
    rows = spark.createDataFrame([(at(1), 1)], "ts timestamp, v int")
    feed = Feed(spark, tmp_path / "in", "ts timestamp, v int")
    found = windows.aggregate(feed.stream().withWatermark("ts", "1 second"), windows.tumble("ts", "5 seconds"), [], F.count("v").alias("n")).select("window_start", "n")
    end = [tuple(r) for r in watermarks.flush_row(rows, "ts").collect()]
    got = collect(found, "flushed", [lambda: feed.add([(at(1), 1)]), lambda: feed.add(end)])
    assert got == [(at(0), 1)]


def test_route(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "key string, data string")
    feed.add([("good", "g"), ("bad", "b"), ("atomic", "a"), ("good", "h")])
    to = {k: (F.col("key") == k, sinks.to_parquet(str(tmp_path / k))) for k in ("good", "atomic", "bad")}
    query = sinks.route(feed.stream(), to, ["data"]).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {k: sorted(r["data"] for r in spark.read.parquet(str(tmp_path / k)).collect()) for k in to} == {"good": ["g", "h"], "atomic": ["a"], "bad": ["b"]}


def test_upsert_and_changes(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "user_id string")
    counts = feed.stream().groupBy("user_id").agg(F.count("*").alias("c"))
    changes = []
    writer = sinks.emit_changes(counts, ["user_id"], str(tmp_path / "state"), lambda df, n: changes.append(sorted(tuple(r) for r in df.select("_op", "user_id", "c").collect())))
    query = writer.option("checkpointLocation", str(tmp_path / "cp")).start()
    keyed = sinks.upsert(counts, str(tmp_path / "table"), ["user_id"]).option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:
        for batch in ([("u1",), ("u2",)], [("u1",)]):
            feed.add(batch)
            query.processAllAvailable()
            keyed.processAllAvailable()
    finally:
        query.stop()
        keyed.stop()
    assert [c for c in changes if c] == [[("+I", "u1", 1), ("+I", "u2", 1)], [("+U", "u1", 2), ("-U", "u1", 1)]]
    assert sorted(tuple(r) for r in sinks.read_upsert(spark, str(tmp_path / "table"), ["user_id"]).collect()) == [("u1", 2), ("u2", 1)]


def test_changes_of_a_long_stream_are_compacted(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "k string")
    counts = feed.stream().groupBy("k").agg(F.count("*").alias("c"))
    state, changes = tmp_path / "state", []
    writer = sinks.emit_changes(counts, ["k"], str(state), lambda df, n: changes.extend(sorted(map(tuple, df.select("_op", "k", "c").collect()), key=lambda r: (r[0] != "-U", str(r)))), compact_every=2)
    for rows in ([("a",), (None,)], [("b",)], [(None,)], [("a",)], [("a",), ("b",)]):
        feed.add(rows)
        query = writer.option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    held = {}
    for op, k, c in changes:
        if op == "-U":
            assert held[k] == c
        else:
            assert (op == "+I") == (k not in held)
            held[k] = c
    assert held == {"a": 3, "b": 2, None: 2}
    assert len([p for p in state.iterdir() if p.name.startswith("base=")]) == 1
    assert len([p for p in state.iterdir() if p.name.startswith("batch=")]) <= 2


def test_a_batch_run_again_after_compaction_gives_the_same_changes(spark, tmp_path):
    state = str(tmp_path / "state")
    schema = "k string, c long, _op string, __version long"
    for n, rows in enumerate(([("a", 1)], [("a", 2), (None, 1)], [("a", 3)])):
        spark.createDataFrame([(*r, "+U", n) for r in rows], schema).write.parquet(f"{state}/batch={n}")
    typed = spark.createDataFrame([], schema).schema
    last = lambda: sorted(map(tuple, sinks._versions(spark, state, 2, typed).groupBy("k").agg(F.max("c")).collect()), key=str)
    before = last()
    for _ in range(2):
        sinks._compact(spark, state, 2, ["k"], typed)
        assert last() == before == [("a", 2), (None, 1)]


def test_generated_source(spark, tmp_path):
    source = sources.generated("pairs", T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())]), lambda a, b: [(f"{i}-{i}", str(i)) for i in range(a, b)], 3)
    sources.register(spark, source)
    query = spark.readStream.format("pairs").load().writeStream.format("memory").queryName("pairs").start()
    try:
        deadline = time.time() + 40
        while time.time() < deadline and spark.table("pairs").count() < 6:
            time.sleep(0.3)
        assert ("1-1", "1") in {tuple(r) for r in spark.table("pairs").collect()}
    finally:
        query.stop()
