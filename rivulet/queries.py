"""The engine's queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.strings import concat
from .functions.time import timestamp_text
from .operators import changelog, joins, relational, windows
from .plans.dialect import Engine
from .plans.lineage import lineage_frame, table_lineage
from .session import shared_folder
from .sources import sinks
from .sources.catalog import TableSpec
from .streaming import as_of, bundler, watermarks
from .streaming import sinks as stream_sinks

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scans, values, projections and filters


@query("SELECT * FROM nation")
def scan_table(spark, d):
    return table(spark, d, "nation")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv(spark, d):
    path = shared_folder(spark, "csv")
    engine = Engine(spark)
    columns = "n_nationkey INT, n_name VARCHAR, n_regionkey INT"
    table(spark, d, "nation").createOrReplaceTempView("csv_source")
    engine.execute(f"CREATE TEMPORARY TABLE csv_sink ({columns}) WITH ('connector' = 'filesystem', 'format' = 'csv', 'path' = '{path}', 'sink' = 'true')")
    engine.execute("INSERT INTO csv_sink SELECT n_nationkey, n_name, n_regionkey FROM csv_source")
    engine.execute(f"CREATE TEMPORARY TABLE csv_table ({columns}) WITH ('connector.type' = 'filesystem', 'format.type' = 'csv', 'connector.path' = '{path}')")
    return engine.execute("SELECT * FROM csv_table")


@query("SELECT * FROM (VALUES ('Los Angeles', 'CA', 2013, 13106100), ('Los Angeles', 'CA', 2014, 72600), ('Dallas', 'TX', 2013, 6817520)) AS t(city, state, update_year, population_diff)")
def values_insert(spark, d):
    engine, path = Engine(spark), shared_folder(spark, "values")
    engine.execute(f"CREATE TABLE population (city STRING, state STRING, update_year INT, population_diff INT) WITH ('connector' = 'filesystem', 'format' = 'csv', 'path' = '{path}', 'sink' = 'true')")
    engine.execute("INSERT INTO population VALUES ('Los Angeles', 'CA', 2013, 13106100), ('Los Angeles', 'CA', 2014, 72600), ('Dallas', 'TX', 2013, 6817520)")
    return engine.catalog.read("population")


@query("SELECT o_orderkey AS order_id, o_totalprice AS price FROM orders WHERE o_orderkey < 500")
def jdbc_roundtrip(spark, d):
    """Rows inserted into a table of a database and scanned again, with the filter pushed down. The database is the driver's own
    (in memory); executors in other processes scan a copy of it."""
    engine = Engine(spark)
    url = f"jdbc:derby:memory:rivulet{uuid.uuid4().hex};create=true"
    table(spark, d, "orders").createOrReplaceTempView("jdbc_source")
    columns = "order_id BIGINT, price DOUBLE"
    engine.execute(f"CREATE TABLE jdbc_sink ({columns}) WITH ('connector' = 'jdbc', 'url' = '{url}', 'table-name' = 't_order', 'sink' = 'true')")
    engine.execute("INSERT INTO jdbc_sink SELECT o_orderkey, o_totalprice FROM jdbc_source WHERE o_orderkey < 1000")
    engine.execute(f"CREATE TABLE jdbc_orders ({columns}) WITH ('connector' = 'jdbc', 'url' = '{url}', 'table-name' = 't_order')")
    return engine.execute("SELECT * FROM jdbc_orders WHERE order_id < 500")


@query("SELECT * FROM (VALUES ('a', 1), ('b', 2), (NULL, 3)) AS t(name, n)")
def from_elements(spark, d):
    engine = Engine(spark)
    engine.catalog.from_stream("elements", spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "x string, y int"), columns=["name", "n"])
    return engine.execute("SELECT name, n FROM elements")


@query("SELECT * FROM (VALUES ('id', 'bigint'), ('amount', 'double'), ('ts', 'timestamp_ntz'), ('late', 'timestamp_ntz')) AS t(col_name, data_type)")
def describe_table(spark, d):
    engine = Engine(spark)
    path = shared_folder(spark, "described")
    spark.createDataFrame([], "id bigint, amount double, ts timestamp_ntz").write.parquet(path)
    engine.execute(f"""CREATE TABLE described (id BIGINT, amount DOUBLE, ts TIMESTAMP(3), late AS ts + INTERVAL '1' DAY, WATERMARK FOR ts AS ts - INTERVAL '3' SECOND)
        WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{path}')""")
    return engine.execute("DESCRIBE described").select("col_name", "data_type")


@query("SELECT true AS scans, true AS aggregates, true AS shuffles")
def explain_plan(spark, d):
    table(spark, d, "events").createOrReplaceTempView("explained")
    text = Engine(spark).execute("EXPLAIN PLAN FOR SELECT event_type, COUNT(*) AS n FROM explained GROUP BY event_type")
    return spark.createDataFrame([("Scan parquet" in text, "HashAggregate" in text, "Exchange" in text)], "scans boolean, aggregates boolean, shuffles boolean")


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def options_hint(spark, d):
    """An OPTIONS hint sends the scan to another path than the declared one."""
    engine, root = Engine(spark), shared_folder(spark, "hint")
    columns = "event_id BIGINT, event_type STRING, value DOUBLE"
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    events.limit(0).write.parquet(f"{root}/a")
    events.write.parquet(f"{root}/b")
    engine.execute(f"CREATE TABLE hinted ({columns}) WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{root}/a')")
    return engine.execute(f"SELECT event_id, value FROM hinted /*+ OPTIONS('path'='{root}/b') */ WHERE event_type = 'click'")


@query("SELECT event_id, true AS processed_later FROM events WHERE event_type = 'purchase'")
def processing_time(spark, d):
    engine = Engine(spark)
    engine.catalog.from_stream("timed", table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "ts"), proctime="proc")
    return engine.execute("SELECT event_id, CAST(proc AS TIMESTAMP) > CAST(ts AS TIMESTAMP) AS processed_later FROM timed")


@query("SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS price FROM orders")
def project_alias(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"))


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def filter_eq(spark, d):
    table(spark, d, "events").withColumnRenamed("event_type", "key").createOrReplaceTempView("filter_source")
    return Engine(spark).execute("SELECT event_id, value FROM filter_source WHERE `key` = 'purchase'")


@query("SELECT c_custkey, c_name || c_mktsegment AS name_segment FROM customer")
def concat_cols(spark, d):
    return table(spark, d, "customer").select("c_custkey", concat(F.col("c_name"), F.col("c_mktsegment")).alias("name_segment"))


# Aggregates, distinct, top-N, union


@query("SELECT event_type, count(*) AS n, count(value) AS n_value FROM events GROUP BY event_type")
def group_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_value"))


@query("SELECT l_returnflag, l_linestatus, max(l_linenumber) AS latest, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def city_population(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.max("l_linenumber").alias("latest"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_keys(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def split_distinct(spark, d):
    return relational.split_distinct(table(spark, d, "events"), ["event_type"], "user_id", "users")


@query("SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(*) AS pv, count(DISTINCT user_id) AS uv FROM events GROUP BY 1")
def hourly_pv_uv(spark, d):
    hour = F.date_format("ts", "yyyy-MM-dd HH:00").alias("hour")
    return table(spark, d, "events").groupBy(hour).agg(F.count("*").alias("pv"), F.count_distinct("user_id").alias("uv"))


@query("""
SELECT c_nationkey, c_custkey, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC) AS r FROM customer) WHERE r <= 2
""")
def topn_per_group(spark, d):
    customers = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return relational.top_n(customers, ["c_nationkey"], [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey").desc()], 2)


@query("""
SELECT s.c_mktsegment, t.c_custkey, t.c_acctbal FROM (SELECT DISTINCT c_mktsegment FROM customer) s,
LATERAL (SELECT c_custkey, c_acctbal FROM customer c WHERE c.c_mktsegment = s.c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 2) t
""")
def topn_lateral(spark, d):
    customers = table(spark, d, "customer")
    customers.createOrReplaceTempView("topn_customers")
    customers.select("c_mktsegment").distinct().createOrReplaceTempView("topn_segments")
    correlated = "topn_customers.c_mktsegment = topn_segments.c_mktsegment"
    return joins.lateral_top_n(spark, "topn_segments", "topn_customers", correlated, ["c_custkey", "c_acctbal"], "c_acctbal DESC, c_custkey DESC", 2)


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def union_all(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return relational.union_all(customers, suppliers, suppliers)


# Windows


TUMBLE_SQL = """
SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') || '.000' AS window_start,
       count(*) AS order_num, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS total_amount, count(DISTINCT event_type) AS unique_products
FROM events GROUP BY time_bucket(INTERVAL '5 minutes', ts)
"""


@query(TUMBLE_SQL)
def tumble_agg(spark, d):
    """The flagship: a tumbling window with COUNT, SUM and COUNT DISTINCT."""
    amount = F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total_amount")
    found = windows.aggregate(table(spark, d, "events"), windows.tumble("ts", "5 minutes"), [], F.count("*").alias("order_num"), amount, F.count_distinct("event_type").alias("unique_products"))
    return found.select(timestamp_text(F.col(windows.START)).alias("window_start"), "order_num", "total_amount", "unique_products")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS window_end, event_type, count(*) AS c FROM events GROUP BY 1, 2")
def tumble_item_count(spark, d):
    table(spark, d, "events").createOrReplaceTempView("user_log")
    return Engine(spark).execute("SELECT TUMBLE_END(ts, INTERVAL '5' MINUTE) AS window_end, event_type, COUNT(event_id) AS c FROM user_log GROUP BY TUMBLE(ts, INTERVAL '5' MINUTE), event_type")


@query("""
SELECT s AS window_start, s + INTERVAL '5 minutes' AS window_end, event_type, count(*) AS c FROM (
  SELECT event_type, unnest(range(time_bucket(INTERVAL '1 minute', ts) - INTERVAL '4 minutes', time_bucket(INTERVAL '1 minute', ts) + INTERVAL '1 minute', INTERVAL '1 minute')) AS s FROM events)
GROUP BY 1, 2, 3
""")
def hop_item_count(spark, d):
    found = windows.aggregate(table(spark, d, "events"), windows.hop("ts", "1 minute", "5 minutes"), ["event_type"], F.count("*").alias("c"))
    return found.drop(windows.TIME)


@query("""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, max(ts) + INTERVAL '6 hours' - INTERVAL '1 millisecond' AS session_rowtime, count(*) AS c FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, s
""")
def session_agg(spark, d):
    found = windows.aggregate(table(spark, d, "events"), windows.session("ts", "6 hours"), ["user_id"], F.count("*").alias("c"))
    return found.select("user_id", F.col(windows.START).alias("session_start"), F.col(windows.END).alias("session_end"), F.col(windows.TIME).alias("session_rowtime"), "c")


@query("""
SELECT event_id, ts, user_id, event_type, value, props, time_bucket(INTERVAL '10 minutes', ts) AS window_start, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end,
       time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' - INTERVAL '1 millisecond' AS window_time FROM events
""")
def tumble_tvf(spark, d):
    table(spark, d, "events").createOrReplaceTempView("tvf_events")
    return Engine(spark).execute("SELECT * FROM TABLE(TUMBLE(DATA => TABLE tvf_events, TIMECOL => DESCRIPTOR(ts), SIZE => INTERVAL '10' MINUTES))")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS window_end, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def tumble_tvf_sum(spark, d):
    placed = windows.table_function(table(spark, d, "events"), windows.tumble("ts", "10 minutes"))
    return placed.groupBy(windows.START, windows.END).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, e AS window_end, count(*) AS c FROM (
  SELECT ts, unnest(range(time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes', time_bucket(INTERVAL '1 hour', ts) + INTERVAL '61 minutes', INTERVAL '10 minutes')) AS e FROM events)
GROUP BY 1, 2
""")
def cumulate_count(spark, d):
    return windows.cumulate(table(spark, d, "events"), "ts", "10 minutes", "1 hour").groupBy(windows.START, windows.END).agg(F.count("*").alias("c"))


@query(SQL["cumulate_count"])
def cumulate_sql(spark, d):
    table(spark, d, "events").createOrReplaceTempView("cumulated")
    call = "TABLE(CUMULATE(TABLE cumulated, DESCRIPTOR(ts), INTERVAL '10' MINUTES, INTERVAL '1' HOURS))"
    return Engine(spark).execute(f"SELECT window_start, window_end, COUNT(*) AS c FROM {call} GROUP BY window_start, window_end")


# Joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("o_orderkey", "c_name", "o_totalprice")


LOOKUP_SQL = "SELECT event_id, user_id, c_name, c_mktsegment FROM events {} JOIN customer ON user_id = c_custkey"


def _lookup(spark, d, how, strategy):
    events = table(spark, d, "events").select("event_id", "user_id")
    dimension = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return joins.lookup_join(events, dimension, {"user_id": "c_custkey"}, how, strategy).drop("c_custkey")


@query(LOOKUP_SQL.format("INNER"))
def lookup_join_inner(spark, d):
    return _lookup(spark, d, "inner", "auto")


@query(LOOKUP_SQL.format("LEFT"))
def lookup_join_left(spark, d):
    return _lookup(spark, d, "left", "auto")


@query(LOOKUP_SQL.format("LEFT"))
def keyby_lookup(spark, d):
    return _lookup(spark, d, "left", "keyby")


@query(LOOKUP_SQL.format("LEFT"))
def broadcast_lookup(spark, d):
    return _lookup(spark, d, "left", "broadcast")


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id AS r_user, event_id AS r_event, ts AS r_ts FROM events WHERE event_type = 'signup'),
m AS (SELECT l.event_id, r_event, greatest(0, CAST(ceil(epoch_us(r_ts - ts) / 3600000000.0) AS INT)) AS attempt FROM l JOIN r ON user_id = r_user),
f AS (SELECT *, min(attempt) OVER (PARTITION BY event_id) AS first FROM m WHERE attempt <= 3)
SELECT l.event_id, f.r_event, f.attempt FROM l LEFT JOIN (SELECT * FROM f WHERE attempt = first) f ON l.event_id = f.event_id
""")
def delayed_lookup(spark, d):
    events = table(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'signup'").select(F.col("user_id").alias("r_user"), F.col("event_id").alias("r_event"), F.col("ts").alias("r_ts"))
    found = joins.retried_lookup(left, right, {"user_id": "r_user"}, "ts", "r_ts", joins.RetryPolicy(3, 3600.0), "left")
    return found.select("event_id", "r_event", "attempt")


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
m AS (SELECT l.event_id, r.event_id AS right_event_id, greatest(0, CAST(ceil(epoch_us(r.ts - l.ts) / 3600000000.0) AS INT)) AS attempt FROM l JOIN r ON l.user_id = r.user_id),
f AS (SELECT *, min(attempt) OVER (PARTITION BY event_id) AS first FROM m WHERE attempt <= 2)
SELECT event_id, right_event_id, attempt FROM f WHERE attempt = first
""")
def delayed_lookup_inner(spark, d):
    """Both sides have the same column names."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    left, right = (events.where(f"event_type = '{kind}'").drop("event_type") for kind in ("purchase", "signup"))
    return joins.retried_lookup(left, right, {"user_id": "user_id"}, "ts", "ts", joins.RetryPolicy(2, 3600.0), "inner").select("event_id", "right_event_id", "attempt")


AS_OF_SQL = """
SELECT p.event_id, p.ts, c.event_id AS click_id, c.value AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF {} JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts
"""


def _as_of(spark, d, how, bucket=None):
    events = table(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    right = events.where("event_type = 'click'").select(F.col("user_id").alias("click_user"), F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return joins.as_of_join(left, right, {"user_id": "click_user"}, "ts", "click_ts", how, order=["click_id"], bucket=bucket).select("event_id", "ts", "click_id", "click_value")


@query(AS_OF_SQL.format(""))
def asof_inner(spark, d):
    return _as_of(spark, d, "inner")


@query(AS_OF_SQL.format("LEFT"))
def asof_left(spark, d):
    return _as_of(spark, d, "left")


@query(AS_OF_SQL.format("LEFT"))
def asof_sliced(spark, d):
    """As asof_left, a user's events split by day: for users with much of the rows."""
    return _as_of(spark, d, "left", 86_400.0)


@query("""
SELECT p.event_id AS id, p.ts AS trx_time, round(p.value * c.value, 6) AS total
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type <> 'purchase') c ON p.user_id = c.user_id AND p.ts >= c.ts
WHERE c.event_type <> 'signup' ORDER BY p.ts
""")
def temporal_join(spark, d):
    """Rates are an upsert changelog in which a sign-up deletes the user's rate."""
    engine = Engine(spark)
    events = table(spark, d, "events")
    rates = events.where("event_type <> 'purchase'").select(F.when(F.col("event_type") == "signup", "-D").otherwise("+U").alias("_op"), F.col("ts").alias("rate_time"), F.col("user_id").alias("code"), F.col("value").alias("rate"))
    engine.catalog.from_stream("rates", rates, watermark=("rate_time", "2 seconds"), primary_key=("code",))
    payments = events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("ts").alias("trx_time"), F.col("user_id").alias("code"), F.col("value").alias("amount"))
    engine.catalog.from_stream("payments", payments, watermark=("trx_time", "2 seconds"))
    return engine.execute("""
        SELECT t.id, t.trx_time, round(t.amount * r.rate, 6) AS total
        FROM payments AS t JOIN rates FOR SYSTEM_TIME AS OF t.trx_time AS r ON t.code = r.code ORDER BY t.trx_time""")


@query("""
SELECT p.event_id AS id, CASE WHEN c.value < p.value THEN c.event_id END AS click_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts
""")
def temporal_join_left_condition(spark, d):
    """A residual condition is tested on the version that is chosen; what fails is padded with nulls."""
    engine = Engine(spark)
    events = table(spark, d, "events")
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "ts", F.col("user_id").alias("code"), F.col("value").alias("rate"))
    engine.catalog.from_stream("clicks", clicks, watermark=("ts", "2 seconds"), primary_key=("code",))
    engine.catalog.from_stream("buys", events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("code"), "value"), watermark=("ts", "2 seconds"))
    return engine.execute("SELECT b.id, c.click_id FROM buys AS b LEFT JOIN clicks FOR SYSTEM_TIME AS OF b.ts AS c ON b.code = c.code AND c.rate < b.value")


# Changelogs


CDC_SQL = """
WITH log AS (
  SELECT '+I' AS op, user_id FROM events UNION ALL SELECT '-U', user_id FROM events WHERE event_id % 7 = 0
  UNION ALL SELECT '+U', user_id + 1 FROM events WHERE event_id % 7 = 0 UNION ALL SELECT '-D', user_id FROM events WHERE event_id % 7 <> 0 AND event_id % 3 = 0)
SELECT user_id, CAST(sum(CASE WHEN op IN ('+I', '+U') THEN 1 ELSE -1 END) AS BIGINT) AS c FROM log GROUP BY user_id HAVING sum(CASE WHEN op IN ('+I', '+U') THEN 1 ELSE -1 END) > 0
"""


def _log(events: DataFrame) -> DataFrame:
    moved, gone = F.col("event_id") % 7 == 0, (F.col("event_id") % 7 != 0) & (F.col("event_id") % 3 == 0)
    kinds = F.when(moved, F.array(F.lit("+I"), F.lit("-U"), F.lit("+U"))).when(gone, F.array(F.lit("+I"), F.lit("-D"))).otherwise(F.array(F.lit("+I")))
    rows = events.select("event_id", "user_id", F.explode(kinds).alias("_op"))
    return rows.withColumn("user_id", F.when(F.col("_op") == "+U", F.col("user_id") + 1).otherwise(F.col("user_id")))


@query(CDC_SQL)
def cdc_count(spark, d):
    return changelog.count(_log(table(spark, d, "events")), ["user_id"])


@query("""
SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'signup'
""")
def changelog_materialize(spark, d):
    """An upsert changelog in which a sign-up deletes the user, with retractions made and then folded."""
    events = table(spark, d, "events")
    log = events.select(F.when(F.col("event_type") == "signup", "-D").otherwise("+U").alias("_op"), "user_id", "event_type", "value", "ts", "event_id")
    return changelog.materialize(changelog.retract(log, ["user_id"], ["ts", "event_id"]), ["ts", "event_id", "__step"])


@query("""
SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'signup'
""")
def upsert_latest(spark, d):
    log = table(spark, d, "events").select(F.when(F.col("event_type") == "signup", "-D").otherwise("+U").alias("_op"), "user_id", "event_type", "value", "ts", "event_id")
    return changelog.latest(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("""
WITH running AS (SELECT user_id, event_id, row_number() OVER w AS n, max(event_id) OVER w AS latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT '+I' AS _op, user_id, n, latest FROM running
UNION ALL SELECT '-D', user_id, n, latest FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM running) WHERE next IS NOT NULL
""")
def updating_aggregate(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id")
    found = changelog.updating(events, ["user_id"], ["event_id"], {"n": F.count("*"), "latest": F.max("event_id")})
    return found.select("_op", "user_id", "n", "latest")


@query("SELECT user_id, max(v) AS top FROM (SELECT user_id, CAST(value * 100 AS BIGINT) AS v FROM events WHERE event_id % 3 <> 0) GROUP BY user_id")
def cdc_max(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    kinds = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("+I"), F.lit("-D"))).otherwise(F.array(F.lit("+I")))
    return changelog.maximum(events.withColumn("_op", F.explode(kinds)), ["user_id"], "v", "top")


@query("""
SELECT size, count(*) AS bundles FROM (
  SELECT user_id, (r - 1) // 10 AS b, count(*) AS size FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY 1, 2)
GROUP BY size
""")
def mini_batch_bundles(spark, d):
    bundled = bundler.bundles(table(spark, d, "events").select("user_id", "event_id"), 10, ["event_id"], keys=["user_id"])
    return bundler.bundle_sizes(bundled).withColumn("size", F.col("size").cast("bigint"))


@query(CDC_SQL)
def cdc_upsert(spark, d):
    """A table declared over a change log, counted by key into an upsert sink, in two inserts of which the later one holds."""
    engine, root = Engine(spark), shared_folder(spark, "cdc")
    log = _log(table(spark, d, "events"))
    log.select("_op", "user_id", "event_id").write.json(f"{root}/log")
    engine.execute(f"CREATE TABLE user_log (user_id BIGINT, event_id BIGINT, PRIMARY KEY (event_id) NOT ENFORCED) WITH ('connector' = 'mysql-cdc', 'format' = 'json', 'path' = '{root}/log')")
    engine.execute(f"CREATE TABLE user_counts (user_id BIGINT, c BIGINT, PRIMARY KEY (user_id) NOT ENFORCED) WITH ('connector' = 'upsert', 'path' = '{root}/counts')")
    read = engine.catalog.read("user_log")
    final = changelog.count(read, ["user_id"])
    # Each user's count before its last row, then the counts; -D where no row is left.
    rows = read.select("user_id").distinct().withColumn("c", F.lit(-1).cast("bigint")).select(F.lit("+I").alias("_op"), F.lit(0).alias("_seq"), "user_id", "c")
    gone = read.select("user_id").distinct().join(final.select("user_id"), "user_id", "left_anti").select(F.lit("-D").alias("_op"), F.lit(1).alias("_seq"), "user_id", F.lit(0).cast("bigint").alias("c"))
    engine.catalog.insert("user_counts", rows.unionByName(final.select(F.lit("+U").alias("_op"), F.lit(1).alias("_seq"), "user_id", "c")).unionByName(gone))
    return sinks.read_upsert(spark, engine.catalog.get("user_counts"))


@query("""
SELECT mode, count(*) AS n FROM (
  SELECT unnest(CASE WHEN event_type = 'signup' THEN ['RETRACT', 'UPSERT'] WHEN event_type = 'view' THEN ['RETRACT'] WHEN event_type = 'click' THEN ['RETRACT', 'UPSERT'] ELSE ['RETRACT', 'UPSERT', 'APPEND'] END) AS mode FROM events)
GROUP BY mode
""")
def sink_modes(spark, d):
    """How many rows of a changelog each sink mode takes: retract all, upsert all but -U, append inserts only."""
    kinds = {"signup": "-D", "view": "-U", "click": "+U"}
    events = table(spark, d, "events")
    op = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in kinds.items()], F.lit("+I"))
    log = events.select(op.alias("_op"), "event_id")
    taken = [changelog.for_sink(log, m) for m in ("RETRACT", "UPSERT")] + [changelog.for_sink(log.where("_op = '+I'"), "APPEND")]
    return relational.union_all(*[t.groupBy().agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "n") for t, m in zip(taken, ("RETRACT", "UPSERT", "APPEND"))])


@query("SELECT 'good' AS sink, event_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'atomic', event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'bad', event_id FROM events WHERE event_type = 'view'")
def multi_sink(spark, d):
    """One insert a sink; what each holds is read back."""
    engine, root = Engine(spark), shared_folder(spark, "sinks")
    table(spark, d, "events").createOrReplaceTempView("source_stream")
    out = []
    for sink, kind in (("good", "purchase"), ("atomic", "click"), ("bad", "view")):
        engine.catalog.create(TableSpec(f"{sink}_sink", {"event_id": "BIGINT"}, {"connector": "filesystem", "format": "parquet", "path": f"{root}/{sink}", "sink": "true"}))
        engine.execute(f"INSERT INTO {sink}_sink SELECT event_id FROM source_stream WHERE event_type = '{kind}'")
        out.append(engine.catalog.read(f"{sink}_sink").select(F.lit(sink).alias("sink"), "event_id"))
    return relational.union_all(*out)


@query("""
SELECT * FROM (VALUES ('mysql_sink', 'a1', 'concat_a', 'source1', 'c_name'), ('mysql_sink', 'a1', 'concat_a', 'source2', 's_name'), ('mysql_sink', 'a', 'aa', 'source1', 'c_name'),
  ('mysql_sink', 'b', 'b', 'source2', 's_nationkey'), ('mysql_sink', 'c', 'c', 'source2', 's_suppkey')) AS t(sink_table, sink_column, query_column, source_table, source_column)
""")
def column_lineage(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("source1")
    table(spark, d, "supplier").createOrReplaceTempView("source2")
    joined = spark.sql("SELECT CONCAT(x.c_name, y.s_name) AS concat_a, x.c_name AS aa, y.s_nationkey AS b, y.s_suppkey AS c FROM source1 x JOIN source2 y ON x.c_custkey = y.s_suppkey")
    return lineage_frame(joined, "mysql_sink", ["a1", "a", "b", "c"])


@query("SELECT * FROM (VALUES ('sink', 'lineage_sink', 0), ('Join', NULL, 1), ('table', 'lineage_orders', 2), ('table', 'lineage_customers', 2)) AS t(kind, name, depth)")
def table_lineage_tree(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("lineage_orders")
    table(spark, d, "customer").createOrReplaceTempView("lineage_customers")
    df = spark.sql("SELECT c_name, o_totalprice FROM lineage_orders JOIN lineage_customers ON o_custkey = c_custkey WHERE o_totalprice > 5")
    rows = []

    def walk(node, depth):
        rows.append((node.kind, node.name, depth))
        for i in node.inputs:
            walk(i, depth + 1)

    walk(table_lineage(df, "lineage_sink"), 0)
    return spark.createDataFrame(rows, "kind string, name string, depth int")


# Streams, run to the end of their input. What they return is read from what they have written.


def _feed(spark, name: str, batches: list[DataFrame]) -> tuple[str, DataFrame]:
    """A folder with the batches as files, and a stream that takes them one by one."""
    path = f"{shared_folder(spark, name)}/in"
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    return path, spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(writer, name: str, spark) -> None:
    writer.option("checkpointLocation", shared_folder(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """What an append-mode stream has emitted at the end of its input."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark, name)}/out"
    _run(stream.writeStream.format("parquet").option("path", path).outputMode("append"), name, spark)
    return spark.read.schema(stream.schema).parquet(path)


def _by_time(events: DataFrame, parts: int = 3) -> list[DataFrame]:
    """The rows in ascending slices of time, each with rows of a time not before the slices before it, and the flush row. Rows
    without a time are in the first."""
    first, last = events.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp")) + 1).first()
    first, last = (0, 1) if first is None else (first, last)
    at = F.coalesce(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(first)) * parts / F.lit(last - first)), F.lit(0))
    return [*[events.where(at == i) for i in range(parts)], watermarks.flush_row(events, "ts")]


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS c FROM events GROUP BY 1, 2")
def stream_tumble(spark, d):
    """A table with a DDL watermark, streamed file by file; the flush row closes the last window."""
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    path, _ = _feed(spark, "tumble", _by_time(events))
    engine = Engine(spark, streaming=True)
    engine.execute(f"""CREATE TABLE streamed (event_id BIGINT, event_type STRING, ts TIMESTAMP(6), WATERMARK FOR ts AS ts - INTERVAL '3' SECOND)
        WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{path}', 'maxFilesPerTrigger' = '1')""")
    found = engine.execute("SELECT TUMBLE_START(ts, INTERVAL '1' HOUR) AS window_start, event_type, COUNT(event_id) AS c FROM streamed GROUP BY TUMBLE(ts, INTERVAL '1' HOUR), event_type")
    return _drained(found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "tumble")


@query("SELECT count(*) AS counted FROM events WHERE event_id % 10 <> 0")
def stream_late_rows(spark, d):
    """Rows behind the watermark (bounded disorder) are dropped: a tenth of the rows comes after all others."""
    events = table(spark, d, "events").select("event_id", "ts")
    last = events.where("event_id % 10 <> 0").agg(F.max("ts").alias("last"))
    late = events.where("event_id % 10 = 0").join(F.broadcast(last), F.col("ts") < F.col("last") - F.expr("INTERVAL 2 HOURS")).select("event_id", "ts")
    # A batch's watermark bars rows from the batch after the next on.
    batches = [events.where("event_id % 10 <> 0"), watermarks.flush_row(events, "ts", "1 second"), late, watermarks.flush_row(events, "ts")]
    _, stream = _feed(spark, "late", batches)
    counted = windows.aggregate(watermarks.bounded(stream, "ts", 3500), windows.tumble("ts", "1 minute"), [], F.count("event_id").alias("c"))
    return _drained(counted, "late").agg(F.sum("c").alias("counted"))


MARKS_SQL = """
WITH rows AS (SELECT k, b, b * 10 + k % 7 AS t, (k + b) % 3 = 0 AS m, b * 10 + k % 5 AS w FROM range(50) AS a(k), range(4) AS c(b)),
marked AS (SELECT *, max(CASE WHEN m THEN w END) OVER (PARTITION BY k ORDER BY b) AS watermark, max(CASE WHEN m THEN w END) OVER (PARTITION BY k ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rows)
SELECT k, t, watermark, coalesce(t <= before, false) AS late FROM marked
"""


@query(MARKS_SQL)
def stream_punctuated(spark, d):
    """Watermarks that events carry, by key: a file for each step, a row of each key in it."""
    batch = lambda b: spark.range(50).selectExpr("id AS k", f"{b} * 10L + id % 7 AS t", f"(id + {b}) % 3 = 0 AS watermarkMarker", f"{b} * 10L + id % 5 AS watermarkTimestamp")
    _, stream = _feed(spark, "marks", [batch(b) for b in range(4)])
    return _drained(watermarks.punctuated(stream, ["k"], "t").select("k", "t", "watermark", "late"), "marks")


@query("SELECT event_id, true AS late FROM events")
def lagging_rows(spark, d):
    """A watermark that lags the clock: all rows of the past are late."""
    events = table(spark, d, "events").select("event_id", "ts")
    return relational.union_all(watermarks.lagging(events, "ts", late=True).select("event_id", F.lit(True).alias("late")), watermarks.lagging(events, "ts").select("event_id", F.lit(False)))


@query("""
SELECT p.event_id, c.event_id AS click_id, c.value AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts
""")
def stream_as_of_left(spark, d):
    """Two streams, keyed state, and a watermark that is the lesser of both sides'."""
    events = table(spark, d, "events").where("event_type IN ('purchase', 'click')").select("event_id", "ts", "user_id", "value", "event_type")
    slices = _by_time(events, 2)  # Both sides' flush rows, which have no event_type, are after both sides' rows.
    sides = [_feed(spark, kind, [b.where(f"event_type = '{kind}' OR event_type IS NULL") for b in slices])[1] for kind in ("purchase", "click")]
    joined = as_of.stream_as_of_join(sides[0].drop("value"), sides[1].drop("event_type"), {"user_id": "user_id"}, "ts", "ts", "left", delay="2 seconds")
    return _drained(joined.where("event_type IS NOT NULL").select("event_id", F.col("right_event_id").alias("click_id"), F.col("value").alias("click_value")), "asof")


@query("""
WITH batches AS (SELECT user_id, event_id % 3 AS b, count(*) AS n FROM events GROUP BY 1, 2),
running AS (SELECT user_id, b, CAST(sum(n) OVER w AS BIGINT) AS c, CAST(sum(n) OVER w AS BIGINT) - n AS was FROM batches WINDOW w AS (PARTITION BY user_id ORDER BY b))
SELECT CASE WHEN was = 0 THEN '+I' ELSE '+U' END AS _op, user_id, c FROM running UNION ALL SELECT '-U', user_id, was FROM running WHERE was > 0
""")
def stream_changes(spark, d):
    """The changelog of a count that is updated batch by batch."""
    events = table(spark, d, "events").select("user_id", "event_id")
    _, stream = _feed(spark, "changes", [events.where(F.col("event_id") % 3 == b) for b in range(3)])
    root = shared_folder(spark, "changes")
    counts = stream.groupBy("user_id").agg(F.count("*").alias("c"))
    _run(stream_sinks.emit_changes(counts, ["user_id"], f"{root}/state", stream_sinks.to_parquet(f"{root}/out")), "changes", spark)
    return spark.read.parquet(f"{root}/out").select("_op", "user_id", "c")


@query("SELECT user_id, count(*) AS c FROM events GROUP BY user_id")
def stream_upsert(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id")
    _, stream = _feed(spark, "upsert", [events.where(F.col("event_id") % 3 == b) for b in range(3)])
    root = shared_folder(spark, "upserted")
    _run(stream_sinks.upsert(stream.groupBy("user_id").agg(F.count("*").alias("c")), f"{root}/out", ["user_id"]), "upsert", spark)
    return stream_sinks.read_upsert(spark, f"{root}/out", ["user_id"]).select("user_id", "c")


@query(SQL["multi_sink"])
def stream_route(spark, d):
    """As multi_sink, the source read once."""
    _, stream = _feed(spark, "routed", [table(spark, d, "events").select("event_id", "event_type")])
    root = shared_folder(spark, "routes")
    kinds = {"good": "purchase", "atomic": "click", "bad": "view"}
    _run(stream_sinks.route(stream, {s: (F.col("event_type") == k, stream_sinks.to_parquet(f"{root}/{s}")) for s, k in kinds.items()}, ["event_id"]), "routed", spark)
    return relational.union_all(*[spark.read.parquet(f"{root}/{s}").select(F.lit(s).alias("sink"), "event_id") for s in kinds])
