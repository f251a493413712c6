"""Catalog, connectors, dialect and lineage."""

import logging

import pytest
from pyspark.sql import functions as F

from rivulet.plans import lineage, rules
from rivulet.plans.dialect import DialectError, Engine, parse_table
from rivulet.sources import connectors, sinks
from rivulet.sources.catalog import Catalog, TableSpec


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def engine(spark):
    one = spark.createDataFrame([("test1", 1, 10)], "a string, b int, c int")
    two = spark.createDataFrame([("test1", 1, 10), ("test2", 2, 20)], "a string, b int, c int")
    one.createOrReplaceTempView("source1")
    two.createOrReplaceTempView("source2")
    return Engine(spark)


JOIN = "SELECT CONCAT(source1.a, source2.a) AS concat_a, source1.a AS aa, source2.b AS b, source2.c AS c FROM source1 INNER JOIN source2 ON source1.a = source2.a"


def test_union_and_join(engine):
    assert tuples(engine.execute("SELECT * FROM source1 UNION ALL SELECT * FROM source2")) == [("test1", 1, 10), ("test1", 1, 10), ("test2", 2, 20)]
    assert tuples(engine.execute(JOIN)) == [("test1test1", "test1", 1, 10)]


def test_ddl():
    spec = parse_table("""
        CREATE TEMPORARY TABLE t_order (order_id VARCHAR, price DECIMAL(10, 2), create_time TIMESTAMP(0), ts TIMESTAMP_LTZ(3) NOT NULL,
          proc_time AS proctime(), WATERMARK FOR create_time AS create_time - INTERVAL '10' SECONDS, PRIMARY KEY (order_id) NOT ENFORCED)
        WITH ('connector' = 'jdbc', 'url' = 'jdbc:x', 'table-name' = 't', 'password' = 'p')""")
    assert spec.schema.simpleString() == "struct<order_id:string,price:decimal(10,2),create_time:timestamp_ntz,ts:timestamp>"
    assert (spec.primary_key, spec.watermark, spec.processing_times, spec.temporary) == (("order_id",), ("create_time", "10 seconds"), {"proc_time"}, True)
    assert spec.precisions() == {"create_time": 0, "ts": 3}
    assert lineage.redacted(spec.options)["password"] == "***"
    for bad in ("CREATE TABLE t (a INT)", "CREATE TABLE t (a INT, WATERMARK FOR a AS b - INTERVAL '1' SECOND) WITH ('connector'='x')"):
        with pytest.raises(DialectError):
            parse_table(bad)


def test_csv_sink_and_legacy_source(engine, tmp_path):
    engine.execute(f"CREATE TABLE csv_sink (a STRING, n BIGINT) WITH ('connector'='filesystem','path'='{tmp_path}/x','format'='csv')")
    engine.execute("INSERT INTO csv_sink SELECT a, b FROM source2")
    engine.execute(f"CREATE TABLE csv_source (a STRING, n BIGINT) WITH ('connector.type'='filesystem','connector.path'='{tmp_path}/x','format.type'='csv')")
    assert tuples(engine.execute("SELECT * FROM csv_source")) == [("test1", 1), ("test2", 2)]
    assert tuples(engine.execute(f"SELECT csv_source.a FROM csv_source /*+ OPTIONS('path'='{tmp_path}/x') */ WHERE csv_source.n = 2")) == [("test2",)]
    assert [r["col_name"] for r in engine.execute("DESCRIBE csv_source").collect()] == ["a", "n"]
    assert "Physical Plan" in engine.execute("EXPLAIN SELECT a FROM csv_source")


def test_values_insert_and_upsert(engine, spark, tmp_path):
    engine.execute(f"CREATE TABLE counts (user_id STRING, c BIGINT, PRIMARY KEY (user_id) NOT ENFORCED) WITH ('connector'='upsert','path'='{tmp_path}/u')")
    engine.execute("INSERT INTO counts VALUES ('u1', 1), ('u2', 2)")
    engine.execute("INSERT INTO counts SELECT '-D' AS _op, 'u1' AS user_id, 1 AS c")
    spec = engine.catalog.get("counts")
    assert tuples(sinks.read_upsert(spark, spec)) == [("u2", 2)]
    sent = sinks.messages(spark.sql("SELECT '-D' AS _op, 'u1' AS user_id, 1L AS c UNION ALL SELECT '+I', 'u2', 2L"), spec)
    assert sorted(((r["key"], r["value"]) for r in sent.collect()), key=repr) == [('{"user_id":"u1"}', None), ('{"user_id":"u2"}', '{"user_id":"u2","c":2}')]


def test_jdbc(engine, spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.sql("SELECT 'o1' AS ORDER_ID, 'n' AS NAME, 5 AS PRICE UNION ALL SELECT 'o2', 'm', 7").write.format("jdbc").options(url=url, dbtable="t_order").save()
    engine.execute(f"CREATE TABLE t_order (order_id STRING, price INT) WITH ('connector'='jdbc','url'='{url}','table-name'='t_order')")
    found = engine.execute("SELECT order_id FROM t_order WHERE price > 6")
    assert tuples(found) == [("o2",)]
    assert "PushedFilters" in rules.explain(found) or "PushedPredicates" in rules.explain(found)


def test_unknown_connectors_and_sinks(engine):
    with pytest.raises(ValueError, match="unknown connector"):
        engine.execute("CREATE TABLE x (a INT) WITH ('connector'='nope')")
    with pytest.raises(ValueError, match="isn't declared"):
        engine.execute("INSERT INTO nowhere SELECT 1")
    with pytest.raises(Exception, match="kafka"):
        Catalog(engine.spark).create(TableSpec("k", {"a": "INT"}, {"connector": "kafka", "topic": "t", "properties.bootstrap.servers": "h:1"}))


def test_json_values(spark):
    spec = TableSpec("user_log", {"user_id": "STRING", "ts": "TIMESTAMP(3)"}, {"connector": "kafka", "format": "json"})
    raw = spark.sql("""SELECT cast('{"user_id":"u","ts":"2020-01-01 00:00:01"}' AS binary) AS value""")
    assert connectors.parsed(raw, spec).first()["user_id"] == "u"


def test_key_value_dimension(engine, spark):
    connectors.STORES["city"] = spark.createDataFrame([("cities", "1", "x"), ("other", "2", "y")], "key string, field string, value string")
    engine.execute("CREATE TABLE city (cityId STRING, cityName STRING) WITH ('connector'='redis','command'='HGET','additional-key'='cities')")
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id1 string, id2 string")
    engine.catalog.from_stream("T", rows, proctime="proc")
    found = engine.execute("SELECT T.id1, T.id2, city.cityId FROM T LEFT JOIN city FOR SYSTEM_TIME AS OF T.proc ON T.id1 = city.cityId")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == [("1", "a", "1"), ("2", "b", None)]


def test_as_of_needs_time_attributes(engine, spark):
    engine.catalog.from_stream("L", spark.createDataFrame([("k", 1)], "k string, n int"))
    for sql in ("SELECT * FROM L JOIN source1 FOR SYSTEM_TIME AS OF L.n ON L.k = source1.a", "SELECT * FROM L JOIN source1 FOR SYSTEM_TIME AS OF source1.a ON L.k = source1.a"):
        with pytest.raises(DialectError):
            engine.execute(sql)


def test_windows_in_sql(engine, spark):
    spark.sql("SELECT 'u' AS user_id, timestamp_ntz'2020-01-01 00:00:10' AS ts UNION ALL SELECT 'u', timestamp_ntz'2020-01-01 00:00:50'").createOrReplaceTempView("user_log")
    hop = engine.execute("SELECT HOP_START(ts, INTERVAL '1' MINUTE, INTERVAL '5' MINUTE) AS s, COUNT(1) AS c FROM user_log GROUP BY HOP(ts, INTERVAL '1' MINUTE, INTERVAL '5' MINUTE)")
    assert hop.count() == 5
    session = engine.execute("SELECT SESSION_START(ts, INTERVAL '30' SECOND) AS s, SESSION_END(ts, INTERVAL '30' SECOND) AS e, SESSION_ROWTIME(ts, INTERVAL '30' SECOND) AS r, COUNT(1) AS c FROM user_log GROUP BY SESSION(ts, INTERVAL '30' SECOND)")
    assert sorted(str(r["r"]) for r in session.collect()) == ["2020-01-01 00:00:39.999000", "2020-01-01 00:01:19.999000"]
    tvf = engine.execute("SELECT window_start, COUNT(*) AS n FROM TABLE(TUMBLE(TABLE user_log, DESCRIPTOR(ts), INTERVAL '30' SECOND)) GROUP BY window_start, window_end")
    assert sorted(r["n"] for r in tvf.collect()) == [1, 1]


def sources(df, **more):
    return {c.query_column: list(c.sources) for c in lineage.column_lineage(df, **more)}


def test_column_lineage_of_an_insert(engine):
    df = engine.query(JOIN)
    found = lineage.column_lineage(df, "mysql_sink", ["a1", "a", "b", "c"])
    assert [(c.sink_column, c.query_column, list(c.sources)) for c in found] == [
        ("a1", "concat_a", [("source1", "a"), ("source2", "a")]),
        ("a", "aa", [("source1", "a")]),
        ("b", "b", [("source2", "b")]),
        ("c", "c", [("source2", "c")]),
    ]


def test_column_lineage_through_the_plan(engine, spark):
    q = engine.query
    assert sources(q("SELECT a, b FROM source1 UNION ALL SELECT a, c FROM source2")) == {"a": [("source1", "a"), ("source2", "a")], "b": [("source1", "b"), ("source2", "c")]}
    assert sources(q("SELECT x + 1 AS y, n FROM (SELECT b + c AS x, a AS n FROM source1)")) == {"y": [("source1", "b"), ("source1", "c")], "n": [("source1", "a")]}
    assert sources(q("SELECT a, COUNT(*) AS n, SUM(b) AS s, 1 AS one FROM source1 GROUP BY a")) == {"a": [("source1", "a")], "n": [], "s": [("source1", "b")], "one": []}
    assert sources(q("SELECT l.b AS x, r.c AS y FROM source1 l JOIN source1 r ON l.a = r.a")) == {"x": [("source1", "b")], "y": [("source1", "c")]}
    assert sources(q("WITH t AS (SELECT b AS z FROM source2) SELECT z, (SELECT max(c) FROM source1) AS m FROM t")) == {"z": [("source2", "b")], "m": [("source1", "c")]}
    assert sources(q("SELECT row_number() OVER (PARTITION BY a ORDER BY b) AS rn FROM source1")) == {"rn": [("source1", "a"), ("source1", "b")]}
    assert sources(q("SELECT s.a, t.c FROM source1 s, LATERAL (SELECT c FROM source2 WHERE source2.a = s.a ORDER BY c LIMIT 1) t")) == {"a": [("source1", "a")], "c": [("source2", "c")]}
    assert sources(q("SELECT * FROM VALUES (1) AS v(x)")) == {"x": []}
    assert sources(spark.table("source1").select(F.explode(F.array("b", "c")).alias("e"))) == {"e": [("source1", "b"), ("source1", "c")]}


def test_lineage_never_fails_a_query(caplog):
    with caplog.at_level(logging.INFO, "rivulet.lineage"):
        assert lineage.collect(None, "t") == []
    assert "can't be collected" in caplog.text


def test_lineage_log(engine, caplog):
    with caplog.at_level(logging.INFO, "rivulet.lineage"):
        lineage.collect(engine.query(JOIN), "mysql_sink", ["a1", "a", "b", "c"])
        lineage.collect(engine.query(JOIN), "mysql_sink", impl="other")
    assert "table: mysql_sink, field: a1, [source1.a, source2.a]" in caplog.text and "unknown collect-lineage-impl" in caplog.text


def test_table_lineage(engine):
    tree = lineage.table_lineage(engine.query(JOIN), "mysql_sink", engine.catalog)
    assert tree.kind == "sink" and tree.tables() == ["source1", "source2"] and tree.inputs[0].kind == "Join"
    alone = lineage.table_lineage(engine.spark.createDataFrame([(1,)], "x int").select("x"))
    assert alone.name == lineage.ANONYMOUS


def test_programs_and_excluded_rules(engine, spark):
    left, right = spark.table("source1"), spark.table("source2")
    program = rules.Program().add(rules.key_by("a", partitions=3))
    assert program(left).rdd.getNumPartitions() == 3
    assert program.only(rules.broadcast_below(10))(right).join(left, "a").count() == 1
    with rules.excluded(spark, rules.PUSH_PREDICATE_THROUGH_JOIN):
        assert rules.PUSH_PREDICATE_THROUGH_JOIN in spark.conf.get("spark.sql.optimizer.excludedRules")


def test_upsert_takes_the_last_row_by_order(engine, spark, tmp_path):
    engine.execute(f"CREATE TABLE latest (k BIGINT, v STRING, PRIMARY KEY (k) NOT ENFORCED) WITH ('connector'='upsert','path'='{tmp_path}/u')")
    log = spark.range(50).selectExpr("id AS k", "explode(array(named_struct('_op', '+I', '_seq', 1, 'v', 'old'), named_struct('_op', '+U', '_seq', 2, 'v', 'new'))) AS x").selectExpr("x._op", "x._seq", "k", "x.v")
    engine.catalog.insert("latest", log.repartition(7))
    spec = engine.catalog.get("latest")
    assert {r["v"] for r in sinks.read_upsert(spark, spec).collect()} == {"new"} and sinks.read_upsert(spark, spec).count() == 50
    with pytest.raises(ValueError, match="order"):
        engine.catalog.insert("latest", log.drop("_seq"))
