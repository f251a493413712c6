"""A database of the driver's process, with executors in other processes."""

import json
import os
import subprocess
import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pyspark
import pytest

from rivulet import queries

from .oracle import plain, sql_rows

CHILD = """
import json, sys
from pyspark.sql import SparkSession
from rivulet import queries
from rivulet.plans.dialect import Engine
from tests.oracle import rows
from tests.test_embedded import KINDS, ODD

home, sf = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC",
        "spark.sql.warehouse.dir": f"{home}/warehouse", "spark.checkpoint.dir": f"file://{home}/shared", "spark.sql.shuffle.partitions": "2"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
found = {"query": rows(queries.QUERIES["jdbc_roundtrip"](spark, sf))}
engine, url = Engine(spark), "jdbc:derby:memory:kinds;create=true"
columns = ", ".join(f"{n} {t}" for n, t in KINDS.items())
for name, sink in (("into", ", 'sink' = 'true'"), ("held", "")):
    engine.execute(f"CREATE TABLE {name} ({columns}) WITH ('connector' = 'jdbc', 'url' = '{url}', 'table-name' = 'kinds'{sink})")
    data = spark.createDataFrame(ODD, ", ".join(f"{n} {engine.catalog.tables['into'].schema[n].dataType.simpleString()}" for n in KINDS)).repartition(2)
    data.createOrReplaceTempView("odd")
    engine.execute("INSERT INTO into SELECT * FROM odd")
found["twice"] = rows(engine.execute("SELECT * FROM held"))
data.limit(0).createOrReplaceTempView("odd")
engine.execute("INSERT INTO into SELECT * FROM odd")
found["none more"] = engine.execute("SELECT * FROM held").count()
json.dump(found, open(f"{home}/found.json", "w"), default=str)
spark.stop()
"""

KINDS = {"b": "BIGINT", "i": "INT", "d": "DOUBLE", "m": "DECIMAL(20, 4)", "s": "STRING", "o": "BOOLEAN", "t": "DATE", "z": "TIMESTAMP(6)"}
ODD = [
    (2**40, -1, 0.1, Decimal("1234567890123456.7891"), "a 'quoted', \"name\"\n", True, date(2024, 2, 29), datetime(2024, 1, 1, 1, 2, 3, 456789)),
    (None, None, None, None, None, None, None, None),
    (0, 0, -1e300, Decimal("0"), "", False, date(1969, 12, 31), datetime(1969, 12, 31, 23, 59, 59, 1)),
]


@pytest.fixture(scope="module")
def found(tmp_path_factory, sf):
    """What a driver finds whose two executors are other processes."""
    home, repo = tmp_path_factory.mktemp("cluster"), Path(__file__).resolve().parent.parent
    (home / "spark").mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():  # executors work in Spark's home
        if p.name != "work":
            (home / "spark" / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK", "_PYSPARK"))}
    env |= {"PYTHONPATH": str(repo), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home / "spark"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(home / "local"), "TZ": "UTC"}
    run = subprocess.run([sys.executable, "-c", CHILD, str(home), sf], cwd=home, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-4000:]
    return json.loads((home / "found.json").read_text())


def test_roundtrip_on_a_cluster(found, sf):
    assert [tuple(r) for r in found["query"]] == sql_rows(queries.SQL["jdbc_roundtrip"], sf)


def test_kinds_nulls_and_a_later_insert(found):
    names = sorted(KINDS)
    number = lambda r: tuple(Decimal(x) if n == "m" and x is not None else x for n, x in zip(names, r))
    want = [tuple(plain(r[list(KINDS).index(n)]) for n in names) for r in ODD * 2]
    by_name = lambda r: str(r[names.index("s")])
    assert sorted(map(number, found["twice"]), key=by_name) == sorted(want, key=by_name)
    assert found["none more"] == 2 * len(ODD)
