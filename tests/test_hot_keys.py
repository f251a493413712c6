"""Keys with a third of the rows: changelogs and bundles cut them into slices, and the results are the same."""

import pytest
from pyspark.sql import functions as F

from rivulet.operators import changelog, slices
from rivulet.streaming import bundler


def rows(df):
    """As text, since NaN isn't equal to itself."""
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.fixture(params=["long", "double", "timestamp"])
def log(spark, request):
    """3,000 rows: key 0 has a third, key null a tenth; a null time first; every 7th change is a delete."""
    t = {"long": "id * 10", "double": "IF(id = 2999, double('NaN'), id / 3)", "timestamp": "timestamp_seconds(1000 + id * 5)"}[request.param]
    return spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 10 = 1 THEN NULL ELSE id % 50 END AS k",
        f"IF(id = 0, NULL, {t}) AS t", "id", "IF(id % 5 = 0, NULL, id % 11) AS v", "IF(id % 7 = 0, '-D', '+U') AS _op",
    ).repartition(7)


def both(monkeypatch, make):
    """rows() of what make() gives, whole and sliced."""
    whole = rows(make())
    monkeypatch.setattr(slices, "HOT_ROWS", 100)
    return whole, rows(make())


def test_retractions_of_a_hot_key(monkeypatch, log):
    whole, sliced = both(monkeypatch, lambda: changelog.retract(log, ["k"], ["t", "id"]))
    assert sliced == whole and len(whole) > 3000


def test_updating_aggregates_of_a_hot_key(monkeypatch, log):
    aggregates = {"n": F.count("*"), "m": F.count("v"), "total": F.sum("v"), "least": F.min("v"), "most": F.max("v")}
    whole, sliced = both(monkeypatch, lambda: changelog.updating(log, ["k"], ["t", "id"], aggregates))
    assert sliced == whole and len(whole) > 3000


def test_aggregates_that_do_not_merge_are_not_sliced(monkeypatch, log):
    for aggregate in (F.avg("v"), F.sum("v") + 1, F.collect_list("v")):
        assert changelog._function(aggregate) not in changelog._MERGES
    whole, sliced = both(monkeypatch, lambda: changelog.updating(log, ["k"], ["t", "id"], {"mean": F.avg("v")}))
    assert sliced == whole


def test_bundles_of_a_hot_key(monkeypatch, log):
    make = lambda: bundler.bundles(log, 8, ["t", "id"], keys=["k"])
    whole, sliced = both(monkeypatch, make)
    assert sliced == whole and make().agg(F.sum("size")).first()[0] == 3000


def test_slices_are_small(monkeypatch, log):
    """Of 3,000 rows no group of the window has more than a twentieth; but for NaN and nulls, slices are of equal length."""
    monkeypatch.setattr(slices, "HOT_ROWS", 100)
    finite = log.where("t IS NOT NULL").where("id < 2999")
    cut = slices.cut(finite, ["k"], "t", slices.width(finite, ["k"], "t"))
    assert cut.groupBy("__part").count().agg(F.max("count")).first()[0] <= 150


def test_what_is_not_sliced(spark):
    even = spark.range(100).selectExpr("1 AS k", "id", "'a' AS name", "5 AS same", "IF(id = 0, double('Infinity'), id) AS far")
    assert slices.width(even, ["k"], "id", most=200) is None
    for time in ("name", "same", "far", "missing"):
        assert slices.width(even, ["k"], time, most=10) is None
    assert slices.width(even.where("false"), ["k"], "id", most=10) is None
    assert slices.width(even, ["k"], "id", most=10) == pytest.approx(9.9)
