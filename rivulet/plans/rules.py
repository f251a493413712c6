"""Rewrites of DataFrames in the place of optimizer rules, and switches of the optimizer's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = Callable[[DataFrame], DataFrame]


class Program:
    """Rules in order, applied one after the other. Catalyst optimizes what they leave."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = list(rules or [])

    def add(self, *rules: Rule) -> Program:
        self.rules += rules
        return self

    def remove(self, rule: Rule) -> Program:
        self.rules.remove(rule)
        return self

    def only(self, rule: Rule) -> Program:
        self.rules = [rule]
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, rule: rule(d), self.rules, df)


def key_by(*columns: str, partitions: int | None = None) -> Rule:
    """Partitions a lookup's input by its keys."""
    return lambda df: df.repartition(partitions, *columns) if partitions else df.repartition(*columns)


def broadcast_below(rows: int) -> Rule:
    """Marks a dimension for broadcast if it has at most `rows` rows."""
    return lambda df: F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def excluded(spark: SparkSession, *rules: str) -> Iterator[None]:
    """Optimizer rules (class names) switched off for what is planned inside."""
    key = "spark.sql.optimizer.excludedRules"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ",".join(filter(None, [before, *rules])))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


PUSH_PREDICATE_THROUGH_JOIN = "org.apache.spark.sql.catalyst.optimizer.PushPredicateThroughJoin"


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """EXPLAIN as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
