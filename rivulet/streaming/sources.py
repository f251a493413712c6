"""Sources written in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


def generated(name: str, schema: T.StructType, rows: Callable[[int, int], list[tuple]], per_batch: int = 10) -> type[DataSource]:
    """A stream source whose rows a function makes: rows(start, end) gives those of offsets start to end.

    The function must give the same rows for the same offsets, which is what makes a restart exact.
    """

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"at": 0}

        def read(self, start: dict):
            at = start["at"]
            return iter(rows(at, at + per_batch)), {"at": at + per_batch}

        def readBetweenOffsets(self, start: dict, end: dict):
            return iter(rows(start["at"], end["at"]))

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return schema

        def simpleStreamReader(self, schema):
            return Stream()

    return Source


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)
