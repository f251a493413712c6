"""Aggregates, distinct, top-N and union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark limits each group within partitions before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL: by position, nothing removed. Column names are the first one's."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def split_distinct(df: DataFrame, keys: list[str], column: str, alias: str, buckets: int = 64) -> DataFrame:
    """COUNT(DISTINCT column) by keys in two phases: distinct values are counted by key and bucket of the value, then summed,
    so that the values of a key that most rows share are counted by up to `buckets` tasks."""
    bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).alias("__bucket")
    parts = df.groupBy(*keys, bucket).agg(F.count_distinct(column).alias("__n"))
    return parts.groupBy(*keys).agg(F.sum("__n").alias(alias))


def align(df: DataFrame, target) -> DataFrame:
    """df for a sink of schema `target`: columns matched by position and cast, as an INSERT does."""
    if len(df.columns) != len(target.fields):
        raise ValueError(f"the query has {len(df.columns)} columns, the sink {len(target.fields)}")
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(target.fields)])
