"""Tumbling, hopping and session windows: as groups, as a table function, and their auxiliary columns.

All rest on Spark's window expressions, so a window aggregate is one partial and one final hash aggregate and works on
streams with a watermark as it does on bounded tables. Windows are [start, end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TIME = "window_start", "window_end", "window_time"


def tumble(ts: str, size: str) -> Column:
    """TUMBLE(ts, size) as a grouping key."""
    return F.window(ts, size)


def hop(ts: str, slide: str, size: str) -> Column:
    """HOP(ts, slide, size): the slide comes first here, as in the dialect; Spark's own function takes it last."""
    return F.window(ts, size, slide)


def session(ts: str, gap: str) -> Column:
    """SESSION(ts, gap): ends `gap` after its last row; rows exactly one gap apart are of one session."""
    return F.session_window(ts, gap)


def rowtime(end: Column) -> Column:
    """*_ROWTIME: the last millisecond of a window."""
    return end - F.expr("INTERVAL '0.001' SECOND")


def _flat(df: DataFrame, window: str = "window") -> DataFrame:
    others = [F.col(f"`{c}`") for c in df.columns if c != window]
    return df.select(F.col(f"{window}.start").alias(START), F.col(f"{window}.end").alias(END), rowtime(F.col(f"{window}.end")).alias(TIME), *others)


def aggregate(df: DataFrame, window: Column, keys: list[str | Column], *aggregates: Column) -> DataFrame:
    """GROUP BY window and keys: window_start, window_end, window_time, the keys and the aggregates."""
    return _flat(df.groupBy(window.alias("window"), *keys).agg(*aggregates))


def count_distinct(df: DataFrame, window: Column, column: str, alias: str) -> DataFrame:
    """COUNT(DISTINCT column) for each window, in two levels, which also streams in append mode."""
    pairs = df.groupBy(window.alias("window"), column).agg(F.lit(1).alias("one"))
    return _flat(pairs.groupBy("window").agg(F.count(column).alias(alias)))


def table_function(df: DataFrame, window: Column) -> DataFrame:
    """TABLE(TUMBLE(...)) or TABLE(HOP(...)): every row of df, once for each window, with window_start, window_end and window_time."""
    placed = df.withColumn("window", window)
    out = placed.select(*[F.col(f"`{c}`") for c in df.columns], F.col("window.start").alias(START), F.col("window.end").alias(END))
    return out.withColumn(TIME, rowtime(F.col(END)))


def cumulate(df: DataFrame, ts: str, step: str, size: str) -> DataFrame:
    """Every row, once for each window that grows by `step` from the start of its `size` window until that is full."""
    placed = df.withColumn("__w", F.window(ts, size)).withColumn("__s", F.window(ts, step))
    ends = F.sequence(F.col("__s.end"), F.col("__w.end"), F.expr(f"INTERVAL {step}"))
    out = placed.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__w.start").alias(START), F.explode(ends).alias(END))
    return out.withColumn(TIME, rowtime(F.col(END)))
