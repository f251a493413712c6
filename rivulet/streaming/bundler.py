"""Bundles of rows by number and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import slices


def bundles(df: DataFrame, max_count: int, order: list[str], time: str | None = None, interval_ms: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows (bundle, size, rows): arrays of at most max_count rows that are consecutive in `order` and, with a time column
    and an interval, of one time bucket. No row is lost, the last bundle included.

    keys: bundles are by key, in parallel. Without keys they are by time bucket, or by partition of the input where
    there is none, so no order over all rows is needed. A group of more than slices.HOT_ROWS rows is numbered by slices of
    the first column of `order`, where that is a number or a time. Works on bounded tables and inside foreachBatch.
    """
    parts = [F.col(k) for k in keys or []]
    if time is not None and interval_ms:
        millis = F.unix_millis(F.col(time).cast("timestamp"))
        parts.append((millis - F.pmod(millis, F.lit(interval_ms))).alias("__bucket"))
    whole = bool(parts)
    if not whole:
        parts.append(F.spark_partition_id().alias("__part"))
    columns = df.columns
    keyed = df.select(*[F.col(f"`{c}`") for c in columns], F.struct(*parts).alias("__group"))
    length = slices.width(keyed, ["__group"], order[0]) if whole else None
    if length is None:
        numbered = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__group").orderBy(*order)) - 1)
    else:
        cut = slices.cut(keyed, ["__group"], order[0], length)
        past = Window.partitionBy("__key").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        sizes = cut.groupBy("__key", "__slot").agg(F.count("*").alias("__size"))
        before = sizes.select(F.struct("__key", "__slot").alias("__of"), F.coalesce(F.sum("__size").over(past), F.lit(0)).alias("__past"))
        inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
        numbered = cut.join(before, F.col("__part") == F.col("__of")).withColumn("__n", F.col("__past") + inside - 1)
    placed = numbered.withColumn("__bundle", F.floor(F.col("__n") / max_count))
    rows = F.sort_array(F.collect_list(F.struct("__n", F.struct(*columns).alias("row"))))
    out = placed.groupBy("__group", "__bundle").agg(rows.alias("rows"))
    return out.select(F.struct("__group", "__bundle").alias("bundle"), F.size("rows").alias("size"), F.col("rows.row").alias("rows"))


def bundle_sizes(bundled: DataFrame) -> DataFrame:
    """The gauge of bundle sizes: how many bundles of each size."""
    return bundled.groupBy("size").agg(F.count("*").alias("bundles"))


def mini_batch(writer, latency: str = "1 second"):
    """A stream writer that triggers every `latency`: Spark's micro-batch is the bundle. Limit rows at the source, with
    maxFilesPerTrigger or maxOffsetsPerTrigger."""
    return writer.trigger(processingTime=latency)
