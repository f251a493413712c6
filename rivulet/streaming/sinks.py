"""Streams into several sinks, keyed tables and changelogs, by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import changelog


def route(stream: DataFrame, sinks: dict[str, tuple[Column, Callable[[DataFrame, int], None]]], columns: list[str] | None = None) -> DataStreamWriter:
    """Each row of a micro-batch to every sink whose condition it meets; the source is read once.

    sinks: name to (condition, write(rows, batch)). A batch that is run again after a failure calls the writers again with the
    same number, so a writer that must not repeat rows keys its output by it.
    """

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for condition, write in sinks.values():
                rows = held.where(condition)
                write(rows.select(*columns) if columns else rows, number)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(run)


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A writer that keeps each batch in a folder of its number, so that a batch run again replaces itself."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def upsert(stream: DataFrame, path: str, keys: list[str]) -> DataStreamWriter:
    """Rows of an update-mode stream into a table keyed by `keys`: versions by batch; read it with `read_upsert`."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch if "_op" in batch.columns else batch.withColumn("_op", F.lit("+U"))
        rows.where("_op <> '-U'").withColumn("__version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(run)


def read_upsert(spark, path: str, keys: list[str]) -> DataFrame:
    return changelog.latest(spark.read.parquet(path).drop("batch"), keys, ["__version"]).drop("__version")


def _folders(spark, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the whole bases and of the batches in the folder of a keyed table."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
    whole = [n for n in names if fs.exists(n.suffix("/_SUCCESS"))]
    numbers = lambda kind: sorted(int(n.getName()[len(kind) :]) for n in whole if n.getName().startswith(kind))
    return numbers("base="), numbers("batch=")


def _remove(spark, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _versions(spark, path: str, number: int, schema) -> DataFrame:
    """The newest base before batch `number` with the batches between: each key's last row is its value."""
    bases, batches = _folders(spark, path)
    base = max((b for b in bases if b < number), default=-1)
    held = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={b}" for b in batches if base < b < number]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def _compact(spark, path: str, number: int, keys: list[str], schema) -> None:
    """Folds the batches before `number` into one base, then removes what it replaces.

    A base counts once its _SUCCESS is there, and only committed batches are folded, so a batch that is run again
    finds either the former base with its batches or the new one.
    """
    bases, batches = _folders(spark, path)
    if number - 1 not in bases:
        kept = changelog.latest(_versions(spark, path, number, schema), keys, ["__version"]).withColumn("_op", F.lit("+U"))
        kept.write.mode("overwrite").parquet(f"{path}/base={number - 1}")
    for b in bases:
        if b < number - 1:
            _remove(spark, f"{path}/base={b}")
    for b in batches:
        if b < number:
            _remove(spark, f"{path}/batch={b}")


def emit_changes(stream: DataFrame, keys: list[str], state_path: str, write: Callable[[DataFrame, int], None], compact_every: int = 16) -> DataStreamWriter:
    """The changelog (-U and +U pairs, +I) of an updating aggregate in update mode.

    Each batch is compared with what the table at state_path holds for the batch's keys, `write` gets the changes, and
    the batch's rows become the keys' values. A batch that is run again compares with the same former values. A null key
    is a key like others. Every `compact_every` batches the table is folded into a base, so a batch reads one row a key
    and at most that many batches, however long the stream has run.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = batch.persist()
        rows = held.withColumn("_op", F.lit("+U")).withColumn("__version", F.lit(number).cast("long"))
        try:
            if number and number % compact_every == 0:
                _compact(spark, state_path, number, keys, rows.schema)
            touched = held.select(F.struct(*keys).alias("__key")).distinct()
            versions = _versions(spark, state_path, number, rows.schema).withColumn("__of", F.struct(*keys))
            known = versions.join(touched, F.col("__of").eqNullSafe(F.col("__key")), "left_semi").drop("__of")
            before = changelog.latest(known, keys, ["__version"]).select(*held.columns)
            write(changelog.diff(before, held, keys), number)
            rows.write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        finally:
            held.unpersist()

    return stream.writeStream.outputMode("update").foreachBatch(run)
