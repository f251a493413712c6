"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary

#: The white space that parts words: the class of `[^\x20\x09-\x0D]+`, which is also what bytes.split() parts by.
SPACE = b" \t\n\x0b\x0c\r"

#: A side of a join is broadcast below so many rows of a few dozen bytes (a few MB); beyond, the join shuffles.
BROADCAST_ROWS = 50_000

#: Texts are handed to numpy in slices of about so many bytes, so that a worker's memory doesn't follow the batch.
SLICE_BYTES = 4 << 20

#: As much for what handles the distinct words of a slice: the larger the slice, the fewer there are.
BULK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Unset, a temporary folder is set up, but only on a local master: there is but one machine then.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rivulet-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while an eager step runs; those before come back when it ends."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def early_shuffle_cleanup(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of an eager step go when the step ends, not when the driver collects garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


#: The setting of how many bytes a batch for Python holds. Spark's own bound, 64 MB, is taken several times over by each task.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema), in bounded memory: batches hold BULK_BYTES, or one longer row, and a worker returns at the end
    of a task what it no longer uses. The bound of batches is set for the session, where it has none: results are lazy."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BULK_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            vocabulary.settle()
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Freed memory goes back to the system: workers are reused, and their allocators would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


class Scratch:
    """Tables written to the shared folder while an operator works; removed on exit.

    A table cuts lineage and outlives executors. What a result still reads after exit is kept with `keep`,
    a reliable checkpoint that Spark's cleaner drops with the last frame that reads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/rivulet-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        remove(self.spark, self.root)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        with early_shuffle_cleanup(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        with early_shuffle_cleanup(self.spark):
            return df.checkpoint()



def text_map(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make: Callable, arrow_texts: bool = False) -> DataFrame:
    """Columns `keep` as they are, and columns `fields` that `make(texts)` gives for each slice of texts.

    `make` gets a list of str (null as None) of about SLICE_BYTES bytes, or one longer text, and returns a
    list of Arrow arrays, one for each field. With arrow_texts it gets an Arrow array of strings, nulls as empty
    ones, of about BULK_BYTES. The other columns of df never reach Python.
    """
    kept = [df.schema[c] for c in keep]
    schema = T.StructType([*kept, *fields])
    narrow = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, BULK_BYTES if arrow_texts else SLICE_BYTES):
                texts = part.column(part.num_columns - 1)
                made = make(texts.fill_null("") if arrow_texts else texts.to_pylist())
                columns = [*part.columns[:-1], *made]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)

    return map_arrow(narrow, run, schema)


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of column `text`, a row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if df has at most `rows` rows; it counts no further."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its count is below the bound, else as it is (the join then shuffles)."""
    return F.broadcast(df) if small(df, rows) else df


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
