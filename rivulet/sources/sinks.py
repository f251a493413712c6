"""Writers by connector name. Each takes (df, spec)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changelog
from . import embedded


def filesystem(df: DataFrame, spec) -> None:
    writer = df.write.mode("append").format(spec.options.get("format", "csv"))
    for key in ("header", "sep", "compression"):
        if key in spec.options:
            writer = writer.option(key, spec.options[key])
    writer.save(spec.options["path"])


def jdbc(df: DataFrame, spec) -> None:
    options = {"url": spec.options["url"], "dbtable": spec.options["table-name"]}
    names = {"username": "user", "password": "password", "driver": "driver", "sink.buffer-flush.max-rows": "batchsize"}
    options |= {names[k]: v for k, v in spec.options.items() if k in names}
    if embedded.out_of_reach(df.sparkSession, options["url"]):
        embedded.insert(df, options)
    else:
        df.write.format("jdbc").options(**options).mode("append").save()


def console(df: DataFrame, spec) -> None:
    """Prints the rows: a sink for the eye. It says so if there are more than print.rows."""
    n = int(spec.options.get("print.rows", "1000"))
    df.show(n, truncate=False)
    if df.limit(n + 1).count() > n:
        print(f"only the first {n} rows are printed (print.rows)")


def blackhole(df: DataFrame, spec) -> None:
    df.write.format("noop").mode("overwrite").save()


#: Row kinds that are kept beside an upsert sink's columns.
_VERSION = "__version"


def upsert(df: DataFrame, spec) -> None:
    """A table keyed by the primary key, as versions in Parquet: each insert appends a batch, `read_upsert` gives the last
    row of each key. A row of kind -D is a tombstone; -U isn't written.

    Of several rows of a key in one insert the last by column _seq, which isn't kept, counts; without it they are refused.
    """
    if not spec.primary_key:
        raise ValueError(f"an upsert sink needs a primary key; {spec.name} has none")
    rows = df if "_op" in df.columns else df.withColumn("_op", F.lit("+U"))
    rows, key = rows.where("_op <> '-U'"), list(spec.primary_key)
    if "_seq" in rows.columns:
        others = [c for c in rows.columns if c not in (*key, "_seq")]
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*others), "_seq").alias("__row")).select(*key, "__row.*")
    elif not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"an insert into {spec.name} has several rows of a key; give their order in a column _seq")
    batch = spec.options.get("batch")
    stamp = F.lit(int(batch)).cast("long") if batch is not None else F.unix_micros(F.current_timestamp())
    rows.withColumn(_VERSION, stamp).write.mode("append").parquet(spec.options["path"])


def read_upsert(spark, spec) -> DataFrame:
    """What an upsert sink holds."""
    rows = spark.read.parquet(spec.options["path"])
    return changelog.latest(rows, list(spec.primary_key), [_VERSION]).drop(_VERSION)


def upsert_kafka(df: DataFrame, spec) -> None:
    """Keyed messages: key and value as CSV or JSON, a null value for a delete. Needs Spark's Kafka connector."""
    if not spec.primary_key:
        raise ValueError(f"an upsert sink needs a primary key; {spec.name} has none")
    messages(df, spec).write.format("kafka").option("kafka.bootstrap.servers", spec.options["properties.bootstrap.servers"]).option("topic", spec.options["topic"]).save()


def messages(df: DataFrame, spec) -> DataFrame:
    """(key, value) of an upsert topic."""
    pack = {"csv": F.to_csv, "json": F.to_json}
    rows = df.where("_op <> '-U'") if "_op" in df.columns else df.withColumn("_op", F.lit("+U"))
    columns = [c for c in rows.columns if c != "_op"]
    key = pack[spec.options.get("key.format", "json")](F.struct(*spec.primary_key))
    value = pack[spec.options.get("value.format", "json")](F.struct(*columns))
    return rows.select(key.alias("key"), F.when(F.col("_op") != "-D", value).alias("value"))


WRITERS = {"filesystem": filesystem, "jdbc": jdbc, "print": console, "blackhole": blackhole, "upsert": upsert, "upsert-kafka": upsert_kafka}
