"""Readers by connector name. Each takes (spark, spec, streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import embedded


def filesystem(spark: SparkSession, spec, streaming: bool) -> DataFrame:
    """CSV, JSON, Parquet or ORC files under a path, with the declared schema: nothing is inferred."""
    form = spec.options.get("format", "csv")
    reader = (spark.readStream if streaming else spark.read).schema(spec.schema)
    for key in ("header", "sep", "maxFilesPerTrigger", "nullValue", "timestampFormat", "timestampNTZFormat"):
        if key in spec.options:
            reader = reader.option(key, spec.options[key])
    if "csv.field-delimiter" in spec.options:
        reader = reader.option("sep", spec.options["csv.field-delimiter"])
    return reader.format(form).load(spec.options["path"])


def jdbc(spark: SparkSession, spec, streaming: bool) -> DataFrame:
    """A table of a database; filters and columns are pushed down. partition.* split the read over tasks.
    Of a database in the driver's process, executors in others scan a copy as of now (embedded.py)."""
    if streaming:
        raise ValueError("a jdbc table is bounded; join a stream with it as a lookup table")
    options = {"url": spec.options["url"], "dbtable": spec.options["table-name"]}
    names = {"username": "user", "password": "password", "driver": "driver", "scan.fetch-size": "fetchsize"}
    names |= {"scan.partition.column": "partitionColumn", "scan.partition.num": "numPartitions", "scan.partition.lower-bound": "lowerBound", "scan.partition.upper-bound": "upperBound"}
    options |= {names[k]: v for k, v in spec.options.items() if k in names}
    if embedded.out_of_reach(spark, options["url"]):
        options["url"] = embedded.copy(spark, options)
    read = spark.read.format("jdbc").options(**options).load()
    # Databases fold the case of names; columns are matched without it and cast to the declared types.
    actual = {c.lower(): c for c in read.columns}
    return read.select(*[F.col(f"`{actual[n.lower()]}`").cast(f.dataType).alias(n) for n, f in zip(spec.columns, spec.schema.fields)])


def changelog_files(spark: SparkSession, spec, streaming: bool) -> DataFrame:
    """A change-data-capture source replayed from files: the table's columns after _op, the row's kind.

    Stands for a snapshot (all +I) followed by a log. server-time-zone: the zone of the log's timestamps.
    """
    schema = T.StructType([T.StructField("_op", T.StringType()), *spec.schema.fields])
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    df = reader.format(spec.options.get("format", "json")).load(spec.options["path"])
    zone = spec.options.get("server-time-zone")
    if zone:
        for f in spec.schema.fields:
            if isinstance(f.dataType, T.TimestampType):
                df = df.withColumn(f.name, F.to_utc_timestamp(f.name, zone))
    return df


def kafka(spark: SparkSession, spec, streaming: bool) -> DataFrame:
    """JSON (or CSV) values of a topic. Needs Spark's Kafka connector on the class path."""
    start = {"earliest-offset": "earliest", "latest-offset": "latest"}.get(spec.options.get("scan.startup.mode", "earliest-offset"), "earliest")
    options = {"kafka.bootstrap.servers": spec.options["properties.bootstrap.servers"], "subscribe": spec.options["topic"], "startingOffsets": start}
    reader = spark.readStream if streaming else spark.read
    return parsed(reader.format("kafka").options(**options).load(), spec)


def parsed(df: DataFrame, spec) -> DataFrame:
    """The table's columns from the binary column `value`."""
    text = F.col("value").cast("string")
    if spec.options.get("value.format", spec.options.get("format", "json")) == "csv":
        return df.select(F.from_csv(text, spec.schema.simpleString()[7:-1].replace(":", " ")).alias("v")).select("v.*")
    return df.select(F.from_json(text, spec.schema).alias("v")).select("v.*")


def rate(spark: SparkSession, spec, streaming: bool) -> DataFrame:
    """Generated rows: timestamp and value, cast to the declared columns by position."""
    if streaming:
        df = spark.readStream.format("rate").option("rowsPerSecond", spec.options.get("rows-per-second", "1")).load()
    else:
        df = spark.range(int(spec.options.get("number-of-rows", "10"))).select(F.current_timestamp().alias("timestamp"), F.col("id").alias("value"))
    return df.select(*[F.col(a).cast(f.dataType).alias(f.name) for a, f in zip(df.columns, spec.schema.fields)])


#: Rows of key-value stores, by name, for tables with connector kv (a dimension of key to named values).
STORES: dict[str, DataFrame] = {}


def key_value(spark: SparkSession, spec, streaming: bool) -> DataFrame:
    """A key-value dimension: a DataFrame registered in STORES, or its rows (key, field, value) of the key additional-key."""
    df = STORES[spec.options.get("store", spec.name)]
    if "additional-key" in spec.options:
        df = df.where(F.col("key") == spec.options["additional-key"]).select("field", "value")
    return df.select(*[F.col(a).cast(f.dataType).alias(f.name) for a, f in zip(df.columns, spec.schema.fields)])


READERS = {
    "filesystem": filesystem,
    "jdbc": jdbc,
    "mysql-cdc": changelog_files,
    "changelog": changelog_files,
    "kafka": kafka,
    "datagen": rate,
    "redis": key_value,
    "kv": key_value,
}
