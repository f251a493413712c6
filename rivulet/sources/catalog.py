"""Tables declared with a schema, a key, a watermark and connector options."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import at_precision
from ..operators.relational import align
from . import embedded

#: Legacy option names and what they are called now.
LEGACY = {
    "connector.type": "connector",
    "connector.path": "path",
    "connector.topic": "topic",
    "connector.startup-mode": "scan.startup.mode",
    "connector.properties.bootstrap.servers": "properties.bootstrap.servers",
    "connector.url": "url",
    "connector.table": "table-name",
    "connector.username": "username",
    "connector.password": "password",
    "format.type": "format",
}


@dataclass(frozen=True)
class TableSpec:
    """A table's declaration.

    columns: name to type as text; TIMESTAMP(n) and bare VARCHAR are understood. computed: name to expression, added in
    order after the columns. primary_key is kept, not enforced. watermark: event time column and delay.
    """

    name: str
    columns: dict[str, str]
    options: dict[str, str] = field(default_factory=dict)
    primary_key: tuple[str, ...] = ()
    watermark: tuple[str, str] | None = None
    computed: dict[str, str] = field(default_factory=dict)
    not_null: frozenset[str] = frozenset()
    temporary: bool = False

    def __post_init__(self):
        object.__setattr__(self, "options", {LEGACY.get(k, k): v for k, v in self.options.items()})

    @property
    def connector(self) -> str:
        return self.options.get("connector", "").removesuffix("-legacy")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(t), n not in self.not_null and n not in self.primary_key) for n, t in self.columns.items()])

    def precisions(self) -> dict[str, int]:
        found = {n: re.match(r"(?i)\s*timestamp(?:_ltz)?\s*\(\s*(\d)\s*\)", t) for n, t in self.columns.items()}
        return {n: int(m[1]) for n, m in found.items() if m}

    @property
    def processing_times(self) -> set[str]:
        return {n for n, e in self.computed.items() if re.fullmatch(r"(?i)\s*proctime\s*\(\s*\)\s*", e)}


def spark_type(text: str) -> T.DataType:
    """The Spark type of a declared one: TIMESTAMP(n) has no zone, TIMESTAMP_LTZ(n) has one."""
    t = text.strip().upper()
    if re.fullmatch(r"TIMESTAMP_LTZ(\s*\(\s*\d\s*\))?", t):
        return T.TimestampType()
    if re.fullmatch(r"(TIMESTAMP|DATETIME)(\s*\(\s*\d\s*\))?", t):
        return T.TimestampNTZType()
    if re.fullmatch(r"(STRING|(VAR)?CHAR(\s*\(\s*\d+\s*\))?)", t):
        return T.StringType()
    return T._parse_datatype_string(t)


Reader = Callable[[SparkSession, TableSpec, bool], DataFrame]
Writer = Callable[[DataFrame, TableSpec], None]


class Catalog:
    """Declared tables of a session. A source is a temporary view of its name; a sink is written by `insert`."""

    def __init__(self, spark: SparkSession):
        from . import connectors, sinks

        self.spark = spark
        self.tables: dict[str, TableSpec] = {}
        self.readers: dict[str, Reader] = dict(connectors.READERS)
        self.writers: dict[str, Writer] = dict(sinks.WRITERS)

    def get(self, name: str) -> TableSpec | None:
        return self.tables.get(name)

    def create(self, spec: TableSpec, streaming: bool = False) -> TableSpec:
        """Declares a table; one whose connector can be read gets its view at once."""
        if not spec.connector:
            raise ValueError(f"table {spec.name} has no connector")
        if spec.connector not in self.readers and spec.connector not in self.writers:
            raise ValueError(f"unknown connector {spec.connector}; there are {', '.join(sorted({*self.readers, *self.writers}))}")
        self.tables[spec.name] = spec
        if spec.connector in self.readers and not (spec.connector in self.writers and spec.options.get("sink") == "true"):
            try:
                self.read(spec.name, streaming).createOrReplaceTempView(spec.name)
            except Exception as e:
                if spec.connector not in self.writers or "PATH_NOT_FOUND" not in str(e):
                    raise
        return spec

    def read(self, name: str, streaming: bool = False, **hints: str) -> DataFrame:
        """The table, with computed columns, declared precisions and watermark. hints are merged over its options."""
        spec = self.tables[name]
        spec = replace(spec, options=spec.options | hints)
        df = self.readers[spec.connector](self.spark, spec, streaming)
        for column, digits in spec.precisions().items():
            df = df.withColumn(column, at_precision(F.col(column), digits).cast(spec.schema[column].dataType))
        for column, expression in spec.computed.items():
            df = df.withColumn(column, F.expr(re.sub(r"(?i)\bproctime\s*\(\s*\)", "current_timestamp()", expression)))
        if spec.watermark and df.isStreaming:
            # Spark's watermarks are on timestamps with a zone: the session's, which is UTC.
            df = df.withColumn(spec.watermark[0], F.col(f"`{spec.watermark[0]}`").cast("timestamp")).withWatermark(*spec.watermark)
        return df

    def from_stream(self, name: str, df: DataFrame, columns: list[str] | None = None, watermark: tuple[str, str] | None = None, primary_key: tuple[str, ...] = (), proctime: str | None = None) -> DataFrame:
        """A view of a DataFrame: renamed by position, with a processing time column and a watermark if asked for."""
        out = df.toDF(*columns) if columns else df
        out = out.withColumn(proctime, F.current_timestamp()) if proctime else out
        out = out.withWatermark(*watermark) if watermark and out.isStreaming else out
        types = {f.name: f.dataType.simpleString() for f in out.schema.fields}
        self.tables[name] = TableSpec(name, types, {"connector": "view"}, primary_key, watermark, {proctime: "proctime()"} if proctime else {}, temporary=True)
        out.createOrReplaceTempView(name)
        return out

    def insert(self, name: str, df: DataFrame) -> None:
        """INSERT INTO: df's columns go to the sink's by position, cast to its types."""
        spec = self.tables.get(name)
        if spec is None:
            raise ValueError(f"sink {name} isn't declared")
        if spec.connector not in self.writers:
            raise ValueError(f"connector {spec.connector} of {name} can't be written; sinks are {', '.join(sorted(self.writers))}")
        extra = [c for c in ("_op", "_seq") if c in df.columns and c not in spec.columns]
        body = align(df.drop(*extra), spec.schema) if not extra else align(df.select(*extra, *[c for c in df.columns if c not in extra]), T.StructType([*[df.schema[c] for c in extra], *spec.schema.fields]))
        self.writers[spec.connector](body, spec)
        if spec.connector == "jdbc" and embedded.out_of_reach(self.spark, spec.options["url"]):
            # Views of the database are of a copy: they get one with the new rows.
            for other in self.tables.values():
                if other.connector == "jdbc" and other.options.get("sink") != "true" and embedded.database(other.options["url"]) == embedded.database(spec.options["url"]):
                    self.read(other.name).createOrReplaceTempView(other.name)
