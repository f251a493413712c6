"""Lookup joins, and as-of (temporal) joins against versioned tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import slices

#: A dimension is broadcast on request only if it has at most so many rows and bytes; larger ones shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

#: Rows of a key, both sides together, from which an as-of join splits it by slices of time.
HOT_ROWS = slices.HOT_ROWS

#: The row kind of a deleted version.
DELETE = "-D"


@dataclass(frozen=True)
class RetryPolicy:
    """`count` delayed attempts after the first miss, `delay_seconds` apart."""

    count: int = 3
    delay_seconds: float = 5.0


def _on(on: dict[str, str], left: DataFrame, right: DataFrame) -> Column:
    out = None
    for a, b in on.items():
        one = left[a] == right[b]
        out = one if out is None else out & one
    if out is None:
        raise ValueError("a lookup join needs an equality on the dimension's key")
    return out


def small(df: DataFrame) -> bool:
    """True if df has BROADCAST_ROWS and BROADCAST_BYTES (of its rows as text) at most; it reads no further rows."""
    some = df.limit(BROADCAST_ROWS + 1)
    rows, size = some.select(F.octet_length(F.to_json(F.struct(*some.columns))).alias("n")).agg(F.count("*"), F.sum("n")).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def lookup_join(left: DataFrame, dimension: DataFrame, on: dict[str, str], how: str = "inner", strategy: str = "auto", partitions: int | None = None) -> DataFrame:
    """Joins each row of `left`, batch or stream, with the dimension's rows of its key as they are when it is processed.

    on: column of left to column of the dimension. how: inner, or left (null where nothing is found). Several matches
    give several rows. On a stream the dimension is read anew for each micro-batch. strategy: auto (Spark chooses by
    size), broadcast (if the dimension has BROADCAST_ROWS and BROADCAST_BYTES at most, else auto; for a dimension on a
    stream's other side the check is made when the query starts), or keyby (both sides are partitioned by key and
    merged, never broadcast; Spark splits a key that holds much of the input). partitions: of the input, for keyby.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a lookup join is inner or left, not {how}")
    if strategy == "keyby":
        left = left.repartition(partitions, *on) if partitions else left
        dimension = dimension.hint("merge")
    elif strategy == "broadcast":
        if small(dimension):
            dimension = F.broadcast(dimension)
    elif strategy != "auto":
        raise ValueError(f"unknown strategy {strategy}")
    return left.join(dimension, _on(on, left, dimension), how)


def retried_lookup(left: DataFrame, versions: DataFrame, on: dict[str, str], arrival: str, available: str, policy: RetryPolicy = RetryPolicy(), how: str = "left") -> DataFrame:
    """What a lookup join with retries emits in the end, over bounded tables.

    versions: the dimension with the time from which each row is there (`available`). A row of left that arrives at
    `arrival` is looked up then and, while it finds nothing, at most policy.count times more, policy.delay_seconds apart.
    The first attempt that finds rows emits them all; without one, left gives nulls and inner nothing. Adds `attempt`
    (0: at once; null: never found). Columns of versions that left has too are renamed right_<name>.

    What decides is the time from which a key has any row, so a row's first successful attempt comes from an aggregate
    by key; the rows there at that attempt are then joined once, by key and time.
    """
    names = {c: c if c not in left.columns else f"right_{c}" for c in versions.columns}
    right = versions.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[F.col(f"`{b}`").alias(f"__k{i}") for i, b in enumerate(on.values())], F.unix_micros(F.col(f"`{available}`").cast("timestamp")).alias("__available"))
    keys = [f"__k{i}" for i in range(len(on))]
    first = right.groupBy(*keys).agg(F.min("__available").alias("__first")).withColumnsRenamed({k: f"{k}f" for k in keys})
    arrived, step = F.unix_micros(F.col(f"`{arrival}`").cast("timestamp")), F.lit(int(policy.delay_seconds * 1_000_000))
    met = left.join(first, _on({a: f"__k{i}f" for i, a in enumerate(on)}, left, first), "left")
    attempt = F.greatest(F.lit(0), F.ceil((F.col("__first") - arrived) / step)).cast("int")
    tried = met.withColumn("attempt", F.when(F.col("__first").isNotNull() & (attempt <= policy.count), attempt)).withColumn("__until", arrived + F.col("attempt") * step)
    # A row that never finds anything has null keys in the join, so it meets no version.
    asked = tried.withColumns({f"__a{i}": F.when(F.col("attempt").isNotNull(), F.col(f"`{a}`")) for i, a in enumerate(on)})
    there = _on({f"__a{i}": f"__k{i}" for i in range(len(on))}, asked, right) & (right["__available"] <= asked["__until"])
    out = asked.join(right, there, how)
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"`{n}`") for n in names.values()], "attempt")


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    left_time: str,
    right_time: str,
    how: str = "inner",
    op: str | None = None,
    order: list[str] | None = None,
    condition: Column | None = None,
    bucket: float | str | None = "auto",
) -> DataFrame:
    """Joins each row of left with the latest version of its key: the right row of largest time <= left's.

    op: the column of right with the row kind; a version of kind -D ends the key, so it matches nothing. order: columns
    of right that decide between versions of equal time (the last wins); without it, which one wins is unspecified.
    condition: tested on the chosen pair, after the choice; a pair that fails is no match. how: inner, or left (nulls).
    Columns of right are taken as they are, nulls included; those that left has too are renamed right_<name>.
    One shuffle by key and one sort, linear in both sides: versions and rows are merged, and the last version seen is
    carried along. bucket: for keys that hold much of the rows, the length (seconds, or units of a number) of the slices
    of time that a key is split into; each slice starts with the version that the ones before it end with. "auto": none
    while each key has HOT_ROWS at most, by a count of both sides, else so short that the largest key has about so many
    in a slice if its rows are spread evenly.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"an as-of join is inner or left, not {how}")
    names = {c: c if c not in left.columns else f"right_{c}" for c in right.columns}
    payload = F.struct(*[right[c].alias(names[c]) for c in right.columns])
    order = order or []
    versions = right.select(
        *[right[b].alias(f"__k{i}") for i, b in enumerate(on.values())],
        right[right_time].alias("__t"),
        F.lit(0).alias("__side"),
        *[right[c].alias(f"__o{i}") for i, c in enumerate(order)],
        F.lit(None).cast(left.select(F.struct("*").alias("x")).schema["x"].dataType).alias("__left"),
        payload.alias("__right"),
        (right[op] if op else F.lit(None).cast("string")).alias("__op"),
    )
    rows = left.select(
        *[left[a].alias(f"__k{i}") for i, a in enumerate(on)],
        left[left_time].alias("__t"),
        F.lit(1).alias("__side"),
        *[F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(order)],
        F.struct(*[left[c] for c in left.columns]).alias("__left"),
        F.lit(None).cast(versions.schema["__right"].dataType).alias("__right"),
        F.lit(None).cast("string").alias("__op"),
    )
    keys = [f"__k{i}" for i in range(len(on))]
    parts, merged = keys, versions.unionByName(rows)
    if bucket == "auto":
        bucket = _bucket(versions, rows, keys, left.schema[left_time].dataType)
    if bucket is not None:
        slot = slices.slot(F.col("__t"), left.schema[left_time].dataType, bucket)
        versions, rows = versions.withColumn("__b", slot), rows.withColumn("__b", slot)
        parts, merged = [*keys, "__b"], versions.unionByName(rows).unionByName(_carried(versions, rows, keys, len(order)))
    # Right before left at equal times, because the match is <=. The version is one struct, so that its nulls stay.
    seen = Window.partitionBy(*parts).orderBy("__t", "__side", *[f"__o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    version = F.when(F.col("__side") == 0, F.struct("__right", "__op", F.col("__t").alias("__since")))
    merged = merged.withColumn("__version", F.last(version, ignorenulls=True).over(seen)).where("__side = 1")
    comparable = F.lit(True)
    for k in keys:
        comparable = comparable & F.col(k).isNotNull()
    there = comparable & F.col("__version").isNotNull() & F.col("__version.__since").isNotNull() & F.col("__t").isNotNull()
    if op:
        there = there & ~F.col("__version.__op").eqNullSafe(F.lit(DELETE))
    out = merged.select("__left.*", F.when(there, F.col("__version.__right")).alias("__r"))
    out = out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"__r.`{n}`").alias(n) for n in names.values()], F.col("__r").isNotNull().alias("__met"))
    if condition is not None:
        passed = F.coalesce(condition, F.lit(False)) & F.col("__met")
        kept = [F.when(passed, F.col(f"`{n}`")).alias(n) for n in names.values()]
        out = out.select(*[F.col(f"`{c}`") for c in left.columns], *kept, passed.alias("__met"))
    return (out.where("__met") if how == "inner" else out).drop("__met")


def _bucket(versions: DataFrame, rows: DataFrame, keys: list[str], kind: T.DataType) -> float | None:
    """The length of slices that the largest key needs; None if it needs none."""
    return slices.width(versions.select(*keys, "__t").unionByName(rows.select(*keys, "__t")), keys, "__t", kind, HOT_ROWS)


def _carried(versions: DataFrame, rows: DataFrame, keys: list[str], orders: int) -> DataFrame:
    """For each slice of time of a key that has rows, the last version of the slices before it, as a version."""
    order = ["__t", *[f"__o{i}" for i in range(orders)]]
    held = [c for c in versions.columns if c not in (*keys, "__b")]
    lasts = versions.where("__t IS NOT NULL").groupBy(*keys, "__b").agg(F.max_by(F.struct(*held), F.struct(*order)).alias("__last"))
    asked = rows.select(*keys, "__b").distinct().withColumn("__last", F.lit(None).cast(lasts.schema["__last"].dataType)).withColumn("__asked", F.lit(True))
    # A row for each slice of a key, however many rows the slice has.
    before = Window.partitionBy(*keys).orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
    line = asked.unionByName(lasts.withColumn("__asked", F.lit(False))).withColumn("__carry", F.last("__last", ignorenulls=True).over(before))
    found = line.where("__asked AND __carry IS NOT NULL")
    return found.select(*[F.col(c) if c in (*keys, "__b") else F.col(f"__carry.{c}").alias(c) for c in versions.columns])


def temporal_join(left: DataFrame, changelog: DataFrame, on: dict[str, str], left_time: str, right_time: str, op: str = "_op", **more) -> DataFrame:
    """FOR SYSTEM_TIME AS OF left.time over a versioned table given as an upsert changelog with row kinds."""
    return as_of_join(left, changelog.where(F.col(op) != "-U"), on, left_time, right_time, op=op, **more)


def lateral_top_n(spark, outer: str, inner: str, correlated: str, columns: list[str], order: str, n: int) -> DataFrame:
    """FROM outer, LATERAL (SELECT columns FROM inner WHERE correlated ORDER BY order LIMIT n): views by name."""
    return spark.sql(f"SELECT * FROM {outer}, LATERAL (SELECT {', '.join(columns)} FROM {inner} WHERE {correlated} ORDER BY {order} LIMIT {n})")
