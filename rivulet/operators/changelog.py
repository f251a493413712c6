"""Changelogs: rows with a kind, +I, -U, +U or -D, in column _op.

A changelog is ordered by an order column. -U and -D take a row back, +I and +U add one. An upsert changelog has a key and no
-U: a row of a key replaces the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import slices

OP = "_op"


def sign(op: str = OP) -> Column:
    """+1 for rows that are added, -1 for those taken back."""
    return F.when(F.col(op).isin("+I", "+U"), 1).when(F.col(op).isin("-U", "-D"), -1)


def latest(changelog: DataFrame, keys: list[str], order: list[str], op: str = OP) -> DataFrame:
    """The table that an upsert changelog amounts to: the last row of each key, unless that is a delete.

    max_by has a partial aggregate, so that a hot key's versions are combined before the shuffle.
    """
    others = [c for c in changelog.columns if c not in keys]
    rows = changelog.where(F.col(op) != "-U").groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    out = rows.where(F.col(f"__row.{op}") != "-D")
    return out.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in others if c != op])


def retract(changelog: DataFrame, keys: list[str], order: list[str], op: str = OP) -> DataFrame:
    """An upsert changelog as one with retractions: before the row that replaces or deletes it, each row once as -U or -D.

    Adds __step, the order of the rows that one change gives. A key of more than slices.HOT_ROWS rows is cut by the first
    column of `order`, where that is a number or a time; each slice begins with the last row before it.
    """
    values = [c for c in changelog.columns if c not in (op, *order)]
    change = changelog.where(F.col(op) != "-U")
    before = F.lag(F.struct(*values, op))
    length = slices.width(change, keys, order[0])
    if length is None:
        seen = change.withColumn("__before", before.over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        rows = slices.cut(change, keys, order[0], length)
        lasts = rows.groupBy("__key", "__slot").agg(F.max_by(F.struct(*change.columns), F.struct(*order)).alias("__last"))
        line = lasts.withColumn("__carry", F.lag("__last").over(Window.partitionBy("__key").orderBy("__slot"))).where("__carry IS NOT NULL")
        carried = line.select("__carry.*", F.struct("__key", "__slot").alias("__part"), F.lit(0).alias("__own"))
        both = rows.select(*change.columns, "__part", F.lit(1).alias("__own")).unionByName(carried)
        seen = both.withColumn("__before", before.over(Window.partitionBy("__part").orderBy("__own", *order))).where("__own = 1")
    had = F.col("__before").isNotNull() & (F.col(f"__before.{op}") != "-D")
    gone = F.col(op) == "-D"
    taken = seen.where(had).select(*[F.col(f"__before.`{c}`").alias(c) for c in values], *order, F.when(gone, "-D").otherwise("-U").alias(op), F.lit(0).alias("__step"))
    added = seen.where(~gone).select(*values, *order, F.when(had, "+U").otherwise("+I").alias(op), F.lit(1).alias("__step"))
    return taken.unionByName(added)


def count(changelog: DataFrame, keys: list[str], alias: str = "c", op: str = OP) -> DataFrame:
    """COUNT(*) by keys over a changelog with retractions; groups without rows are gone."""
    return changelog.groupBy(*keys).agg(F.sum(sign(op)).cast("bigint").alias(alias)).where(F.col(alias) > 0)


def total(changelog: DataFrame, keys: list[str], column: str, alias: str, op: str = OP) -> DataFrame:
    """SUM(column) by keys over a changelog with retractions; groups without rows are gone."""
    sums = changelog.groupBy(*keys).agg(F.sum(sign(op)).alias("__n"), F.sum(sign(op) * F.col(column)).alias(alias))
    return sums.where("__n > 0").drop("__n")


def maximum(changelog: DataFrame, keys: list[str], column: str, alias: str, op: str = OP) -> DataFrame:
    """MAX(column) by keys over a changelog with retractions: of the values that are still there."""
    values = changelog.groupBy(*keys, column).agg(F.sum(sign(op)).alias("__n")).where("__n > 0")
    return values.groupBy(*keys).agg(F.max(column).alias(alias))


def materialize(changelog: DataFrame, order: list[str], op: str = OP) -> DataFrame:
    """The multiset of rows that a changelog with retractions amounts to. `order` and op aren't part of a row."""
    values = [c for c in changelog.columns if c not in (op, *order)]
    held = changelog.groupBy(*values).agg(F.sum(sign(op)).alias("__n")).where("__n > 0")
    return held.select(*values, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i")).drop("__i")


def diff(before: DataFrame, after: DataFrame, keys: list[str], op: str = OP) -> DataFrame:
    """The changes by key that lead from one table to another, as -U and +U pairs, +I and -D.

    Both tables have one row a key. materialize(before as +I rows, then these) is `after`.
    """
    values = [c for c in after.columns if c not in keys]
    a = before.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.struct(*[F.col(v) for v in values]).alias("a"), F.lit(True).alias("in_a"))
    b = after.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.struct(*[F.col(v) for v in values]).alias("b"), F.lit(True).alias("in_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    both = a.join(b, on, "full_outer").where("in_a IS NULL OR in_b IS NULL OR NOT (a <=> b)")
    kinds = F.when(F.col("in_a").isNull(), F.array(F.lit("+I"))).when(F.col("in_b").isNull(), F.array(F.lit("-D"))).otherwise(F.array(F.lit("-U"), F.lit("+U")))
    rows = both.withColumn(op, F.explode(kinds))
    old = F.col(op).isin("-U", "-D")
    return rows.select(op, *[F.when(old, F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in keys], *[F.when(old, F.col(f"a.`{v}`")).otherwise(F.col(f"b.`{v}`")).alias(v) for v in values])


def _function(aggregate: Column) -> str | None:
    """The name of the function that the aggregate is a plain call of; None for others and for DISTINCT."""
    node = aggregate._jc.node()
    if node.getClass().getSimpleName() != "UnresolvedFunction" or node.isDistinct():
        return None
    return node.functionName().lower()


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


#: How results of parts of a key come together: over rows that hold them, and of two.
_MERGES = {"count": (F.sum, _added), "sum": (F.sum, _added), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def updating(rows: DataFrame, keys: list[str], order: list[str], aggregates: dict[str, Column], op: str = OP) -> DataFrame:
    """The changelog of a GROUP BY that is updated row by row: of each row the former result as -D, the new one as +I.

    aggregates: alias to an aggregate, which runs over the rows of the key up to this one. __step orders the two. If all are
    sums, counts, minima and maxima, a key of more than slices.HOT_ROWS rows is cut by the first column of `order`, where
    that is a number or a time; each slice adds to what the ones before it amount to.
    """
    merges = [_MERGES.get(_function(a)) for a in aggregates.values()]
    length = slices.width(rows, keys, order[0]) if all(merges) else None
    if length is None:
        by, carry, cut = Window.partitionBy(*keys).orderBy(*order), F.lit(None), rows
    else:
        cut = slices.cut(rows, keys, order[0], length)
        whole = cut.groupBy("__key", "__slot").agg(*[a.alias(f"__a{i}") for i, a in enumerate(aggregates.values())])
        past = Window.partitionBy("__key").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        sums = F.struct(*[m[0](f"__a{i}").over(past).alias(n) for i, (m, n) in enumerate(zip(merges, aggregates))])
        first = F.row_number().over(Window.partitionBy("__key").orderBy("__slot")) == 1
        line = whole.select(F.struct("__key", "__slot").alias("__of"), F.when(~first, sums).alias("__carry"))
        cut = cut.join(line, F.col("__part") == F.col("__of"))
        by, carry = Window.partitionBy("__part").orderBy(*order), F.col("__carry")
    running = {n: a.over(by.rowsBetween(Window.unboundedPreceding, 0)) for n, a in aggregates.items()}
    if length is not None:
        running = {n: F.when(carry.isNull(), a).otherwise(m[1](carry[n], a)) for (n, a), m in zip(running.items(), merges)}
    columns = [F.col(c) for c in (*keys, *order)]
    if length is not None:
        columns += [F.col("__part"), F.col("__carry")]
    now = cut.select(*columns, F.struct(*[a.alias(n) for n, a in running.items()]).alias("now"))
    was = F.lag("now").over(by)
    pairs = now.withColumn("was", was if length is None else F.coalesce(was, carry)).where("was IS NULL OR NOT (was <=> now)")
    kinds = F.when(F.col("was").isNull(), F.array(F.lit("+I"))).otherwise(F.array(F.lit("-D"), F.lit("+I")))
    steps = pairs.select(*keys, *order, "was", "now", F.posexplode(kinds).alias("__step", op))
    row = lambda n: F.when(F.col(op) == "-D", F.col(f"was.{n}")).otherwise(F.col(f"now.{n}")).alias(n)
    return steps.select(op, *keys, *[row(n) for n in aggregates], *[F.col(o).alias(f"__{o}") for o in order], "__step")


#: Legacy sink modes: whether they want rows before updates, and whether they want the flag of the change.
SINK_MODES = {"RETRACT": (True, True), "APPEND": (False, False), "UPSERT": (False, True)}


def for_sink(changelog: DataFrame, mode: str, op: str = OP) -> DataFrame:
    """The changelog as a sink of this mode takes it. An append sink takes inserts alone; other kinds are an error."""
    before, flag = SINK_MODES[mode.upper()]
    if mode.upper() == "APPEND":
        wrong = F.raise_error(F.concat(F.lit("an append sink can't take a row of kind "), F.col(op)))
        changelog = changelog.where(F.when(F.col(op) == "+I", True).otherwise(wrong.cast("boolean")))
    rows = changelog if before else changelog.where(F.col(op) != "-U")
    return rows if flag else rows.drop(op)
