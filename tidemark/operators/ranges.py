"""Places, running sums and ranks within keys of any size, without a task that holds a whole key.

Rows are dealt out by ranges of (keys, order) and written in that order; a range holds a part of a large key or many small
ones. What a row needs of the ranges before its own is one number per range and key, summed up on a table of about as many
rows as there are ranges. Rows that tie in the order share a range, so ties are met as one row of counts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: A key that more than this share of all rows has is looked up by broadcast; at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1e-3

#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in the order of (keys, order), each with its range and its place there."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the row below
    return written(ordered.withColumn("__at", at), "ranges").withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})


def same(keys: list[str], left: str = "a", right: str = "b") -> Column:
    """Equal keys of two sides, nulls equal to each other."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _with_before(rows: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """Adds what the ranges before a row's own hold of its key."""
    by = ["__range", *keys]
    per = written(rows.groupBy(*by).agg(*values), "ranges-sums")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = per.select(*by, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") if c != "__first" else F.col(c) for c in per.columns if c not in by))
    return rows.alias("a").join(small(written(sums, "ranges-before")).alias("b"), same(by)).select("a.*", *(f"b.{c}" for c in sums.columns if c not in by))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Each row's place within its key, from 0, as ``out``."""
    rows = _with_before(_ranged(df, keys, order), keys, F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    return rows.withColumn(out, F.col("__at") - F.col("__first") + F.col("__before___n")).select(*df.columns, out)


def summed_before(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The sum of ``value`` over the rows before each in its key, as ``out``."""
    rows = _with_before(_ranged(df, keys, order), keys, F.sum(value).alias("__n"))
    within = Window.partitionBy("__range", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.col("__before___n") + F.coalesce(F.sum(value).over(within), F.lit(0))).select(*df.columns, out)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each of ``keys`` once and in ``weight`` how many rows have them.

    Keys of very many rows are broadcast, so that no task gets all rows of one.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    least = max(1, int(total * HOT_SHARE))
    hot, cold = table.where(F.col(weight) > least), table.where(F.col(weight) <= least)
    added = [F.col(f"b.{c}") for c in table.columns if c not in keys]
    pick = lambda r, t: r.alias("a").join(t.alias("b"), same(keys)).select("a.*", *added)
    rest = rows.alias("a").join(F.broadcast(hot.select(*keys)).alias("b"), same(keys), "left_anti")
    return pick(rows, F.broadcast(hot)).unionByName(pick(rest, cold))


def average_ranks(points: DataFrame, keys: list[str], column: str, out: str, count: str = "c") -> DataFrame:
    """Ranks by ``column`` within the key, ties averaged; a point counts ``count`` times. Equal values meet as one count."""
    values = points.groupBy(*keys, column).agg(F.sum(count).alias("__held"), F.count(F.lit(1)).alias("__rows"))
    before = written(summed_before(values, keys, [column], "__held", "__below"), "ranks")
    ranked = looked_up(points, before.select(*keys, column, "__rows", (F.col("__below") + (F.col("__held") + 1) / 2.0).alias(out)), [*keys, column], "__rows")
    return ranked.drop("__rows")
