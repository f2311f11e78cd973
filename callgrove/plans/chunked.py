"""Ordered computations per key that stay balanced when one key is huge.

A plain window sorts all rows of a key in one task.  Here the key is cut into
``chunk`` pieces (a value that grows with the order, such as the day of a
timestamp): each piece is scanned on its own, the pieces are summarised to one
row each with map-side combine, and only the summaries are scanned per key.

Key and chunk travel as one struct column.  Struct equality treats nulls as
equal, so null keys need no special join condition, and window, aggregate and
join all use the same hash partitioning: the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PIECE, _KEY, _CARRY = "__piece", "__key", "__carry"


def _cut(df: DataFrame, keys: Sequence[str], chunk: Column, value: Column) -> DataFrame:
    return df.withColumn(_PIECE, F.struct(F.struct(*[F.col(k) for k in keys]).alias("k"), chunk.alias("c"))).withColumn("__v", value)


def _over_pieces(summary: DataFrame, carry: Column) -> DataFrame:
    """``carry`` is evaluated over the pieces of each key in order."""
    out = summary.withColumn(_KEY, F.col(f"{_PIECE}.k")).withColumn("__chunk", F.col(f"{_PIECE}.c"))
    return out.withColumn(_CARRY, carry).select(_PIECE, _CARRY)


def _pieces():
    return Window.partitionBy(_KEY).orderBy("__chunk")


def _before():
    return _pieces().rowsBetween(Window.unboundedPreceding, -1)


def _inside(order: Sequence[str], running: bool = True):
    w = Window.partitionBy(_PIECE).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, 0) if running else w


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
              value: Column, name: str, forward: bool = False) -> DataFrame:
    """Value of the previous (or next) row of the key; ``order`` must be total."""
    df = _cut(df, keys, chunk, F.struct(value.alias("v")))
    shift, edge = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
    ends = df.groupBy(_PIECE).agg(edge("__v", F.struct(*order)).alias("__end"))
    ends = _over_pieces(ends, shift("__end").over(_pieces()))
    out = df.withColumn("__near", shift("__v").over(_inside(order, running=False))).join(ends, _PIECE, "left")
    return out.withColumn(name, F.coalesce("__near", _CARRY)["v"]).drop(_PIECE, _CARRY, "__v", "__near")


_FOLD = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_JOIN = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
            value: Column, name: str, how: str = "sum", whole: bool = False) -> DataFrame:
    """Running sum, count, max or min from the first row of the key to this one.

    ``whole`` says that every key is known to be small: its rows are then scanned in one go, without pieces to sum up and join.
    """
    if whole:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, _JOIN[how](_FOLD[how](value).over(w), F.lit(None)))
    df, fold = _cut(df, keys, chunk, value), _FOLD[how]
    totals = df.groupBy(_PIECE).agg(fold("__v").alias("__t"))
    carry = F.sum("__t") if how == "count" else fold("__t")
    totals = _over_pieces(totals, carry.over(_before()))
    out = df.withColumn("__in", fold("__v").over(_inside(order))).join(totals, _PIECE, "left")
    return out.withColumn(name, _JOIN[how](F.col("__in"), F.col(_CARRY))).drop(_PIECE, _CARRY, "__v", "__in")


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
               value: Column, name: str) -> DataFrame:
    """Latest non-null ``value`` at or before each row: the as-of primitive."""
    df = _cut(df, keys, chunk, value)
    ends = df.groupBy(_PIECE).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__end"))
    ends = _over_pieces(ends, F.last("__end", ignorenulls=True).over(_before()))
    out = df.withColumn("__in", F.last("__v", ignorenulls=True).over(_inside(order))).join(ends, _PIECE, "left")
    return out.withColumn(name, F.coalesce("__in", _CARRY)).drop(_PIECE, _CARRY, "__v", "__in")


def left_join_nullable(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key that is null in many rows.

    Rows with a null key match nothing, but hashing would send them all to one task; they get a
    stand-in key made from a hash of the row, which is in no table.
    """
    spread = F.concat(F.lit("\u0000"), F.hex(F.xxhash64(*left.columns)))
    keyed = left.withColumn("__on", F.coalesce(F.col(key), spread))
    return keyed.join(right.withColumnRenamed(key, "__right"), F.col("__on") == F.col("__right"), "left").drop("__on", "__right")


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1..n over the whole table in ``order`` without gathering it in one task.

    The rows are range partitioned and written once, so the partition a row lies in
    is fixed; the offsets come from one count per partition.
    """
    from callgrove.plans.scratch import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "ordered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (placed.withColumn("__in", inside).join(offsets, "__part")
            .withColumn(name, F.col("__in") + F.col("__off")).drop("__part", "__in", "__off"))
