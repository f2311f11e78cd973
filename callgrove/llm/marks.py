"""A bitmap of fixed size that tells most rows of a large table apart from a set of ids before anything is shuffled.

Each id sets one of ``BITS`` bits.  The bitmap is a table of at most ``BITS`` / 64 = 262,144 words of 64 bits,
however many ids there are, so it may be broadcast.  A row that is not marked has none of the ids; a marked
row may have one, and a join on the marked rows decides.  When nearly all bits are set all rows are marked:
the join then sees the whole table and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.plans.scratch import materialize

BITS = 1 << 24


def mark(df: DataFrame, ids: DataFrame, key: str, name: str = "__marked") -> DataFrame:
    """``df`` with a boolean column ``name``: false only where no row of ``ids`` has the same ``key``; null keys are not marked."""
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))
    words = ids.where(F.col(key).isNotNull()).select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("__word"))
    words = materialize(words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("__bits")), "marks")
    rows = df.withColumn("__bit", bit).withColumn("__word", F.shiftright("__bit", 6)).join(F.broadcast(words), "__word", "left")
    hit = F.col("__bits").bitwiseAND(F.expr("shiftleft(1L, CAST(__bit % 64 AS INT))")) != 0
    return rows.withColumn(name, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("__bit", "__word", "__bits")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in no row of ``ids``; only marked rows are joined, null keys stay."""
    rows = mark(df, ids, key)
    sure, open_ = rows.where("NOT __marked").drop("__marked"), rows.where("__marked").drop("__marked")
    return sure.select(*df.columns).unionAll(open_.join(ids, key, "left_anti").select(*df.columns))
