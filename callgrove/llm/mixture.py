"""Mixing sources to target weights over a tree of domains, languages and sources.

The budget is handed down the tree level by level.  At each node it is shared among the children in
proportion to their weights; a child that cannot use its share, because its texts repeated ``epochs`` times
hold fewer tokens, keeps what it can and the rest goes to its siblings.  A node's own capacity is the sum of
its leaves', so a shortage leaves the node only when all siblings below it are full.

A leaf reads its texts in the order of a seeded hash that differs in each epoch: whole epochs first, then a
prefix of the next one up to its number of tokens.  The prefix is found from sums over 4096 hash ranges per
leaf and an exact order inside one range only, so no leaf is sorted as a whole.

All amounts are whole numbers and shares are compared by cross products, so equal input gives equal output.

Defined results: a null level is a child of its own; null and empty texts have no tokens and are not
selected; texts of any length count in full; equal texts and ids are told apart by nothing, so rows that
repeat one id and size at the cut share what is left equally, rounded down; children without a stated
weight get ``other``; children of weight 0 get nothing; a budget above all capacity takes everything; an
empty table gives an empty table.  Columns of ``df`` named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.plans.scratch import materialize

LEVELS = ("domain", "lang", "source")
#: Weights per level: child name to a whole number.
WEIGHTS = {"domain": {"long": 3, "short": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}


def count_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def with_domain(df: DataFrame, text: str = "text", long: int = 300) -> DataFrame:
    """Adds n_tokens and domain, long or short form by number of words, for tables without a domain of their own."""
    df = df.withColumn("n_tokens", count_words(text))
    return df.withColumn("domain", F.when(F.col("n_tokens") >= long, "long").otherwise("short"))


def _share(nodes: DataFrame, parent: Sequence[str], budget: Column) -> DataFrame:
    """Adds ``given``, the share of ``budget`` (the amount at the parent), to nodes with name, cap and w.

    Children stand in order of capacity by weight.  A child is full if its share of what those before it
    leave reaches its capacity; these come first.  The others divide the rest by weight, and the single
    tokens left by rounding go to the first of them.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), "name")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    nodes = nodes.where("w > 0 AND cap > 0").withColumn("budget", budget)
    nodes = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    nodes = nodes.withColumn("weights", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    nodes = nodes.withColumn("full", F.expr("cap * weights <= left * w"))
    nodes = nodes.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    nodes = nodes.withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(whole))
    nodes = nodes.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("rest * w div open")))
    nodes = nodes.withColumn("spare", F.col("budget") - F.sum("part").over(whole))
    nth = F.row_number().over(Window.partitionBy(*parent, "full").orderBy(F.col("cap") / F.col("w"), "name"))
    nodes = nodes.withColumn("given", F.col("part") + F.when(~F.col("full") & (nth <= F.col("spare")), 1).otherwise(0))
    return nodes.select(*parent, "name", "given")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: dict[str, dict[str, int]], budget: int, other: int = 1) -> DataFrame:
    """``given`` tokens of each leaf; ``leaves`` has the levels and cap, the tokens that the leaf can give."""
    done = None
    for i, level in enumerate(levels):
        above = list(levels[:i])
        known = [F.lit(x) for pair in weights.get(level, {}).items() for x in pair]
        nodes = leaves.groupBy(*above, F.col(level).alias("name")).agg(F.sum("cap").alias("cap"))
        stated = F.element_at(F.create_map(*known), F.col("name")) if known else F.lit(None)
        nodes = nodes.withColumn("w", F.coalesce(stated, F.lit(other)).cast("bigint"))
        if done is not None:
            nodes = nodes.join(done.withColumnRenamed("given", "amount"), above)
        done = _share(nodes, above, F.lit(budget).cast("bigint") if done is None else F.col("amount")).withColumnRenamed("name", level)
    return done


def order_key(seed: int, epoch: Column, key: Column, n_tokens: Column) -> Column:
    """Place of a text in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")), n_tokens.cast("string")).cast("binary"))


def _cuts(slim: DataFrame, plan: DataFrame, levels: list[str], seed: int) -> DataFrame:
    """Where the prefix of the last epoch ends: the leaf, the last text's place ``cut`` and the tokens it gives, ``each``."""
    rows = slim.join(plan.where("rest > 0"), levels)
    rows = rows.withColumn("place", order_key(seed, F.col("whole") + 1, F.col("id"), F.col("n_tokens"))).withColumn("range", F.substring("place", 1, 3))

    def crossing(sums: DataFrame, at: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy(*levels).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
        return sums.withColumn("upto", upto).where("upto >= rest AND upto - n < rest")

    ranges = rows.groupBy(*levels, "range").agg(F.sum("n_tokens").alias("n"), F.any_value("rest").alias("rest"))
    ranges = crossing(ranges, "range").select(*levels, "range", (F.col("rest") - F.col("upto") + F.col("n")).alias("inner"))
    ranges = materialize(ranges, "ranges")
    inside = rows.drop("rest").join(ranges, [*levels, "range"]).groupBy(*levels, "place").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("m"), F.any_value("inner").alias("rest"))
    found = crossing(inside, "place").withColumn("each", F.expr("(rest - upto + n) div m"))
    return found.select(*levels, F.col("place").alias("cut"), "each")


def mix_sources(df: DataFrame, percent: int = 50, epochs: int = 4, seed: int = 11, levels: Sequence[str] = LEVELS,
                weights: dict[str, dict[str, int]] = WEIGHTS, other: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mixture as one row per selected text and epoch: columns of ``df``, epoch (from 1) and taken_tokens.

    ``df`` has n_tokens and the levels; the budget is ``percent`` of all its tokens.  A text that the end of
    a prefix runs through is cut there.
    """
    levels = list(levels)
    names = [f"__{x}" for x in levels]
    stated = {f"__{k}": v for k, v in weights.items()}
    df = df.drop("epoch", "taken_tokens")
    named = df.withColumns({n: F.coalesce(F.col(x).cast("string"), F.lit("")) for n, x in zip(names, levels, strict=True)})
    slim = named.where("n_tokens > 0").select(*names, F.col(key).alias("id"), "n_tokens")
    slim = materialize(slim, "sizes")
    leaves = materialize(slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * F.lit(epochs)), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = budgets(leaves, names, stated, total * percent // 100, other)
    plan = leaves.join(given, names).select(*names, F.expr("given div tokens").alias("whole"), F.expr("given % tokens").alias("rest"))
    plan = materialize(plan, "plan")
    plan = plan.select(*names, "whole", "rest").join(_cuts(slim, plan, names, seed), names, "left")
    plan = materialize(plan.select(*names, F.col("whole").alias("__whole"), F.col("cut").alias("__cut"), F.col("each").alias("__each")), "cuts")
    rows = named.where("n_tokens > 0").join(plan, names)
    place = order_key(seed, F.col("__whole") + 1, F.col(key), F.col("n_tokens"))
    last = F.when(place < F.col("__cut"), F.col("n_tokens")).when(place == F.col("__cut"), F.least("__each", "n_tokens")).otherwise(0)
    rows = rows.withColumn("__last", F.coalesce(last, F.lit(0)))
    many = F.col("__whole") + F.when(F.col("__last") > 0, 1).otherwise(0)
    rows = rows.where(many > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), many)))
    rows = rows.withColumn("taken_tokens", F.when(F.col("epoch") <= F.col("__whole"), F.col("n_tokens")).otherwise(F.col("__last")))
    if text in df.columns:
        pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
        cut = F.array_join(F.slice(pieces, F.lit(1), F.col("taken_tokens").cast("int")), "")
        rows = rows.withColumn(text, F.when(F.col("taken_tokens") < F.col("n_tokens"), cut).otherwise(F.col(text)))
    return rows.select(*df.columns, "epoch", "taken_tokens")
