"""Structural rules over range-annotated syntax nodes: position, containment and order.

Nodes carry ``id, file, start, end``.  Containment is decided by a running extreme over the
nodes of a file in source order, so no pair of nodes is ever formed.

A relation may be given a stop rule, as the nodes that match it: the search ends at the first of them, which may
itself be the one sought.  For containment the ranges must be nested, as those of a syntax tree are, and hold at
least one character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.plans.chunked import neighbour, running

SPAN = 500
BLOCK = 128  # lines
WHOLE = 100_000  # nodes of a file that one task may scan


def enclosing_method(points: DataFrame, methods: DataFrame) -> DataFrame:
    """Innermost method around each ``(file, line)``.

    Methods and points meet by equi join on blocks of lines, and only the innermost method of a line is
    kept.  Methods whose end lies before their start hold no line; one that ends far beyond its file is laid
    out only up to the file's last point.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK)
    spots = points.select("file", "line").distinct()
    m = methods.select("id", F.col("file_path").alias("file"), "start_line", "end_line").filter("start_line <= end_line")
    m = m.join(spots.groupBy("file").agg(F.min("line").alias("lo"), F.max("line").alias("hi")), "file").filter("start_line <= hi AND end_line >= lo")
    m = m.withColumn("a", F.greatest("start_line", "lo")).withColumn("b", F.least("end_line", "hi"))
    laid = m.select("file", F.explode(F.sequence(block("a"), block("b"))).alias("block"), "start_line", "end_line",
                    F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("late"), "id").alias("m"))
    near = laid.join(spots.withColumn("block", block("line")), ["file", "block"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    inner = near.groupBy("file", "line").agg(F.min("m").alias("m"))
    return points.join(inner, ["file", "line"], "left").withColumn("method_id", F.col("m.id")).drop("m")


def rule_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(F.col("kind") == kind)


def rule_regex(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(F.col("text").rlike(pattern))


def rule_range(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.filter((F.col("start") >= start) & (F.col("end") <= end))


def sibling_ranks(df: DataFrame, reverse: bool = False) -> DataFrame:
    """Position 1.. of each node among the children of its parent, in source order."""
    rank = running(df, ["parent"], ["start", "id"], F.floor(F.col("start") / SPAN), F.lit(1), "nth", "count")
    if reverse:
        sizes = df.groupBy("parent").agg(F.count(F.lit(1)).alias("of"))
        rank = rank.join(sizes, "parent").withColumn("nth", F.col("of") - F.col("nth") + 1).drop("of")
    return rank


def rule_nth(df: DataFrame, a: int, b: int, reverse: bool = False) -> DataFrame:
    """Children at positions ``a*n + b`` for n = 0, 1, ..; ``a = 0`` picks the one at ``b``."""
    at = F.col("nth") - b
    hit = at == 0 if a == 0 else (at % a == 0) & (at / a >= 0)
    return sibling_ranks(df, reverse).filter(hit)


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    tag = lambda df, mine: df.select("id", "file", "start", "end", F.lit(mine).alias("mine"))
    return tag(a, True).unionByName(tag(b, False))


def _from_merged(a: DataFrame, hits: DataFrame) -> DataFrame:
    return a.join(hits.filter("mine").select("id"), "id", "left_semi")


def _small(*parts: DataFrame) -> bool:
    """Whether every file has so few nodes that it need not be cut into pieces."""
    sizes = reduce(DataFrame.unionAll, [p.select("file") for p in parts]).groupBy("file").count()
    return (sizes.agg(F.max("count")).first()[0] or 0) <= WHOLE


def _among(a: DataFrame, b: DataFrame, stop: DataFrame, own: bool, whole: bool) -> DataFrame:
    """The rows of ``_merged`` with ``around``, the number of stops around a node.

    A node and one around it have the same number if no stop lies between them; ``own`` counts stops of the
    own range for nodes of ``a``, else for those of ``b``.  A stop begins to count where it starts and no longer does where it
    ends, so the number is a running sum over the file.
    """
    at = lambda rows, pos, back, turn, mine, step: rows.select(
        "id", "file", "start", "end", F.col(pos).alias("pos"), back.alias("back"), F.lit(turn).alias("turn"), F.lit(mine).cast("boolean").alias("mine"), F.lit(step).alias("step"))
    stop = stop.filter("start < end")
    rows = at(a, "start", -F.col("end"), 2 if own else 0, True, 0).unionByName(at(b, "start", -F.col("end"), 0 if own else 2, False, 0))
    first = F.lit(None).cast(rows.schema["back"].dataType)  # what ends at a place does so before others start there
    rows = rows.unionByName(at(stop, "start", -F.col("end"), 1, None, 1)).unionByName(at(stop, "end", first, 1, None, -1))
    seen = running(rows, ["file"], ["pos", "back", "turn", "step"], F.floor(F.col("pos") / SPAN), F.col("step"), "around", "sum", whole)
    return seen.filter("mine IS NOT NULL").select("id", "file", "around", "start", "end", "mine")


def _until(a: DataFrame, b: DataFrame, stop: DataFrame | None, own: bool) -> tuple[DataFrame, list[str], bool]:
    """Nodes of both sides, the columns that only nodes of one search share, and whether their files are small."""
    if stop is None:
        return _merged(a, b), ["file"], False
    whole = _small(a, b, stop, stop)
    return _among(a, b, stop, own, whole), ["file", "around"], whole


def rel_inside(a: DataFrame, b: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Nodes of ``a`` whose range lies properly within a node of ``b`` of the same file, with no node of ``stop`` between them."""
    rows, keys, whole = _until(a, b, stop, False)
    rows = rows.withColumn("back", -F.col("end")).withColumn("last", ~F.col("mine"))
    seen = running(rows, keys, ["start", "back", "last", "id"], F.floor(F.col("start") / SPAN),
                   F.when(~F.col("mine"), F.col("end")), "reach", "max", whole)
    return _from_merged(a, seen.filter(F.col("reach") >= F.col("end")))


def rel_has(a: DataFrame, b: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Nodes of ``a`` that properly contain a node of ``b``, with no node of ``stop`` between them."""
    rows, keys, whole = _until(a, b, stop, True)
    rows = rows.withColumn("back", -F.col("start")).withColumn("last", ~F.col("mine"))
    seen = running(rows, keys, ["back", "end", "last", "id"], -F.floor(F.col("start") / SPAN),
                   F.when(~F.col("mine"), F.col("end")), "reach", "min", whole)
    return _from_merged(a, seen.filter(F.col("reach") <= F.col("end")))


def rel_inside_neighbor(a: DataFrame, b: DataFrame, field: str | None = None) -> DataFrame:
    """Nodes of ``a`` whose parent is a node of ``b``; ``field`` asks that they stand in that field of it."""
    a = a if field is None else a.filter(F.col("field") == field)
    return a.join(b.select(F.col("id").alias("__up")), F.col("parent") == F.col("__up"), "left_semi")


def rel_has_neighbor(a: DataFrame, b: DataFrame, field: str | None = None) -> DataFrame:
    """Nodes of ``a`` of which a node of ``b`` is a child; ``field`` asks that it stands in that field."""
    b = b if field is None else b.filter(F.col("field") == field)
    return a.join(b.select(F.col("parent").alias("__up")), F.col("id") == F.col("__up"), "left_semi")


def _behind(a: DataFrame, b: DataFrame, stop: DataFrame) -> DataFrame:
    """Ids of nodes of ``a`` behind a node of ``b`` with no stop between: the last end of a ``b`` lies behind the last start of a stop."""
    none = F.lit(None).cast(b.schema["end"].dataType)
    at = lambda df, pos, edge, begun, mine: df.select("id", "file", F.col(pos).alias("pos"), edge.alias("edge"), begun.alias("begun"), F.lit(mine).alias("mine"))
    rows = at(a, "start", none, none, True).unionByName(at(b, "end", F.col("end"), none, False)).unionByName(at(stop, "end", none, F.col("start"), False))
    chunk, whole = F.floor(F.col("pos") / SPAN), _small(a, b, stop)
    for value, name in (("edge", "last_end"), ("begun", "last_start")):
        rows = running(rows, ["file"], ["pos", "mine", "id", "edge", "begun"], chunk, F.col(value), name, "max", whole)
    return rows.filter("mine AND last_end IS NOT NULL AND NOT coalesce(last_start >= last_end, false)").select("id")


def rel_follows(a: DataFrame, b: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Nodes of ``a`` that start at or after the end of some node of ``b``, with no node of ``stop`` between them."""
    if stop is not None:
        return a.join(_behind(a, b, stop), "id", "left_semi")
    first = b.groupBy("file").agg(F.min("end").alias("edge"))
    return a.join(first, "file").filter(F.col("start") >= F.col("edge")).drop("edge")


def rel_precedes(a: DataFrame, b: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Nodes of ``a`` that end at or before the start of some node of ``b``, with no node of ``stop`` between them."""
    if stop is not None:
        turned = [df.select("id", "file", (-F.col("end")).alias("start"), (-F.col("start")).alias("end")) for df in (a, b, stop)]
        return a.join(_behind(*turned), "id", "left_semi")
    last = b.groupBy("file").agg(F.max("start").alias("edge"))
    return a.join(last, "file").filter(F.col("end") <= F.col("edge")).drop("edge")


def rel_next_to(df: DataFrame, kind: str, other: str, after: bool = True) -> DataFrame:
    """Neighbour form: nodes of ``kind`` directly after (or before) a sibling of kind ``other``."""
    near = neighbour(df, ["parent"], ["start", "id"], F.floor(F.col("start") / SPAN), F.col("kind"), "near", forward=not after)
    return near.filter((F.col("kind") == kind) & (F.col("near") == other)).drop("near")


def rule_all(*hits: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.join(y.select("id"), "id", "left_semi"), hits)


def rule_any(*hits: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), hits).distinct()


def rule_not(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    return nodes.join(hits.select("id"), "id", "left_anti")
