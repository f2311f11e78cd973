"""Counts that describe a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.functions.java import module_prefix
from callgrove.sources.graph import Graph


def profile(g: Graph) -> DataFrame:
    """Nodes, edges, routes, methods, calls and decorated nodes: one pass over each table."""
    kind = F.col("kind")
    n = g.nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(kind == "route").alias("n_routes"), F.count_if(kind == "method").alias("n_methods"),
                    F.count_if(F.size(F.coalesce("decorators", F.array().cast("array<string>"))) > 0).alias("n_decorated"))
    e = g.edges.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(kind == "calls").alias("c")).alias("s")).scalar()
    return n.withColumn("e", e).select("n_nodes", F.col("e.n").alias("n_edges"), "n_routes", "n_methods", F.col("e.c").alias("n_calls"), "n_decorated")


def kind_counts(g: Graph) -> DataFrame:
    """Nodes by kind, edges by kind, files by language."""
    count = lambda df, scope, c: df.groupBy(F.lit(scope).alias("scope"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = count(g.nodes, "node", "kind").unionAll(count(g.edges, "edge", "kind"))
    return out if g.files is None else out.unionAll(count(g.files, "language", "language"))


def risk_breakdown(endpoints: DataFrame) -> DataFrame:
    """Endpoints by risk."""
    return endpoints.groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


def endpoint_sinks(endpoints: DataFrame, sinks: DataFrame) -> DataFrame:
    """Endpoints and sinks per module, both with a ``file``; modules without a sink count zero."""
    per = lambda df, n: df.groupBy(module_prefix(F.col("file")).alias("module")).agg(F.count(F.lit(1)).alias(n))
    return per(endpoints, "n_endpoints").join(per(sinks, "n_sinks"), "module", "left").na.fill(0, ["n_sinks"])
