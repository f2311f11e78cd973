"""Set-at-a-time review: all endpoints of a code base in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.functions.keys import short_hash
from callgrove.operators.prune import dispatch, l1_prune, l3_route
from callgrove.operators.walks import grade_chains, shortest_depths, sink_levels
from callgrove.sources.graph import Graph


def review_endpoints(g: Graph, endpoints: DataFrame, findings: DataFrame, known_annotations: Sequence[str] = ()) -> DataFrame:
    """What to do with each endpoint: pruning rule, route across rounds, methods reached, grade and modes to run.

    Endpoints that every mode skips, or that have a final finding, are cut before the walk.
    ``endpoints(id, endpoint_fqn, priority, ..)`` carries the columns ``l1_prune`` reads.
    """
    judged = l1_prune(endpoints, known_annotations).withColumn("chain_id", short_hash(F.col("endpoint_fqn")))
    judged = l3_route(judged, findings)
    todo = judged.filter((F.size("modes_kept") > 0) & (F.col("route") != "skip"))
    per = grade_chains(g, shortest_depths(g, todo.select("id"), marks=sink_levels(g)), once=True).select(F.col("root").alias("id"), "n_reached", "nearest", "grade")
    modes = dispatch(todo).groupBy("endpoint_fqn").agg(F.sort_array(F.collect_set("mode")).alias("modes"))
    out = judged.join(per, "id", "left").join(modes, "endpoint_fqn", "left")
    return out.select("endpoint_fqn", "chain_id", "rule_id", "route", F.coalesce("n_reached", F.lit(0)).alias("n_reached"),
                      "nearest", F.coalesce("grade", F.lit("none")).alias("grade"),
                      F.coalesce("modes", F.array().cast("array<string>")).alias("modes"))
