"""Fixed multi-hop joins: walks without a cycle guard, context attached at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.operators.lookup import sink_type
from callgrove.plans.chunked import left_join_nullable
from callgrove.plans.scratch import materialize, materialize_by
from callgrove.sources.graph import Graph


def _entries(g: Graph, fqn: str | None, entries: DataFrame | None) -> DataFrame:
    m = g.methods.select(F.col("id").alias("m0"), F.col("qualified_name").alias("m0_fqn"),
                         F.col("file_path").alias("m0_file"), F.col("start_line").alias("m0_line"))
    if fqn is not None:
        return m.filter(F.col("m0_fqn") == fqn)
    return m if entries is None else m.join(entries.select(F.col("id").alias("m0")).distinct(), "m0", "left_semi")


def _steps(calls: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Call edges with what ``known(step_id, ..)`` holds of the called method, and the ids that call anything.

    What is known of a method is gathered before, so it is joined to the calls once; an edge to a non-method keeps a null
    target.  ``on`` marks targets that call in turn.  Every hop takes the same step, so the steps are written once, in
    buckets of the caller.
    """
    e = calls.filter("source IS NOT NULL")
    callers = materialize(e.select(F.col("source").alias("caller")).distinct(), "callers")
    known = known.join(callers.select(F.col("caller").alias("step_id"), F.lit(True).alias("on")), "step_id", "left")
    return materialize_by(e.join(known, e["target"] == known["step_id"], "left").drop("target"), "hop_steps", ["source"]), callers


def _walk(rows: DataFrame, steps: DataFrame, callers: DataFrame, k: int, **names: str) -> DataFrame:
    """``rows`` with an id ``m0`` and up to ``k`` calls behind it, null where a walk ended before.

    Most calls lead to a node without calls.  Only walks that go on travel from hop to hop and are written by hop; the calls that
    end a walk are joined to all of them at once, when the result is read.
    """
    base = [c for c in rows.columns if c != "m0"]
    if not k:
        return rows.drop("m0")
    rows = rows.join(callers.withColumnRenamed("caller", "m0").withColumn("on", F.lit(True)), "m0", "left")
    rows = materialize(rows, "hop")
    silent = rows.filter("on IS NULL").drop("on", "m0")
    onward = steps.filter("on").select("source", "step_id", *names)
    last = rows.filter("on").drop("on").withColumnRenamed("m0", "at")
    levels = last.withColumn("hop", F.lit(1))
    for hop in range(1, k):
        taken = [F.col(c).alias(n.format(hop)) for c, n in names.items()]
        last = last.join(onward, F.col("at") == F.col("source")).select(
            F.col("step_id").alias("at"), *[c for c in last.columns if c != "at"], *taken)
        last = materialize(last, "hop")
        levels = levels.unionByName(last.withColumn("hop", F.lit(hop + 1)), allowMissingColumns=True)
    ended = levels.join(steps, (F.col("at") == F.col("source")) & (F.col("on").isNull() | (F.col("hop") == k)))
    held = lambda h, c, n: F.when(F.col("hop") == h, F.col(c)).otherwise(F.col(n)) if n in levels.columns else F.when(F.col("hop") == h, F.col(c))
    ended = ended.select(*base, *[held(h, c, n.format(h)).alias(n.format(h)) for h in range(1, k + 1) for c, n in names.items()])
    return ended.unionByName(silent, allowMissingColumns=True)


def khop_left(g: Graph, fqn: str | None = None, k: int = 4, entries: DataFrame | None = None) -> DataFrame:
    """One row per walk of up to ``k`` calls, names of every hop."""
    start = _entries(g, fqn, entries).select("m0", "m0_fqn")
    steps, callers = _steps(materialize(g.calls, "calls"), g.methods.select(F.col("id").alias("step_id"), "qualified_name"))
    out = _walk(start, steps, callers, k, qualified_name="m{}_fqn")
    return out.select(*[f"m{h}_fqn" for h in range(k + 1)])


def forward_context(g: Graph, fqn: str | None = None, k: int = 5, entries: DataFrame | None = None,
                    limit: int | None = None) -> DataFrame:
    """Walks of ``k`` calls with route, class, caller and class field of the entry and the class of each hop."""
    cls = g.classes.select("file_path", F.col("qualified_name").alias("cls_fqn"))
    start = materialize(_entries(g, fqn, entries), "starts")
    r = g.routes.select(F.col("file_path").alias("m0_file"), F.col("start_line").alias("m0_line"), F.col("name").alias("route_name"))
    context = start.join(r, ["m0_file", "m0_line"], "left")
    fld = g.of_kind("field").select("file_path", F.col("name").alias("field_name"))
    own = cls.join(fld, "file_path", "left").select(F.col("file_path").alias("m0_file"), F.col("cls_fqn").alias("cls0_fqn"), "field_name")
    context = context.join(own, "m0_file", "left")
    calls = materialize(g.calls, "calls")
    callers = calls.select(F.col("target").alias("m0"), F.col("source").alias("__c")).join(start.select("m0"), "m0", "left_semi")
    named = g.methods.select(F.col("id").alias("__c"), F.col("qualified_name").alias("caller0_fqn"))
    context = context.join(callers.join(named, "__c", "left").drop("__c"), "m0", "left").drop("m0_file", "m0_line")
    known = left_join_nullable(g.methods.select(F.col("id").alias("step_id"), "qualified_name", "file_path"), cls, "file_path").drop("file_path")
    steps, calling = _steps(calls, known)
    out = _walk(start.select("m0").join(context, "m0"), steps, calling, k, qualified_name="m{}_fqn", cls_fqn="cls{}_fqn")
    names = ["m0_fqn", "route_name", "cls0_fqn", "caller0_fqn", "field_name",
             *[c for h in range(1, k + 1) for c in (f"m{h}_fqn", f"cls{h}_fqn")]]
    out = out.select(*names)
    return out if limit is None else out.orderBy(*names).limit(limit)


def forward_5hop(g: Graph, fqn: str | None = None, entries: DataFrame | None = None) -> DataFrame:
    return forward_context(g, fqn, 5, entries)


def forward_4hop(g: Graph, fqn: str | None = None, entries: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Four calls deep, all walks or the first ``limit`` in order (the published report has 1,000)."""
    return forward_context(g, fqn, 4, entries, limit)


def multi_sink(g: Graph, fqn: str | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Entry, one hop, then a sink; the sink filter is applied before any join."""
    sink_name = F.col("name")
    sinks = (g.methods.withColumn("sink_type", sink_type(sink_name)).filter(F.col("sink_type").isNotNull())
             .select(F.col("id").alias("sink"), F.col("qualified_name").alias("sink_fqn"), "sink_type", F.col("file_path").alias("sink_file")))
    cls = g.classes.select(F.col("file_path").alias("sink_file"), F.col("qualified_name").alias("sink_cls"))
    second = g.calls.select(F.col("source").alias("m1"), F.col("target").alias("sink")).join(sinks, "sink")
    second = second.join(cls, "sink_file", "left")
    first = g.calls.select(F.col("source").alias("m0"), F.col("target").alias("m1"))
    first = first.join(g.methods.select(F.col("id").alias("m1"), F.col("qualified_name").alias("m1_fqn")), "m1")
    ep = _entries(g, fqn, entries)
    r = g.routes.select(F.col("file_path").alias("m0_file"), F.col("start_line").alias("m0_line"), F.col("name").alias("route_name"))
    ep = ep.join(r, ["m0_file", "m0_line"], "left")
    return (ep.join(first, "m0").join(second, "m1")
            .select(F.col("m0_fqn").alias("ep_fqn"), "route_name", "m1_fqn", "sink_fqn", "sink_cls", "sink_type"))


def auth_context(g: Graph, fqn: str | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Entry, two hops, and for each hop its decorators, class fields and container."""
    fields = g.of_kind("field").select("file_path", F.col("name").alias("field"))
    cls = g.classes.select("file_path").join(fields, "file_path", "left")
    held = g.edges_of("contains").select(F.col("target").alias("step_id"), F.col("source").alias("container"))
    ep = _entries(g, fqn, entries)
    r = g.routes.select(F.col("file_path").alias("m0_file"), F.col("start_line").alias("m0_line"), F.col("name").alias("route_name"))
    out = ep.join(r, ["m0_file", "m0_line"], "left")
    known = g.methods.select(F.col("id").alias("step_id"), "qualified_name", "file_path", "decorators")
    known = left_join_nullable(left_join_nullable(known, cls, "file_path").drop("file_path"), held, "step_id")
    steps, callers = _steps(materialize(g.calls, "calls"), known)
    out = _walk(out.select("m0", "m0_fqn", "route_name"), steps, callers, 2,
                qualified_name="m{}_fqn", decorators="m{}_anno", field="f{}", container="in{}")
    return out.select(F.col("m0_fqn").alias("ep_fqn"), "route_name",
                      F.col("m1_fqn").alias("biz_fqn"), F.col("m1_anno").alias("biz_anno"), F.col("f1").alias("biz_field"), F.col("in1").alias("biz_class"),
                      F.col("m2_fqn").alias("dao_fqn"), F.col("m2_anno").alias("dao_anno"), F.col("f2").alias("dao_field"), F.col("in2").alias("dao_class"))


def sqli_auth(g: Graph, fqn: str | None = None, entries: DataFrame | None = None) -> DataFrame:
    """SQL sinks two calls below an entry together with the decorators on the way."""
    hits = multi_sink(g, fqn, entries).filter(F.col("sink_type") == "SQLI")
    anno = g.methods.select("qualified_name", "decorators")
    for column, name in (("ep_fqn", "ep_anno"), ("m1_fqn", "biz_anno")):
        hits = hits.join(anno.select(F.col("qualified_name").alias(column), F.col("decorators").alias(name)).distinct(), column, "left")
    guarded = lambda c: F.coalesce(F.exists(c, lambda d: d.rlike("PreAuthorize|Secured|RolesAllowed|RequiresPermissions")), F.lit(False))
    return hits.withColumn("authenticated", guarded("ep_anno") | guarded("biz_anno"))
