"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrove.functions.keys import short_hash
from callgrove.operators import hops, lookup, walks
from callgrove.plans.review import review_endpoints
from callgrove.plans.scratch import materialize
from callgrove.sources.graph import Graph
from callgrove.workload import views as V
from callgrove.workload.registry import Registry

R = Registry()
G = V.GRAPH_SQL
_CALLS = "calls AS (SELECT source, target FROM edges WHERE kind = 'calls')"
_STEPS = ("steps AS (SELECT e.source, e.target FROM edges e JOIN nodes n ON n.id = e.target "
          "WHERE e.kind = 'calls' AND n.kind = 'method')")
_SINK = """CASE WHEN {c} ILIKE '%executeQuery%' THEN 'SQLI' WHEN {c} ILIKE '%exec%' THEN 'RCE'
  WHEN {c} ILIKE '%readObject%' OR {c} ILIKE '%readValue%' THEN 'DESER' WHEN {c} ILIKE '%openConnection%' THEN 'SSRF'
  WHEN {c} ILIKE '%FileInputStream%' OR {c} ILIKE '%Paths.get%' THEN 'PATH_TRAV' WHEN {c} ILIKE '%ldapSearch%' THEN 'LDAP' END"""
_LEVEL = ("CASE WHEN {t} IN ('SQLI','RCE','DESER') THEN 'CRITICAL' WHEN {t} IN ('SSRF','PATH_TRAV') THEN 'HIGH' "
          "WHEN {t} = 'LDAP' THEN 'MEDIUM' END")


def sink_sql(column: str) -> str:
    return _SINK.replace("{c}", column)


# --- lookups ---------------------------------------------------------------------------------------

@R.query("f1_resolve_entries", f"""WITH {G}, names AS (SELECT DISTINCT concat('shop::Customer', c_custkey, '::order', c_custkey) AS qualified_name FROM customer)
  SELECT n.qualified_name, k.id FROM names n LEFT JOIN (SELECT qualified_name, min(id) AS id FROM nodes WHERE kind = 'method' GROUP BY 1) k
  ON k.qualified_name = n.qualified_name""")
def _(spark, d):
    key = F.col("c_custkey").cast("string")
    names = V.table(spark, d, "customer").select(F.concat(F.lit("shop::Customer"), key, F.lit("::order"), key).alias("fqn"))
    return lookup.resolve_entries(V.graph(spark, d), names)


@R.query("f2_find_methods", f"WITH {G} SELECT id, name, qualified_name FROM nodes WHERE kind = 'method' AND name ILIKE '%EXECUTEquery%'")
def _(spark, d):
    return lookup.find_methods(V.graph(spark, d), "EXECUTEquery")


@R.query("f3_routes", f"WITH {G} SELECT id, name, file_path, start_line FROM nodes WHERE kind = 'route'")
def _(spark, d):
    return lookup.routes(V.graph(spark, d))


@R.query("f4_routes_by_verb", f"WITH {G} SELECT id, name, file_path, start_line FROM nodes WHERE kind = 'route' AND name LIKE 'GET %'")
def _(spark, d):
    return lookup.routes_by_verb(V.graph(spark, d), "get")


@R.query("f5_pattern_search", f"""WITH {G} SELECT id, name, qualified_name, file_path, start_line FROM nodes WHERE kind = 'method'
  AND (name ILIKE '%exec%' OR qualified_name ILIKE '%exec%' OR name ILIKE '%runtime%' OR qualified_name ILIKE '%runtime%')""")
def _(spark, d):
    return lookup.pattern_search(V.graph(spark, d), "rce")


def _pattern_count(name, kind, words):
    hit = " OR ".join(f"{c} ILIKE '%{w}%'" for w in words for c in ("name", "qualified_name"))
    return f"SELECT '{name}' AS pattern, count(*) AS hits FROM nodes WHERE kind = '{kind}' AND ({hit})"


@R.query("f5_pattern_counts", f"WITH {G} " + " UNION ALL ".join([
    _pattern_count("sql_injection", "method", ["executeQuery"]), _pattern_count("rce", "method", ["exec", "Runtime"]),
    _pattern_count("deserialize", "method", ["readObject", "readValue"]), _pattern_count("ssrf", "method", ["openConnection"]),
    _pattern_count("path_traversal", "method", ["FileInputStream", "Paths.get"]), _pattern_count("ldap", "method", ["ldapSearch"]),
    _pattern_count("controller_method", "class", ["Controller"])]))
def _(spark, d):
    return lookup.pattern_counts(V.graph(spark, d))


@R.query("f6_segment_match", f"""WITH {G} SELECT id, qualified_name FROM nodes WHERE kind = 'method'
  AND (contains(qualified_name, '::Brand1::') OR ends_with(qualified_name, '::Brand1'))""")
def _(spark, d):
    return lookup.segment_match(V.graph(spark, d).nodes, "Brand1").select("id", "qualified_name")


@R.query("f7_get_method", f"""WITH {G} SELECT id, name, qualified_name, file_path, start_line FROM nodes WHERE kind = 'method'
  AND ends_with(qualified_name, '::Brand1::executeQuery_red_widget')""")
def _(spark, d):
    return lookup.get_method(V.graph(spark, d), "Brand1", "executeQuery_red_widget")


@R.query("f8_skip_packages", f"""WITH {G} SELECT id, qualified_name FROM nodes WHERE NOT (starts_with(qualified_name, 'lib::Brand1')
  OR starts_with(qualified_name, 'shop::Customer1'))""")
def _(spark, d):
    return lookup.skip_packages(V.graph(spark, d).nodes, ["lib::Brand1", "shop::Customer1"]).select("id", "qualified_name")


@R.query("f9_files_flat", f"""WITH {V.FILES_SQL} SELECT path, language, size, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM files
  WHERE starts_with(path, 'docs/en') AND regexp_matches(path, '^docs/en/[^/]*/[^/]*7\\.txt$') AND len(string_split(path, '/')) <= 4""")
def _(spark, d):
    return lookup.files(V.files(spark, d), "docs/en", "docs/en/*/*7.txt", 4)


@R.query("f9_files_grouped", f"""WITH {V.FILES_SQL} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n_files,
  CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1""")
def _(spark, d):
    return lookup.files(V.files(spark, d), fmt="grouped")


@R.query("f9_files_tree", f"""WITH {V.FILES_SQL}, ups AS (SELECT unnest(['docs', 'docs/' || language,
  regexp_extract(path, '^(.*)/[^/]*$', 1), path]) AS node, size FROM files)
  SELECT node, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, CAST(len(string_split(node, '/')) - 1 AS INTEGER) AS level FROM ups GROUP BY node""")
def _(spark, d):
    return lookup.files(V.files(spark, d), fmt="tree")


@R.query("f21_node_detail", f"""WITH {G} SELECT kind, id, name, qualified_name, file_path, start_line FROM nodes
  WHERE (name = 'executeQuery_red_widget' OR qualified_name = 'executeQuery_red_widget') AND ends_with(file_path, '.java')""")
def _(spark, d):
    return lookup.node_detail(V.graph(spark, d), "executeQuery_red_widget", ".java")


@R.query("f22_prefer_source", """SELECT fqn, any_value(view) AS view, any_value(l_suppkey) AS l_suppkey FROM (SELECT concat('p', l_partkey) AS fqn, l_returnflag AS view, l_suppkey,
  row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_returnflag, l_suppkey) AS r FROM lineitem) q
  WHERE r = 1 GROUP BY fqn""")
def _(spark, d):
    copies = V.table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("fqn"),
                                                  F.col("l_returnflag").alias("view"), "l_suppkey")
    return lookup.prefer_source(copies, F.when(F.col("view") == "N", 0).when(F.col("view") == "R", 1).otherwise(2))


# --- joins -----------------------------------------------------------------------------------------

@R.query("j1_route_methods", f"""WITH {G} SELECT r.name AS route, r.id AS route_id, m.name AS handler, m.id AS method_id, m.qualified_name, m.file_path, m.start_line
  FROM nodes r JOIN nodes m ON m.file_path = r.file_path AND m.start_line = r.start_line WHERE r.kind = 'route' AND m.kind = 'method'""")
def _(spark, d):
    return lookup.route_methods(V.graph(spark, d))


def _near(here, there):
    return f"""WITH {G} SELECT e.{here} AS of_id, n.id, n.name, n.qualified_name, n.file_path, n.start_line FROM edges e JOIN nodes n ON n.id = e.{there} WHERE e.kind = 'calls'"""


@R.query("j2_callees", _near("source", "target"))
def _(spark, d):
    return lookup.callees(V.graph(spark, d))


@R.query("j3_callers", _near("target", "source"))
def _(spark, d):
    return lookup.callers(V.graph(spark, d))


# A step is a call with what is known of the called method; a walk is entries followed by steps.
_PLACE = """place AS (SELECT k.file_path AS file, k.qualified_name AS cls, f.name AS field FROM (SELECT * FROM nodes WHERE kind = 'class') k
  LEFT JOIN (SELECT * FROM nodes WHERE kind = 'field') f USING (file_path))"""
_STEP = """target AS (SELECT id, qualified_name AS fqn, file_path AS file, name, decorators FROM nodes WHERE kind = 'method'),
  step AS (SELECT source AS src, target.* FROM edges LEFT JOIN target ON target.id = edges.target WHERE edges.kind = 'calls')"""
_START = """start AS (SELECT m.id, m.qualified_name AS fqn, m.file_path AS file, (SELECT count(*) FROM entries WHERE entries.id = m.id) AS asked, route.name AS route
  FROM nodes m LEFT JOIN (SELECT * FROM nodes WHERE kind = 'route') route USING (file_path, start_line) WHERE m.kind = 'method')"""


def _walk(k, also=""):
    """Joins of ``k`` steps behind start; ``also`` is joined to each step."""
    return "".join(f" LEFT JOIN step h{i} ON h{i}.src = {'start' if i == 1 else f'h{i - 1}'}.id" + also.replace("{h}", f"h{i}").replace("{i}", str(i)) for i in range(1, k + 1))


@R.query("j4_khop_left", f"""WITH {G}, {V.ENTRIES_SQL}, {_STEP}, start AS (SELECT * FROM target WHERE id IN (SELECT id FROM entries))
  SELECT start.fqn AS m0_fqn, h1.fqn AS m1_fqn, h2.fqn AS m2_fqn, h3.fqn AS m3_fqn, h4.fqn AS m4_fqn FROM start{_walk(4)}""")
def _(spark, d):
    g = V.graph(spark, d)
    return hops.khop_left(g, k=4, entries=V.entries(g))


def _forward(k):
    picks = "".join(f", p{i}.cls AS cls{i}_fqn, h{i}.fqn AS m{i}_fqn" for i in range(1, k + 1))
    return f"""WITH {G}, {V.ENTRIES_SQL}, {_STEP}, {_START}, {_PLACE}, owner AS (SELECT DISTINCT file, cls FROM place),
  caller AS (SELECT edges.target AS id, target.fqn FROM edges LEFT JOIN target ON target.id = edges.source WHERE edges.kind = 'calls')
  SELECT start.fqn AS m0_fqn, start.route AS route_name, place.cls AS cls0_fqn, caller.fqn AS caller0_fqn, place.field AS field_name{picks}
  FROM start LEFT JOIN place ON place.file = start.file LEFT JOIN caller ON caller.id = start.id{_walk(k, " LEFT JOIN owner p{i} ON p{i}.file = {h}.file")} WHERE asked > 0"""


@R.query("j5_forward_5hop", _forward(5))
def _(spark, d):
    g = V.graph(spark, d)
    return hops.forward_5hop(g, entries=V.entries(g))


@R.query("j8_forward_4hop", _forward(4) + " ORDER BY m0_fqn, route_name, cls0_fqn, caller0_fqn, field_name, m1_fqn NULLS FIRST, cls1_fqn NULLS FIRST, "
         "m2_fqn NULLS FIRST, cls2_fqn NULLS FIRST, m3_fqn NULLS FIRST, cls3_fqn NULLS FIRST, m4_fqn NULLS FIRST, cls4_fqn NULLS FIRST LIMIT 1000")
def _(spark, d):
    g = V.graph(spark, d)
    return hops.forward_4hop(g, entries=V.entries(g), limit=1000)


_MULTI = f"""{_STEP}, {_START}, {_PLACE}, multi AS (SELECT start.fqn AS ep_fqn, start.route AS route_name, h1.fqn AS m1_fqn, h2.fqn AS sink_fqn, owner.cls AS sink_cls, {sink_sql('h2.name')} AS sink_type
  FROM start{_walk(2)} LEFT JOIN (SELECT DISTINCT file, cls FROM place) owner ON owner.file = h2.file WHERE asked > 0 AND sink_type IS NOT NULL)"""
_ENT1 = V.ENTRIES_SQL.replace("SELECT m.id", "SELECT DISTINCT m.id")


@R.query("j6_multi_sink", f"WITH {G}, {_ENT1}, {_MULTI} SELECT * FROM multi")
def _(spark, d):
    g = V.graph(spark, d)
    return hops.multi_sink(g, entries=V.entries(g))


@R.query("j7_auth_context", f"""WITH {G}, {_ENT1}, {_STEP}, {_START}, {_PLACE}, holder AS (SELECT target AS id, source FROM edges WHERE kind = 'contains')
  SELECT start.fqn AS ep_fqn, start.route AS route_name, h1.fqn AS biz_fqn, array_to_string(h1.decorators, ',') AS biz_anno, p1.field AS biz_field, c1.source AS biz_class,
  h2.fqn AS dao_fqn, array_to_string(h2.decorators, ',') AS dao_anno, p2.field AS dao_field, c2.source AS dao_class
  FROM start{_walk(2, " LEFT JOIN place p{i} ON p{i}.file = {h}.file LEFT JOIN holder c{i} ON c{i}.id = {h}.id")} WHERE asked > 0""")
def _(spark, d):
    g = V.graph(spark, d)
    out = hops.auth_context(g, entries=V.entries(g))
    return out.withColumns({c: F.array_join(c, ",") for c in ("biz_anno", "dao_anno")})


@R.query("j9_sqli_auth", f"""WITH {G}, {_ENT1}, {_MULTI}, anno AS (SELECT DISTINCT qualified_name, decorators FROM nodes WHERE kind = 'method')
  SELECT ep_fqn, route_name, m1_fqn, sink_fqn, sink_cls, sink_type, array_to_string(a.decorators, ',') AS ep_anno, array_to_string(b.decorators, ',') AS biz_anno,
  coalesce(contains(array_to_string(a.decorators, ','), 'PreAuthorize'), false) OR coalesce(contains(array_to_string(b.decorators, ','), 'PreAuthorize'), false) AS authenticated
  FROM multi LEFT JOIN anno a ON a.qualified_name = ep_fqn LEFT JOIN anno b ON b.qualified_name = m1_fqn WHERE sink_type = 'SQLI'""")
def _(spark, d):
    g = V.graph(spark, d)
    out = hops.sqli_auth(g, entries=V.entries(g))
    return out.withColumns({c: F.array_join(c, ",") for c in ("ep_anno", "biz_anno")})


@R.query("j11_controller_routes", f"""WITH {G} SELECT c.name AS class_name, m.name AS method, m.file_path, m.start_line, r.name AS route FROM nodes c
  JOIN edges e ON e.source = c.id AND e.kind = 'contains' JOIN nodes m ON m.id = e.target AND m.kind = 'method'
  LEFT JOIN nodes r ON r.kind = 'route' AND r.file_path = m.file_path AND r.start_line = m.start_line WHERE c.kind = 'class' AND contains(c.name, 'Customer')""")
def _(spark, d):
    return lookup.controller_routes(V.graph(spark, d), "Customer")


def _side(here, there, label):
    return f"""{label} AS (SELECT {here} AS id, count(*) AS n FROM calls GROUP BY 1), {label}_top AS (
  SELECT id, string_agg(other, ',' ORDER BY other) AS names FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) AS r
  FROM (SELECT DISTINCT {here} AS id, {there} AS other FROM calls) a) b WHERE r <= 20 GROUP BY id)"""


@R.query("j26_trail", f"WITH {G}, {_CALLS}, {_side('target', 'source', 'callers')}, {_side('source', 'target', 'callees')}" + """,
  rt AS (SELECT file_path, start_line, min(name) AS route FROM nodes WHERE kind = 'route' GROUP BY 1, 2)
  SELECT m.id, m.qualified_name, rt.route, coalesce(a.n, 0) AS n_callers, coalesce(b.n, 0) AS n_callees,
  coalesce(ta.names, '') AS callers, coalesce(tb.names, '') AS callees
  FROM nodes m LEFT JOIN callers a ON a.id = m.id LEFT JOIN callees b ON b.id = m.id LEFT JOIN callers_top ta ON ta.id = m.id
  LEFT JOIN callees_top tb ON tb.id = m.id LEFT JOIN rt ON rt.file_path = m.file_path AND rt.start_line = m.start_line WHERE m.kind = 'method'""")
def _(spark, d):
    out = lookup.trail(V.graph(spark, d))
    return out.withColumns({c: F.array_join(c, ",") for c in ("callers", "callees")})


@R.query("a26_blast_radius", f"""WITH {G}, x AS (SELECT e.target, e.kind, n.name, n.file_path FROM edges e JOIN nodes n ON n.id = e.source),
  heads AS (SELECT target, count(*) FILTER (kind = 'calls') AS n_callers, bool_or(kind = 'calls' AND regexp_matches(file_path, 'Customer[0-9]*9')) AS tested FROM x GROUP BY 1),
  byk AS (SELECT target, kind, count(*) AS n FROM x GROUP BY 1, 2),
  top AS (SELECT target, kind, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT target, kind, name, row_number() OVER (PARTITION BY target, kind ORDER BY name) AS r
    FROM (SELECT DISTINCT target, kind, name FROM x) a) b WHERE r <= 5 GROUP BY 1, 2)
  SELECT b.target, b.kind, b.n, t.names || CASE WHEN b.n > 5 THEN ' and ' || (b.n - 5) || ' more' ELSE '' END AS relations, h.n_callers, h.tested
  FROM byk b JOIN top t ON t.target = b.target AND t.kind = b.kind JOIN heads h ON h.target = b.target""")
def _(spark, d):
    return lookup.blast_radius(V.graph(spark, d), r"Customer[0-9]*9")


@R.query("u6_resolve_body", f"""WITH {G}, req AS (SELECT l_orderkey * 10 + l_linenumber AS req_id, concat('m', l_orderkey + l_partkey) AS want_id,
  concat('order', l_orderkey + 2 * l_partkey) AS want_name, concat('shop/Customer', l_suppkey, '.java') AS want_file, CAST(1 AS INTEGER) AS want_line FROM lineitem),
  rq AS (SELECT req_id, min(want_id) AS want_id, min(want_name) AS want_name, min(want_file) AS want_file, min(want_line) AS want_line FROM req GROUP BY 1),
  a AS (SELECT req_id, id AS node_id, 1 AS via FROM rq JOIN nodes ON id = want_id),
  b AS (SELECT req_id, n.id AS node_id, 2 AS via FROM rq JOIN (SELECT name, min(id) AS id FROM nodes GROUP BY 1) n ON n.name = want_name),
  c AS (SELECT req_id, n.id AS node_id, 3 AS via FROM rq JOIN (SELECT file_path, start_line, min(id) AS id FROM nodes GROUP BY 1, 2) n ON n.file_path = want_file AND n.start_line = want_line),
  f AS (SELECT req_id, node_id, via, row_number() OVER (PARTITION BY req_id ORDER BY via, node_id) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) u)
  SELECT rq.req_id, f.node_id, CAST(coalesce(f.via, 0) AS INTEGER) AS via FROM rq LEFT JOIN f ON f.req_id = rq.req_id AND f.r = 1""")
def _(spark, d):
    text = lambda c: c.cast("string")
    li = V.table(spark, d, "lineitem")
    req = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("req_id"),
                    F.concat(F.lit("m"), text(F.col("l_orderkey") + F.col("l_partkey"))).alias("want_id"),
                    F.concat(F.lit("order"), text(F.col("l_orderkey") + 2 * F.col("l_partkey"))).alias("want_name"),
                    F.concat(F.lit("shop/Customer"), text(F.col("l_suppkey")), F.lit(".java")).alias("want_file"), F.lit(1).alias("want_line"))
    req = req.groupBy("req_id").agg(*[F.min(c).alias(c) for c in ("want_id", "want_name", "want_file", "want_line")])
    return lookup.resolve_body(req, V.graph(spark, d).nodes)


# --- recursion -------------------------------------------------------------------------------------

def _chain_sql(here, there, seeds):
    return f"""{_CALLS}, steps AS (SELECT c.{here} AS src, c.{there} AS dst FROM calls c JOIN nodes n ON n.id = c.{there} WHERE n.kind = 'method'),
  seeds AS ({seeds}), chain(root, id, path, depth) AS (SELECT id, id, [id], 0 FROM seeds UNION ALL
  SELECT c.root, s.dst, list_append(c.path, s.dst), c.depth + 1 FROM chain c JOIN steps s ON s.src = c.id
  WHERE c.depth < 20 AND NOT list_contains(c.path, s.dst))"""


_FWD = f"{_ENT1}, {_chain_sql('source', 'target', 'SELECT DISTINCT id FROM entries')}"
_BACK = _chain_sql("target", "source", f"SELECT id FROM nodes WHERE kind = 'method' AND {sink_sql('name')} = 'SQLI'")


def forward(spark, d, **how):
    g = V.graph(spark, d)
    return g, walks.forward_chain(g, V.entries(g), **how)


@R.query("g1_forward_chain", f"WITH RECURSIVE {G}, {_FWD} SELECT c.root, c.id, array_to_string(c.path, '|') AS path, CAST(c.depth AS INTEGER) AS depth, "
         "n.qualified_name, n.file_path, n.start_line FROM chain c JOIN nodes n ON n.id = c.id")
def _(spark, d):
    return forward(spark, d, names=True)[1].withColumn("path", F.array_join("path", "|"))


@R.query("g2_reverse_chain", f"WITH RECURSIVE {G}, {_BACK} SELECT root, id, array_to_string(path, '|') AS path, CAST(depth AS INTEGER) AS depth FROM chain")
def _(spark, d):
    g = V.graph(spark, d)
    seeds = g.methods.filter(lookup.sink_type(F.col("name")) == "SQLI")
    return walks.reverse_chain(g, seeds).withColumn("path", F.array_join("path", "|"))


@R.query("g3_impact", f"""WITH {G}, arcs AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
  z AS (SELECT id AS root, id FROM nodes WHERE kind = 'class' AND starts_with(id, 'c')), one AS (SELECT DISTINCT z.root, a.b AS id FROM z JOIN arcs a ON a.a = z.id),
  two AS (SELECT DISTINCT o.root, a.b AS id FROM one o JOIN arcs a ON a.a = o.id),
  alls AS (SELECT root, id, 0 AS depth FROM z UNION ALL SELECT root, id, 1 FROM one UNION ALL SELECT root, id, 2 FROM two)
  SELECT root, id, CAST(min(depth) AS INTEGER) AS depth FROM alls GROUP BY 1, 2""")
def _(spark, d):
    g = V.graph(spark, d)
    return walks.impact(g, g.classes.filter(F.col("id").startswith("c")), 2)


@R.query("j22_impact_refresh", f"""WITH {G}, synced AS (SELECT source, target FROM edges WHERE NOT (kind = 'calls' AND line = 3 AND TRY_CAST(substr(source, 2) AS BIGINT) % 20 = 0)
    UNION ALL SELECT concat('m', o_orderkey), concat('p', o_orderkey % 50 + 1) FROM orders WHERE o_orderkey % 20 = 5), arcs AS (SELECT source AS a, target AS b FROM synced UNION SELECT target, source FROM synced),
  z AS (SELECT id AS root, id FROM nodes WHERE kind = 'class' AND starts_with(id, 'c')), one AS (SELECT DISTINCT z.root, a.b AS id FROM z JOIN arcs a ON a.a = z.id),
  two AS (SELECT DISTINCT o.root, a.b AS id FROM one o JOIN arcs a ON a.a = o.id),
  alls AS (SELECT root, id, 0 AS depth FROM z UNION ALL SELECT root, id, 1 FROM one UNION ALL SELECT root, id, 2 FROM two)
  SELECT root, id, CAST(min(depth) AS INTEGER) AS depth FROM alls GROUP BY 1, 2""")
def _(spark, d):
    """Some orders lose a call and some get one; the refreshed rows must be those of a run from scratch."""
    g = V.graph(spark, d)
    g = Graph(g.nodes, materialize(g.edges, "edges"), g.files)
    seeds = g.classes.filter(F.col("id").startswith("c"))
    order = F.when(F.col("kind") == "calls", F.substring("source", 2, 20).cast("bigint"))
    lost = g.edges.filter(~F.coalesce((order % 20 == 0) & (F.col("line") == 3), F.lit(False)))
    key = F.col("o_orderkey")
    orders = V.table(spark, d, "orders")
    made = orders.filter(key % 20 == 5).select(F.concat(F.lit("m"), key.cast("string")).alias("source"), F.concat(F.lit("p"), (key % 50 + 1).cast("string")).alias("target"),
                                               F.lit("calls").alias("kind"), F.lit(9).alias("line"))
    after = Graph(g.nodes, lost.unionByName(made), g.files)
    changed = orders.filter((key % 20).isin(0, 5)).select(F.concat(F.lit("shop/Customer"), F.col("o_custkey").cast("string"), F.lit(".java")).alias("path"))
    return walks.refresh_impact(walks.impact(g, seeds, 2), g, after, changed, seeds, 2)


@R.query("u4_impacted_nodes", f"""WITH {G}, z AS (SELECT id FROM nodes WHERE kind = 'class' AND starts_with(id, 'b')), arcs AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
  one AS (SELECT a.b AS id FROM z JOIN arcs a ON a.a = z.id), two AS (SELECT a.b AS id FROM one JOIN arcs a ON a.a = one.id) SELECT id FROM z UNION SELECT id FROM one UNION SELECT id FROM two""")
def _(spark, d):
    g = V.graph(spark, d)
    return walks.impact(g, g.classes.filter(F.col("id").startswith("b")), 2).select("id").distinct()


@R.query("k2_limit_per_node", _near("target", "source").replace("n.start_line FROM", "n.start_line, CAST(row_number() OVER (PARTITION BY e.target ORDER BY n.file_path, n.start_line, n.id) AS INTEGER) AS rank FROM")
         + " QUALIFY rank <= 3")
def _(spark, d):
    return lookup.callers(V.graph(spark, d), limit=3)


_FILE_ARCS = """arcs AS (SELECT DISTINCT t.file_path AS a, s.file_path AS b FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target
  WHERE e.kind <> 'contains' AND s.file_path <> t.file_path)"""


@R.query("g4_affected_tests", f"""WITH RECURSIVE {G}, {_FILE_ARCS}, reach(path, depth) AS (SELECT DISTINCT file_path, 0 FROM nodes WHERE kind = 'class' AND starts_with(file_path, 'lib/')
  UNION SELECT a.b, r.depth + 1 FROM reach r JOIN arcs a ON a.a = r.path WHERE r.depth < 5)
  SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM reach WHERE regexp_matches(path, '[13579][.]java$') GROUP BY 1""")
def _(spark, d):
    g = V.graph(spark, d)
    changed = g.classes.filter(F.col("file_path").startswith("lib/")).select(F.col("file_path").alias("path"))
    return walks.affected_tests(g, changed, 5, r"[13579][.]java$")


@R.query("g5_taint_bfs", f"""WITH RECURSIVE {G}, {_ENT1}, {_CALLS}, verdicts AS (SELECT concat('m', o_orderkey) AS id, 'safe' AS verdict FROM orders WHERE o_orderpriority = '5-LOW'),
  arcs AS (SELECT DISTINCT target AS a, source AS b FROM calls WHERE target NOT IN (SELECT id FROM verdicts) AND target NOT IN (SELECT id FROM entries)),
  reach(id, layer) AS (SELECT id, 0 FROM nodes WHERE kind = 'method' AND {sink_sql('name')} = 'RCE' UNION
  SELECT a.b, r.layer + 1 FROM reach r JOIN arcs a ON a.a = r.id WHERE r.layer < 20), best AS (SELECT id, min(layer) AS layer FROM reach GROUP BY 1)
  SELECT b.id, CAST(b.layer AS INTEGER) AS layer, v.verdict, CASE WHEN v.verdict IS NOT NULL THEN 'stopped' WHEN b.id IN (SELECT id FROM entries) THEN 'entry'
  WHEN b.id NOT IN (SELECT target FROM calls) THEN 'source' ELSE 'pass' END AS status FROM best b LEFT JOIN verdicts v ON v.id = b.id""")
def _(spark, d):
    g = V.graph(spark, d)
    sinks = g.methods.filter(lookup.sink_type(F.col("name")) == "RCE").select("id")
    verdicts = V.table(spark, d, "orders").filter("o_orderpriority = '5-LOW'").select(
        F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("safe").alias("verdict"))
    return walks.taint_bfs(g, sinks, verdicts)


@R.query("g6_chain_summary", f"""WITH RECURSIVE {G}, {_FWD}, per AS (SELECT root, count(*) AS n_rows, max(depth) AS max_depth FROM chain GROUP BY 1)
  SELECT e.fqn, p.root IS NOT NULL AS found, coalesce(p.n_rows, 0) AS n_rows, CAST(coalesce(p.max_depth, 0) AS INTEGER) AS max_depth
  FROM (SELECT id, fqn FROM entries UNION ALL SELECT NULL, 'shop::Nowhere::lost') e LEFT JOIN per p ON p.root = e.id""")
def _(spark, d):
    g, chain = forward(spark, d)
    lost = spark.sql("SELECT CAST(NULL AS STRING) AS id, 'shop::Nowhere::lost' AS fqn")
    return walks.chain_summary(chain, V.entries(g).distinct().unionByName(lost))


@R.query("k7_longest_chain", f"""WITH RECURSIVE {G}, {_FWD}, per AS (SELECT e.fqn, count(*) AS n_rows, max(depth) AS max_depth FROM chain c JOIN entries e ON e.id = c.root GROUP BY 1)
  SELECT fqn, CAST(max_depth AS INTEGER) AS max_depth, n_rows FROM per ORDER BY max_depth DESC, n_rows DESC, fqn LIMIT 1""")
def _(spark, d):
    g, chain = forward(spark, d)
    return walks.longest_chain(walks.chain_summary(chain, V.entries(g).distinct()))


@R.query("g7_grade_chains", f"""WITH RECURSIVE {G}, {_FWD}, s AS (SELECT c.root, c.id, c.depth, {sink_sql('n.name')} AS t FROM chain c JOIN nodes n ON n.id = c.id),
  p AS (SELECT root, count(DISTINCT id) AS n_reached, min(depth) FILTER (t IS NOT NULL) AS nearest, count(*) FILTER (t IN ('SQLI','RCE','DESER','SSRF','PATH_TRAV')) AS bad FROM s GROUP BY 1)
  SELECT root, n_reached, CAST(nearest AS INTEGER) AS nearest, CASE WHEN bad > 0 THEN 'high' WHEN nearest IS NOT NULL THEN 'low' ELSE 'none' END AS grade, bad > 0 AS verify FROM p""")
def _(spark, d):
    g = V.graph(spark, d)
    return walks.grade_chains(g, walks.shortest_depths(g, V.entries(g), marks=walks.sink_levels(g)), once=True)


@R.query("a12_method_sink_counts", f"""WITH RECURSIVE {G}, {_FWD}, s AS (SELECT c.root, {_LEVEL.replace('{t}', sink_sql('n.name'))} AS lv FROM chain c JOIN nodes n ON n.id = c.id)
  SELECT root, count(*) AS n_chains, count(*) FILTER (lv = 'CRITICAL') AS n_critical, count(*) FILTER (lv = 'HIGH') AS n_high, count(*) FILTER (lv = 'MEDIUM') AS n_medium FROM s GROUP BY 1""")
def _(spark, d):
    return walks.method_sink_counts(*forward(spark, d, marks=walks.sink_levels(V.graph(spark, d))))


@R.query("g8_depth_flags", f"""WITH RECURSIVE {G}, {_FWD}, f AS (SELECT root, CASE WHEN depth >= 20 THEN 'limit' WHEN depth > 15 THEN 'warning' ELSE 'ok' END AS depth_flag FROM chain)
  SELECT root, depth_flag, count(*) AS n FROM f GROUP BY 1, 2""")
def _(spark, d):
    flagged = walks.depth_flags(forward(spark, d)[1])
    return flagged.groupBy("root", "depth_flag").agg(F.count(F.lit(1)).alias("n"))


@R.query("k8_min_depth", f"WITH RECURSIVE {G}, {_FWD} SELECT root, id, CAST(min(depth) AS INTEGER) AS depth FROM chain GROUP BY 1, 2")
def _(spark, d):
    g = V.graph(spark, d)
    return walks.shortest_depths(g, V.entries(g))


@R.query("g9_chain_by_name", f"""WITH RECURSIVE {G}, {_ENT1}, {_CALLS}, arcs AS (SELECT DISTINCT s.name AS a, t.name AS b FROM calls c JOIN nodes s ON s.id = c.source AND s.kind = 'method'
  JOIN nodes t ON t.id = c.target AND t.kind = 'method'), reach(name, depth) AS (SELECT n.name, 0 FROM nodes n JOIN entries e ON e.id = n.id UNION
  SELECT a.b, r.depth + 1 FROM reach r JOIN arcs a ON a.a = r.name WHERE r.depth < 20) SELECT name, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY 1""")
def _(spark, d):
    g = V.graph(spark, d)
    return walks.chain_by_name(g, V.entries(g))


_SKIP = "o_totalprice > 250000 AND o_orderpriority = '1-URGENT'"


@R.query("review_endpoints", f"""WITH RECURSIVE {G}, ep AS (SELECT 'm' || o_orderkey AS id, concat('shop::Customer', o_custkey, '::order', o_orderkey) AS fqn, o_orderpriority AS pr, {_SKIP} AS done FROM orders WHERE o_orderstatus = 'O'),
  {_chain_sql('source', 'target', "SELECT id FROM ep WHERE pr <> '5-LOW' AND NOT done")},
  s AS (SELECT c.root, c.id, c.depth, {sink_sql('n.name')} AS t FROM chain c JOIN nodes n ON n.id = c.id),
  p AS (SELECT root, count(DISTINCT id) AS n_reached, min(depth) FILTER (t IS NOT NULL) AS nearest, count(*) FILTER (t IN ('SQLI','RCE','DESER','SSRF','PATH_TRAV')) AS bad, count(t) AS anyt FROM s GROUP BY 1)
  SELECT fqn AS endpoint_fqn, left(sha256(fqn), 16) AS chain_id, CASE WHEN pr = '5-LOW' THEN 'P-L1-001' WHEN pr = '2-HIGH' THEN 'P-L1-002' END AS rule_id, CASE WHEN done THEN 'skip' ELSE 'new' END AS route,
  coalesce(n_reached, 0) AS n_reached, CAST(nearest AS INTEGER) AS nearest, CASE WHEN bad > 0 THEN 'high' WHEN anyt > 0 THEN 'low' ELSE 'none' END AS grade,
  CASE WHEN pr = '5-LOW' OR done THEN '' WHEN pr = '2-HIGH' THEN 'C,D' ELSE 'A,B,C,D,INFO' END AS modes FROM ep LEFT JOIN p ON p.root = ep.id""")
def _(spark, d):
    fqn = F.concat(F.lit("shop::Customer"), F.col("o_custkey").cast("string"), F.lit("::order"), F.col("o_orderkey").cast("string"))
    param = lambda kind: F.array(F.struct(F.lit("p").alias("name"), F.lit(kind).alias("type")))
    orders = V.table(spark, d, "orders").filter("o_orderstatus = 'O'")
    params = (F.when(F.col("o_orderpriority") == "2-HIGH", param("int")).when(F.col("o_orderpriority") == "5-LOW", F.slice(param("int"), 1, 0)).otherwise(param("String")))
    eps = orders.select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("id"), fqn.alias("endpoint_fqn"), F.lit("/x").alias("path"), params.alias("params"),
                        F.array().cast("array<string>").alias("annotations"), F.lit(True).alias("permit_all"), F.lit(False).alias("filter_covered"), F.lit(False).alias("internal_network"),
                        F.lit("P0").alias("priority"))
    done = orders.filter(_SKIP).select(short_hash(fqn).alias("chain_id"), F.lit("final").alias("status"))
    return review_endpoints(V.graph(spark, d), eps, done).withColumn("modes", F.array_join("modes", ","))
