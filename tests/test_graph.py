"""The eight-node fixture graph with hand-derived results."""

import random
import time

import pytest
from pyspark.sql import functions as F

from callgrove.operators import hops, lookup, walks
from callgrove.operators.profile import kind_counts, profile
from callgrove.operators.structure import enclosing_method
from callgrove.plans.scratch import SHUFFLE_CLEANUP, LevelTable, materialize
from callgrove.sources.graph import Graph, read_graph, typed_edges, typed_nodes


def names(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_resolve_entry(graph, spark):
    assert names(lookup.resolve_entry(graph, "pkg::C::m")) == ["m:entry"]
    asked = spark.createDataFrame([("pkg::C::m",), ("pkg::No::x",)], "fqn string")
    got = {r["qualified_name"]: r["id"] for r in lookup.resolve_entries(graph, asked).collect()}
    assert got == {"pkg::C::m": "m:entry", "pkg::No::x": None}


def test_pattern_search(graph):
    assert "executeQuery" in names(lookup.pattern_search(graph, "sql_injection"), "name")
    assert any("Runtime" in q for q in names(lookup.pattern_search(graph, "rce"), "qualified_name"))
    with pytest.raises(ValueError):
        lookup.pattern_search(graph, "xss")
    counts = {r["pattern"]: r["hits"] for r in lookup.pattern_counts(graph).collect()}
    assert counts["sql_injection"] == 1 and counts["rce"] == 2 and counts["controller_method"] == 1


def test_like_ignores_case(graph):
    assert names(lookup.find_methods(graph, "EXECUTEQUERY")) == ["m:2"]


@pytest.mark.parametrize("qn,cls,hit", [
    ("pkg::User::get", "User", True), ("pkg::UserService::get", "User", False), ("pkg::a::User", "User", True),
    ("pkg::MyUser::get", "User", False), ("User::get", "User", False)])
def test_class_segment(spark, qn, cls, hit):
    df = spark.createDataFrame([("method", qn)], "kind string, qualified_name string")
    assert (lookup.segment_match(df, cls).count() == 1) is hit


def test_routes_and_neighbours(graph):
    r = lookup.route_methods(graph).collect()
    assert [(x["route"], x["handler"]) for x in r] == [("GET /api/u", "listUsers")]
    assert names(lookup.callees(graph, "m:1")) == ["m:1", "m:2"]
    assert names(lookup.callers(graph, "m:1")) == ["m:1", "m:entry"]
    assert lookup.callees(graph, "m:1", limit=1).count() == 1
    assert names(lookup.routes(graph)) == ["r:1"] and names(lookup.routes_by_verb(graph, "get")) == ["r:1"]
    assert names(lookup.get_method(graph, "Dao", "executeQuery")) == ["m:2"]


def test_forward_chain(graph, ids):
    strict = walks.forward_chain(graph, ids("m:entry"))
    assert sorted((r["id"], r["depth"]) for r in strict.collect()) == [("m:1", 1), ("m:2", 2), ("m:3", 3), ("m:entry", 0)]
    ref = walks.forward_chain(graph, ids("m:entry"), cycle="ref")
    assert sorted(r["depth"] for r in ref.collect()) == [0, 1, 2, 2, 3, 3, 4]
    assert walks.forward_chain(graph, ids("m:1")).count() == 3
    assert walks.forward_chain(graph, ids("m:1"), cycle="ref").count() == 6
    assert walks.forward_chain(graph, ids("m:entry"), max_depth=1).count() == 2
    with pytest.raises(ValueError):
        walks.forward_chain(graph, ids("m:entry"), cycle="other")


def test_recursive_sql_gives_the_same_chain(graph, ids):
    rows = lambda df: sorted((r["root"], r["id"], tuple(r["path"]), r["depth"]) for r in df.collect())
    seeds = ids("m:entry", "m:1", "c:1")
    assert rows(walks.forward_chain_sql(graph, seeds)) == rows(walks.forward_chain(graph, seeds))


@pytest.mark.parametrize("cycle", ["strict", "ref"])
def test_large_graphs_take_the_shuffle_form_with_equal_rows(graph, ids, monkeypatch, cycle):
    rows = lambda: sorted((r["root"], r["id"], tuple(r["path"]), r["depth"]) for r in walks.forward_chain(graph, ids("m:entry", "m:1"), cycle=cycle).collect())
    fused = rows()
    monkeypatch.setattr(walks, "BROADCAST_BYTES", 0)
    assert rows() == fused


def test_paths_that_end_stay_out_of_the_loop(graph, ids, monkeypatch):
    monkeypatch.setattr(walks, "BROADCAST_BYTES", 0)
    written, append = [], walks.LevelTable.append
    monkeypatch.setattr(walks.LevelTable, "append", lambda *a: written.append(append(*a)) or written[-1])
    chain = walks.forward_chain(graph, ids("m:entry"))
    assert names(chain) == ["m:1", "m:2", "m:3", "m:entry"] and sum(written) == 3  # m:3 calls nothing
    plain = sorted(tuple(r) for r in walks.with_names(graph, chain).select("id", "depth", *walks.NAMES).collect())
    assert sorted(tuple(r) for r in walks.forward_chain(graph, ids("m:entry"), names=True).select("id", "depth", *walks.NAMES).collect()) == plain


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 20])
def test_shortest_depths_are_those_of_the_paths(graph, ids, depth):
    rows = lambda df: sorted((r["root"], r["id"], r["depth"]) for r in df.collect())
    seeds = ids("m:entry", "m:2", "m:3", "c:1")
    assert rows(walks.shortest_depths(graph, seeds, depth)) == rows(walks.min_depth(walks.forward_chain(graph, seeds, depth)))


def test_reached_rows_are_met_where_they_lie(spark, monkeypatch):
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = walks.BucketTable(spark, "reached", ["root", "id"])
        some = lambda n: spark.range(n).selectExpr("CAST(id % 7 AS STRING) AS root", "CAST(id AS STRING) AS id")
        assert [table.append(some(n)) for n in (10, 5)] == [10, 5] and table.rows().count() == 15
        new = some(20).distinct().join(table.rows(), ["root", "id"], "left_anti")
        assert new.count() == 10
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
    return {f for f in files.split("|") if "shuffle_" in f}


def test_written_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    level = LevelTable(spark, "level")
    for step in (0, 1):
        level.append(spark.range(50).repartition(3, "id"), step)
    table = walks.materialize_by(materialize(spark.range(100).repartition(3, "id"), "plain"), "table", ["id"])
    until = time.time() + 10
    while (left := [f for f in _shuffle_files(spark) - before if f.endswith(".data")]) and time.time() < until:
        time.sleep(0.1)
    assert not left and level.rows().count() == 100 == table.count()
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Joins as on tables too large to be broadcast."""
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(walks, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def _moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_paths_of_large_graphs_do_not_move_once_they_are_written(graph, ids, shuffled):
    back = walks.reverse_chain(graph, ids("m:3", "m:2"))
    assert _moves(back) == [] and names(back) == ["m:1", "m:1", "m:2", "m:2", "m:3", "m:entry", "m:entry"]


def test_named_paths_of_large_graphs_do_not_move_either(graph, ids, shuffled):
    chain = walks.forward_chain(graph, ids("m:entry", "m:3", "c:1"), names=True)
    assert _moves(chain) == []
    rows = lambda df: sorted((r["root"], r["id"], r["depth"], r["qualified_name"], r["file_path"], r["start_line"]) for r in df.collect())
    assert rows(chain) == rows(walks.with_names(graph, walks.forward_chain(graph, ids("m:entry", "m:3", "c:1"))))


@pytest.fixture
def odd_graph(spark):
    """Sinks on the way and at the end, ids with several methods, methods that only call what is no method."""
    r = random.Random(7)
    kinds = ["executeQuery", "RuntimeExec", "openConnection", "ldapSearch", "render", "render"]
    nodes = [(f"n{i % 26}", "method" if i % 9 else "class", kinds[r.randrange(6)], f"q{i}", "x.java", i, i) for i in range(40)]
    edges = [(f"n{r.randrange(18)}", r.choice([None, *(f"n{i}" for i in range(28))]), "calls", 1) for _ in range(34)]
    return Graph(spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int"),
                 spark.createDataFrame(edges, "source string, target string, kind string, line int"))


@pytest.mark.parametrize("depth", [0, 1, 2, 7])
def test_marked_walks_give_the_counts_and_grades_of_plain_ones(odd_graph, ids, shuffled, depth):
    g, seeds = odd_graph, ids(*(f"n{i}" for i in range(0, 26, 2)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    marks, plain = walks.sink_levels(g), walks.forward_chain(g, seeds, depth)
    want = walks.grade_chains(g, plain)
    assert rows(walks.method_sink_counts(g, walks.forward_chain(g, seeds, depth, marks=marks))) == rows(walks.method_sink_counts(g, plain))
    assert rows(walks.grade_chains(g, walks.shortest_depths(g, seeds, depth, marks), once=True)) == rows(want)
    assert rows(walks.grade_chains(g, walks.shortest_depths(g, seeds, depth))) == rows(want) == rows(walks.grade_chains(g, walks.forward_chain(g, seeds, depth, marks=marks)))


def test_sinks_are_counted_without_moving_paths_by_node(odd_graph, ids, shuffled):
    out = walks.method_sink_counts(odd_graph, walks.forward_chain(odd_graph, ids("n2", "n4"), marks=walks.sink_levels(odd_graph)))
    assert [m for m in _moves(out) if "root" in m and "id#" in m] == []


def test_reached_pairs_move_once_to_be_graded(odd_graph, ids, shuffled):
    out = walks.grade_chains(odd_graph, walks.shortest_depths(odd_graph, ids("n2", "n4"), marks=walks.sink_levels(odd_graph)), once=True)
    assert len([m for m in _moves(out) if "root" in m and "piece" in m]) == 1 and not [m for m in _moves(out) if "root" in m and "id#" in m]


def test_review(spark, graph):
    from callgrove.plans.review import review_endpoints
    eps = spark.sql("""SELECT 'm:entry' AS id, 'pkg::C::m' AS endpoint_fqn, '/api/u' AS path, array(struct('q' AS name, 'String' AS type)) AS params, array('@GetMapping') AS annotations,
        true AS permit_all, false AS filter_covered, false AS internal_network, 'P0' AS priority UNION ALL
        SELECT 'm:1', 'pkg::S::m', '/x', CAST(array() AS array<struct<name:string,type:string>>), array('@GetMapping'), true, false, false, 'P0'""")
    none = spark.createDataFrame([], "chain_id string, status string")
    got = {r["endpoint_fqn"]: r for r in review_endpoints(graph, eps, none, ["@GetMapping"]).collect()}
    a, b = got["pkg::C::m"], got["pkg::S::m"]
    assert (a["route"], a["n_reached"], a["nearest"], a["grade"], a["modes"]) == ("new", 4, 2, "high", ["A", "B", "C", "D", "INFO"])
    assert (b["rule_id"], b["n_reached"], b["grade"], b["modes"]) == ("P-L1-001", 0, "none", [])


def test_reverse_chain(graph, ids):
    got = walks.reverse_chain(graph, ids("m:3"))
    assert sorted((r["depth"], r["id"]) for r in got.collect()) == [(0, "m:3"), (1, "m:2"), (2, "m:1"), (3, "m:entry")]


def test_parallel_edges_are_paths(spark, graph, ids):
    from callgrove.sources.graph import Graph
    twice = graph.edges.unionAll(graph.edges.filter("target = 'm:3'"))
    assert walks.forward_chain(Graph(graph.nodes, twice), ids("m:2")).count() == 3


def test_impact(graph, ids):
    one = walks.impact(graph, ids("m:2"), 1).filter("depth > 0")
    assert names(one) == ["m:1", "m:3"]
    assert set(names(walks.impact(graph, ids("m:2"), 2))) == {"m:1", "m:2", "m:3", "m:entry", "c:2"}


def test_multi_hop(graph):
    assert hops.khop_left(graph, "pkg::C::m", 4).count() == 4  # walks, no guard: the self-loop is taken again
    five = hops.forward_5hop(graph, "pkg::C::m")
    assert five.count() == 5 and "field_name" in five.columns
    assert hops.forward_4hop(graph, "pkg::C::m", limit=2).count() == 2
    (sink,) = hops.multi_sink(graph, "pkg::C::m").collect()
    assert (sink["sink_fqn"], sink["sink_type"], sink["sink_cls"]) == ("pkg::Dao::executeQuery", "SQLI", None)
    auth = hops.auth_context(graph, "pkg::C::m")
    assert sorted(r["dao_fqn"] for r in auth.collect()) == ["pkg::Dao::executeQuery", "pkg::S::m"]
    (hit,) = hops.sqli_auth(graph, "pkg::C::m").collect()
    assert hit["authenticated"] is False


def test_hop_form_equals_the_plain_sql(graph, spark):
    joins = "".join(f" LEFT JOIN {{edges}} e{h} ON e{h}.source = m{h - 1}.id AND e{h}.kind = 'calls' LEFT JOIN {{nodes}} m{h} ON m{h}.id = e{h}.target AND m{h}.kind = 'method'" for h in range(1, 5))
    sql = f"SELECT {', '.join(f'm{h}.qualified_name AS q{h}' for h in range(5))} FROM {{nodes}} m0{joins} WHERE m0.kind = 'method'"
    assert sql.count("LEFT JOIN") == 8
    plain = spark.sql(sql, nodes=graph.nodes, edges=graph.edges)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(hops.khop_left(graph, k=4)) == key(plain)


def test_summary_and_grades(spark, graph, ids):
    chain = walks.forward_chain(graph, ids("m:entry", "m:2"))
    asked = spark.createDataFrame([("m:entry", "pkg::C::m"), ("m:2", "pkg::Dao::executeQuery"), (None, "pkg::No::x")], "id string, fqn string")
    got = {r["fqn"]: (r["found"], r["n_rows"], r["max_depth"]) for r in walks.chain_summary(chain, asked).collect()}
    assert got == {"pkg::C::m": (True, 4, 3), "pkg::Dao::executeQuery": (True, 2, 1), "pkg::No::x": (False, 0, 0)}
    assert walks.longest_chain(walks.chain_summary(chain, asked)).first()["fqn"] == "pkg::C::m"
    assert {r["grade"] for r in walks.grade_chains(graph, chain).collect()} == {"high"}
    flags = walks.depth_flags(chain.withColumn("depth", F.lit(16))).select("depth_flag").distinct().collect()
    assert [r[0] for r in flags] == ["warning"]


def test_taint_walk(spark, graph, ids):
    none = spark.createDataFrame([], "id string, verdict string")
    free = {r["id"]: (r["layer"], r["status"]) for r in walks.taint_bfs(graph, ids("m:3"), none).collect()}
    assert free == {"m:3": (0, "pass"), "m:2": (1, "pass"), "m:1": (2, "pass"), "m:entry": (3, "entry")}
    stop = spark.createDataFrame([("m:2", "n")], "id string, verdict string")
    assert sorted(r["id"] for r in walks.taint_bfs(graph, ids("m:3"), stop).collect()) == ["m:2", "m:3"]


def test_dependent_files(spark, graph):
    changed = spark.createDataFrame([("Dao.java",)], "path string")
    got = {r["path"]: r["depth"] for r in walks.dependent_files(graph, changed).collect()}
    assert got == {"Dao.java": 0, "Service.java": 1, "Controller.java": 2}
    assert names(walks.affected_tests(graph, changed, test_regex="Contr"), "path") == ["Controller.java"]


def test_enclosing_method_picks_the_innermost(spark, graph):
    points = spark.createDataFrame([("Service.java", 12), ("Service.java", 99), ("Nope.java", 1)], "file string, line int")
    got = {(r["file"], r["line"]): r["method_id"] for r in enclosing_method(points, graph.methods).collect()}
    assert got == {("Service.java", 12): "m:1", ("Service.java", 99): None, ("Nope.java", 1): None}


def test_profile_and_counts(graph):
    p = profile(graph).first().asDict()
    assert p == {"n_nodes": 8, "n_edges": 6, "n_routes": 1, "n_methods": 4, "n_calls": 4, "n_decorated": 1}
    assert kind_counts(graph).filter("scope = 'node' AND value = 'method'").first()["n"] == 4


def test_chain_by_name_contains_the_id_walk(graph, ids):
    by_id = walks.with_names(graph, walks.forward_chain(graph, ids("m:entry"))).join(graph.nodes.select("id", "name"), "id")
    by_name = walks.chain_by_name(graph, ids("m:entry"))
    assert set(names(by_id, "name")) <= set(names(by_name, "name"))


def test_graph_round_trip_and_raw_types(spark, tmp_path):
    raw = spark.createDataFrame([("a", 1, 0, 0, 1, '["@A"]', None, 1700000000000)],
                                "id string, is_exported int, is_async int, is_static int, is_abstract int, decorators string, type_parameters string, updated_at long")
    row = typed_nodes(raw).first()
    assert row["is_exported"] is True and row["decorators"] == ["@A"] and row["updated_at"].year == 2023
    edge = typed_edges(spark.createDataFrame([('{"k": "v"}',)], "metadata string")).first()
    assert edge["metadata"] == {"k": "v"}
    for name in ("nodes", "edges", "files"):
        from callgrove.schemas import schema
        spark.createDataFrame([], schema(name)).write.parquet(f"{tmp_path}/{name}")
    assert read_graph(spark, str(tmp_path)).nodes.count() == 0


def test_files_tree_and_trail(graph, spark):
    df = spark.createDataFrame([("a/b/x.java", "java", 3), ("a/y.py", "py", 4)], "path string, language string, size long")
    assert names(lookup.files(df, "a", "a/**/*.java"), "path") == ["a/b/x.java"]
    assert names(lookup.files(df, max_depth=2), "path") == ["a/y.py"]
    tree = {r["node"]: r["bytes"] for r in lookup.files(df, fmt="tree").collect()}
    assert tree == {"a": 7, "a/b": 3, "a/b/x.java": 3, "a/y.py": 4}
    row = lookup.trail(graph, "m:1").first()
    assert row["callers"] == ["m:1", "m:entry"] and row["callees"] == ["m:1", "m:2"] and row["n_callers"] == 2
    radius = lookup.blast_radius(graph, "Controller", 1).filter("target = 'm:1' AND kind = 'calls'").first()
    assert radius["n_callers"] == 2 and radius["tested"] and radius["relations"] == "findAll and 1 more"


def test_blast_radius_meets_names_once_and_matches_brute_force(spark):
    r = random.Random(4)
    nodes = [(f"n{i % 45}", r.choice([None, "a", "b", "c", "d", "e", "f", "g, h"]), r.choice([None, "Test.java", "x.java"])) for i in range(50)] + [(None, "a", "Test.java")]
    edges = [(r.choice([None, *(f"n{i}" for i in range(50))]), r.choice([None, "t1", "t2", "t3", "t4"]), r.choice([None, "calls", "calls", "contains"])) for _ in range(120)]
    g = Graph(spark.createDataFrame(nodes, "id string, name string, file_path string"), spark.createDataFrame(edges, "source string, target string, kind string"))
    e = [(t, k, n, f) for s, t, k in edges for i, n, f in nodes if s is not None and s == i]
    for shown in (1, 3, 5):
        want = []
        for t, k in {x[:2] for x in e if None not in x[:2]}:
            mine = [x for x in e if x[:2] == (t, k)]
            first = sorted({x[2] for x in mine}, key=lambda n: (n is not None, n or ""))[:shown]
            flags = [False if x[1] != "calls" and (x[1] or x[3] == "x.java") else None if None in (x[1], x[3]) else x[3] == "Test.java" for x in e if x[0] == t]
            known = [x for x in flags if x is not None]
            want.append((t, k, len(mine), ", ".join(n for n in first if n is not None) + (f" and {len(mine) - shown} more" if len(mine) > shown else ""),
                         sum(x[:2] == (t, "calls") for x in e), any(known) if known else None))
        for pieces in (1, 4):
            out = lookup.blast_radius(g, "Test", shown, pieces)
            assert sorted(map(tuple, out.collect())) == sorted(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_skip_packages(spark):
    from callgrove.constants import SKIP_PACKAGES
    df = spark.createDataFrame([("java.util.List",), ("com.x.A",), ("org.springframework.B",)], "qualified_name string")
    assert names(lookup.skip_packages(df, SKIP_PACKAGES), "qualified_name") == ["com.x.A"]


def test_refreshed_impact_is_that_of_a_run_from_scratch(spark, monkeypatch):
    r = random.Random(9)
    nodes = [(f"n{i}", "method", f"f{i % 12}.java") for i in range(60)]
    node_df = spark.createDataFrame(nodes, "id string, kind string, file_path string")
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}", "calls", 1) for _ in range(70)]
    graph = lambda rows: Graph(node_df, spark.createDataFrame(rows, "source string, target string, kind string, line int"), None)
    files = {n: f for n, _, f in nodes}
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(0, 60, 2)], "id string")
    again, walk = [], walks.impact
    monkeypatch.setattr(walks, "impact", lambda g, s, depth=2: again.append(s.count()) or walk(g, s, depth))
    for depth in (1, 3):
        new = [e for e in edges if r.random() > 0.05] + [(f"n{r.randrange(60)}", f"n{r.randrange(60)}", "calls", 2) for _ in range(2)]
        moved = set(edges) ^ set(new)
        changed = spark.createDataFrame([(files[x],) for e in moved for x in (e[0],)], "path string")
        old = walk(graph(edges), seeds, depth)
        got = walks.refresh_impact(old.select("root", "id", "depth"), graph(edges), graph(new), changed, seeds.limit(25), depth)
        assert sorted(map(tuple, got.select("root", "id", "depth").collect())) == sorted(map(tuple, walk(graph(new), seeds.limit(25), depth).select("root", "id", "depth").collect()))
        edges = new
    assert again[0] < 25


def test_a_node_that_changed_its_file_in_one_graph_has_touched_relations_there(spark):
    place = lambda files: spark.createDataFrame(list(files.items()), "id string, file_path string")
    edges = lambda rows: spark.createDataFrame(rows, "source string, target string")
    before = Graph(place({"a": "A", "b": "B", "c": "C", "d": "D"}), edges([("a", "b"), ("b", "c"), ("c", "d"), ("d", "d")]))
    after = Graph(place({"a": "X", "b": "B", "c": "C", "d": "D"}), edges([("a", "b"), ("b", "d"), ("c", "d")]))
    moved = lambda *paths: sorted(map(tuple, walks._moved(before, after, spark.createDataFrame([(p,) for p in paths], "path string")).collect()))
    assert moved("X") == [("a", "b")]  # both graphs have it, but in only one is an end in a changed file
    assert moved("B") == [("b", "c"), ("b", "d")] and moved("D", "A") == [("a", "b"), ("b", "d"), ("d", "d")] and moved("Z") == []


def test_walks_that_ended_do_not_travel(graph, monkeypatch):
    written, write = [], hops.materialize
    monkeypatch.setattr(hops, "materialize", lambda df, name: written.append((name, df.count())) or write(df, name))
    assert hops.khop_left(graph, "pkg::C::m", 4).count() == 4
    assert [n for name, n in written if name == "hop"] == [1, 1, 2, 2]  # the entry, then m:1 and m:2 and never the leaf m:3
    assert hops.khop_left(graph, "pkg::Util::RuntimeExec", 2).collect()[0].asDict() == {"m0_fqn": "pkg::Util::RuntimeExec", "m1_fqn": None, "m2_fqn": None}
    assert hops.khop_left(graph, "pkg::C::m", 0).count() == 1
