"""Rule tables, URL filters, numbered lines, table functions and stop rules on small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from callgrove.functions import java
from callgrove.functions import sql as sqlf
from callgrove.operators import findings, flow, prune, search, structure
from callgrove.schemas import schema
from callgrove.sources import logs

LITERALS = [("executeQuery", "executequery"), (r"Runtime\.getRuntime", "getruntime"), (r"colou?r table", "r table"), ("abc", None), (r"\d{4}-token", "-token"), (r"(?i)Secret\s*=", "secret"),
            (r"(foo|bar)bazqux", "bazqux"), ("left|right", None), ("[a-z]+word", "word"), (r"abcd+efgh", "efgh"), (r"x{2}yyyyy", "yyyyy"), (r"\Qa.b.c.d\E", None), (r"(?x) a b c d e f", None),
            (r"naïve text", "ve text"), ("a.*b", None), (r"\p{Lu}name here", "name here"), ("[]abcd]efghij", None), (r"((?:ab)*cd)?efgh$", "efgh"), ("^begin", "begin")]


def test_required_literals(spark):
    df = spark.createDataFrame([(p,) for p, _ in LITERALS], "pattern string")
    got = {r.pattern: r.x for r in df.select("pattern", flow.required_literal(F.col("pattern")).alias("x")).collect()}
    assert got == dict(LITERALS)


@pytest.mark.parametrize("limit", [flow.SMALL_RULES, 0])
def test_rules_like_every_pair(spark, monkeypatch, limit):
    monkeypatch.setattr(flow, "SMALL_RULES", limit)
    r = random.Random(1)
    words = ["executeQuery", "Runtime.getRuntime", "color table", "colour table", "2024-token", "SECRET =", "barbazqux", "left", "abcddefgh", "xxyyyyy", "a.b.c.d", "naïve text", "Éname here", "efgh", "begin", "none"]
    rows = [(i, r.choice(["x", "y", None]), None if i % 11 == 0 else " ".join(r.choices(words, k=r.randint(0, 4)))) for i in range(120)]
    rules = [(k, p, f"{k}{i}") for i, (p, _) in enumerate(LITERALS) for k in ("x", "y") if p != "[]abcd]efghij"] + [("x", "executeQuery", "x0"), (None, "begin", "n")]
    df, table = spark.createDataFrame(rows, "id int, kind string, text string"), spark.createDataFrame(rules, "kind string, pattern string, label string")
    plain = df.join(table, "kind").filter(F.rlike("text", F.col("pattern"))).select("id", "label")
    want, got = (sorted(map(tuple, x.collect())) for x in (plain, flow.match_rules(df, table).select("id", "label")))
    assert got == want and len(want) > 100
    if limit:
        plan = flow.match_rules(df, table)._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" not in plan


def ant(pattern, path):
    out = re.escape(pattern).replace(r"\*", "*").replace(r"\?", "?")
    out = re.sub(r"/\*\*$", "\1", out)
    out = out.replace("**/", "\3").replace("**", "\2").replace("*", "[^/]*").replace("?", "[^/]").replace("\1", "(?:/.*)?").replace("\3", "(?:.*/)?").replace("\2", ".*")
    return re.fullmatch(out, path, re.S) is not None


def test_filters_like_every_pair(spark):
    r = random.Random(2)
    parts = ["api", "admin", "es", "5x", "a.html", "b.tar.gz", "login", "x"]
    paths = sorted({"/" + "/".join(r.choices(parts, k=r.randint(0, 4))) for _ in range(80)} | {"", "/", "//", "/api/"})
    patterns = ["/api/**", "/**", "/*", "/*/5*", "/**/es/*", "/**.html", "/**/*.gz", "/**/login", "/ap?", "/a*/x", "**/x", "/?*", "/**/5?/**", "/*/*", "/api/*.html", "es/**", "/**/a*"]
    eps = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "endpoint_id int, path string")
    got = {x.path: x.n_filters for x in prune.filter_coverage(eps, spark.createDataFrame([(p,) for p in patterns * 2], "pattern string")).collect()}
    assert got == {p: sum(ant(x, p) for x in patterns) for p in paths}


def test_lines_are_numbered_in_blocks_as_in_whole_files(spark, tmp_path):
    r = random.Random(3)
    for name in ("a", "b", "c"):
        lines = [r.choice(["", '{"chain_id": "k%d", "score": 1}' % i, "{broken", "  "]) for i in range(3000)]
        (tmp_path / f"{name}.jsonl").write_bytes(r.choice([b"\n", b"\r\n"]).join(x.encode() for x in lines) + (b"\n" if name != "c" else b""))
    want_good, want_bad = logs.parse_jsonl(spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")), schema("finding"))
    name = "spark.sql.files.maxPartitionBytes"
    given = spark.conf.get(name)
    spark.conf.set(name, "2k")
    try:
        good, bad = logs.read_jsonl(spark, str(tmp_path), schema("finding"), line_numbers=True)
        rows = lambda df, c: sorted(map(tuple, df.select("file", "line_no", c).collect()))
        assert rows(good, "chain_id") == rows(want_good, "chain_id") and rows(bad, "warning") == rows(want_bad, "warning")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        chat = logs.read_chat(spark, str(tmp_path))
        assert chat.count() == good.count()
    finally:
        spark.conf.set(name, given)


JAVA = '''@RestController
@RequestMapping("/api")
// class note
public class A {
  @PostMapping
  public String f(@RequestParam("x, y") int x, final Map<String, List<Long>> m) {}
  @GetMapping(path = {"/a/{id}", "/b"}, produces="x")
  @ResponseBody
  public String g(@PathVariable("id") Long id, @RequestHeader(value="H", required=false) String h, @RequestBody Dto d) {}
  @RequestMapping(value="/upload", method = RequestMethod.PUT)
  public void u(MultipartFile f) {}
}'''


def test_table_function_gives_the_operators_rows(spark):
    sqlf.register_extract_endpoints(spark)
    df = spark.createDataFrame([("F.java", JAVA), ("E.java", ""), ("N.java", None)], "file string, text string")
    want = sorted(java.extract_endpoints(df).collect(), key=str)
    got = spark.sql("SELECT s.file, e.* FROM {s} AS s, LATERAL extract_endpoints(s.text) AS e", s=df).collect()
    assert sorted(got, key=str) == want and len(want) == 4 and {r.path for r in want} == {"/api", "/api/a/{id}", "/api/b", "/api/upload"}


def test_items_between_commas(spark):
    blocks = ["", "int a", "int a, String b", 'Map<String, List<Long>> m, @P("x, (y") int z', "@A({1, 2}) int a , (b, (c, d)), e", "x < y, z", "a) , b"]
    df = spark.createDataFrame([(b,) for b in blocks], "block string")
    got = [r.x for r in df.select(F.regexp_extract_all("block", F.lit(java._ITEM), 0).alias("x")).collect()]
    assert got == [[], ["int a"], ["int a", " String b"], ["Map<String, List<Long>> m", ' @P("x, (y") int z'], ["@A({1, 2}) int a ", " (b, (c, d))", " e"], ["x < y", " z"], ["a) ", " b"]]


def tree(r, file, start, end, depth, out):
    out.append((len(out), file, start, end, r.choice("abstx")))
    at = start
    while depth and end - at > 3 and r.random() < 0.8:
        low = r.randint(at, end - 2)
        high = r.randint(low + 1, end)
        tree(r, file, low, high, depth - 1, out)
        at = high


def test_stop_rules_like_every_triple(spark):
    r, nodes = random.Random(4), []
    for file in range(6):
        tree(r, file, 0, 3000, 6, nodes)
    df = spark.createDataFrame(nodes, "id int, file int, start int, `end` int, kind string")
    a, b, stop = (df.filter(F.col("kind").isin(*k)) for k in (("a", "x", "s"), ("b", "s"), ("s", "t")))
    pick = lambda *k: [n for n in nodes if n[4] in k]
    inside = lambda x, y: x[1] == y[1] and y[2] <= x[2] and x[3] <= y[3] and x[2:4] != y[2:4]
    behind = lambda x, y: x[1] == y[1] and y[3] <= x[2]
    stops = pick("s", "t")
    for fn, far in ((structure.rel_inside, inside), (structure.rel_has, lambda x, y: inside(y, x)), (structure.rel_follows, behind), (structure.rel_precedes, lambda x, y: behind(y, x))):
        want = [x[0] for x in pick("a", "x", "s") if any(far(x, y) and not any(far(x, s) and far(s, y) for s in stops) for y in pick("b", "s"))]
        assert sorted(n.id for n in fn(a, b, stop).collect()) == sorted(want), fn
        assert sorted(n.id for n in fn(a, b, stop.limit(0)).collect()) == sorted(n.id for n in fn(a, b).collect())


def test_explored_files_have_a_row_for_each_hit(spark):
    df = spark.createDataFrame([(1, "a", "red token"), (2, "a", "token_x Token2 tokens"), (3, "b", "red red"), (4, "c", "blue"), (5, "b", "TOKEN, red")], "id int, file string, text string")
    got = search.explore(df, "red token", ["text"], "id", "file", 1).collect()
    scores = {r.id: r.score for r in search.search(df, "red token", ["text"], "id", None, match="any").collect()}
    assert scores.keys() == {1, 2, 3, 5} and {(r.file, r.key, r.n_symbols) for r in got} == {("b", 3, 2), ("b", 5, 2)} or {(r.file, r.key) for r in got} == {("a", 1), ("a", 2)}
    assert all(r.score == scores[r.key] and r.best == max(x.score for x in got) for r in got)


def test_stored_sketches_count_merged_groups(spark):
    rows = spark.range(30_000).selectExpr("id % 3 AS round", "IF(id % 10 = 0, NULL, concat('c', id % 4000)) AS chain_id")
    stored = findings.chain_sketches(rows, ["round"])
    whole = findings.merged_cardinality(stored).first()
    exact = rows.agg(F.count_distinct("chain_id")).first()[0]
    assert whole.n_findings == 30_000 and abs(whole.about_chains - exact) < 0.05 * exact
    assert findings.merged_cardinality(stored, ["round"]).count() == 3
    assert tuple(findings.merged_cardinality(stored.limit(0)).first()) == (0, 0)


def test_small_files_are_scanned_whole_with_the_rows_of_cut_ones(spark, monkeypatch):
    r, nodes = random.Random(8), []
    for file in range(4):
        tree(r, file, 0, 3000, 6, nodes)
    df = spark.createDataFrame(nodes, "id int, file int, start int, `end` int, kind string")
    a, b, stop = (df.filter(F.col("kind").isin(*k)) for k in (("a", "x", "s"), ("b", "s"), ("s", "t")))
    for fn in (structure.rel_inside, structure.rel_has, structure.rel_follows, structure.rel_precedes):
        plans, rows = [], []
        for most in (structure.WHOLE, 0):
            monkeypatch.setattr(structure, "WHOLE", most)
            hits = fn(a, b, stop)
            plans.append(hits._jdf.queryExecution().optimizedPlan().toString())
            rows.append(sorted(hits.collect()))
            monkeypatch.undo()
        assert rows[0] == rows[1] and rows[0], fn
        assert "__piece" not in plans[0] and "__piece" in plans[1]
