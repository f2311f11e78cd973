"""Findings, endpoints, logs, caches and streams on small literal inputs."""

import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from callgrove.functions import java, keys, text, verdicts
from callgrove.functions.sql import register_endpoint_function, register_functions, run_sql
from callgrove.operators import findings as fd
from callgrove.operators import flow, logs, prune, reconcile, structure
from callgrove.schemas import schema
from callgrove.sources import code, records
from callgrove.sources import logs as log_sources
from callgrove.streaming import jobs

JAVA = '''package com.example;
import org.springframework.boot.SpringApplication;
@RestController
@RequestMapping("/api")
public class UserController {
  @GetMapping("/users/{id}")
  public User get(@PathVariable("id") Long id, @RequestParam(required = false, name = "q") String query) { return null; }
  @PostMapping(value = "/login", consumes = "application/json")
  public void login(@RequestBody Login body) { }
  @RequestMapping(path = "/x", method = RequestMethod.DELETE)
  // gone soon
  protected String drop(@RequestHeader String agent) { return ""; }
  @PutMapping
  public void all(@RequestParam int n, MultipartFile file) { }
}
'''


def one(df):
    (row,) = df.collect()
    return row


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def ctl(spark):
    return spark.createDataFrame([("src/lessons/auth/UserController.java", JAVA), ("B.java", "class B {}")], "file string, text string")


def test_endpoints(ctl):
    got = {r["path"]: r for r in java.extract_endpoints(code.controllers(ctl)).collect()}
    assert sorted((p, r["http_method"]) for p, r in got.items()) == [
        ("/api", "put"), ("/api/login", "post"), ("/api/users/{id}", "get"), ("/api/x", "delete")]
    user = got["/api/users/{id}"]["params"]
    assert [(p["name"], p["in"], p["required"], p["type"], p["format"]) for p in user] == [
        ("id", "path", True, "integer", "int64"), ("q", "query", False, "string", None)]
    assert got["/api/login"]["body"] == "Login" and got["/api/login"]["risk"] == "HIGH"
    assert [p["in"] for p in got["/api/x"]["params"]] == ["header"] and all(r["has_input"] for r in got.values())


def test_endpoints_reference_mode_keeps_the_class_mapping(ctl):
    paths = [r["path"] for r in java.extract_endpoints(ctl, mode="ref").collect()]
    assert "/api/api" in paths and "/api" not in paths


@pytest.mark.parametrize("prefix,path,want", [
    ("", "", "/"), ("/api", "", "/api"), ("api", "x", "/api/x"), ("/api/", "/x", "/api//x"), ("", "x", "/x"), ('"/a"', "'b'", "/a/b")])
def test_normalize_path(spark, prefix, path, want):
    df = spark.createDataFrame([(prefix, path)], "a string, b string")
    assert one(df.select(java.normalize_path(F.col("a"), F.col("b")).alias("p")))["p"] == want


def test_api_spec(ctl, tmp_path, spark):
    eps = java.extract_endpoints(code.controllers(ctl))
    code.export_api_spec(eps, str(tmp_path))
    back = spark.read.json(f"{tmp_path}/paths")
    assert back.count() == 4
    op = {r["path"]: json.loads(r["operation"]) for r in code.api_operations(eps).collect()}
    assert op["/api/login"]["operationId"] == "UserController_post" and "application/json" in op["/api/login"]["requestBody"]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "UserController.java").write_text(JAVA)
    (tmp_path / "a" / "Plain.java").write_text("class Plain {}")
    assert code.read_sources(spark, str(tmp_path)).count() == 1
    (tmp_path / "pom.xml").write_text("<groupId>com.x</groupId><artifactId>app</artifactId>")
    pom = one(code.read_pom(spark, str(tmp_path)))
    assert (pom["group_id"], pom["artifact_id"]) == ("com.x", "app")
    assert code.read_preset(spark, str(tmp_path / "none.json")) is None
    got = rows(code.detect_preset(code.read_sources(spark, str(tmp_path))).filter("framework is not null"), "value", "framework")
    assert got == [("org.springframework.boot.SpringApplication", "spring-boot")]


def test_jsonl_skips_blank_and_names_the_bad_line(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"chain_id": "a", "score": 90}\n\n{"chain_id": \n{"chain_id": "b"}\n')
    for numbered in (True, False):
        good, bad = log_sources.read_jsonl(spark, str(tmp_path), schema("finding"), numbered)
        assert rows(good, "chain_id") == [("a",), ("b",)]
        assert one(bad)["warning"].endswith("f.jsonl:3" if numbered else "f.jsonl")
    log_sources.append_jsonl(spark.createDataFrame([("c",)], "chain_id string"), str(tmp_path / "out"))
    log_sources.append_jsonl(spark.createDataFrame([("d",)], "chain_id string"), str(tmp_path / "out"))
    assert log_sources.read_log(spark, str(tmp_path / "out"), "finding")[0].count() == 2


def test_chat_layouts(spark, tmp_path):
    lines = ['{"role": "user", "content": "hi"}', '{"type": "user", "message": [{"type": "image"}, {"type": "text", "text": "part"}]}', '{"content": "x"}', "{broken"]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    chat = log_sources.read_chat(spark, str(tmp_path))
    assert rows(chat, "role", "content") == [("unknown", "x"), ("user", "hi"), ("user", "part")]
    assert {(r["role"], r["n"], r["first_user"]) for r in logs.role_counts(chat).collect()} == {("user", 2, "hi"), ("unknown", 1, "hi")}


def test_reports(spark, tmp_path):
    hi, lo = tmp_path / "hi", tmp_path / "lo"
    hi.mkdir(), lo.mkdir()
    (hi / "严重_com__example__UserController_search_a1b2c3d4.md").write_text("- **验证状态**：是问题")
    (lo / "readme.md").write_text("x")
    got = {r["folder"]: r for r in records.read_reports(spark, str(hi), str(lo)).collect()}
    assert (got["high"]["level"], got["high"]["class"], got["high"]["method"], got["high"]["sig"]) == ("严重", "com.example.UserController", "search", "a1b2c3d4")
    assert got["low"]["level"] is None
    long = spark.createDataFrame([("严重_9.8_SQLI_com__x__A_run_deadbeef.md",), ("是问题_致命_com__x__A_run_deadbeef.md",)], "n string")
    p = [r["p"] for r in long.select(text.parse_report_name(F.col("n")).alias("p")).collect()]
    assert (p[0]["score"], p[0]["vuln_type"], p[0]["class"]) == (9.8, "SQLI", "com.x.A") and p[1]["state"] == "是问题"


@pytest.mark.parametrize("line,want", [("- **验证状态**: 暂时无法确认", "暂时无法确认"), ("**验证状态**：是问题  ", "是问题"), ("验证状态: x", None)])
def test_md_field(spark, line, want):
    df = spark.createDataFrame([(f"# t\n{line}\nnext",)], "t string")
    assert one(df.select(text.md_field(F.col("t"), "验证状态").alias("v")))["v"] == want


def test_promotion(spark):
    s = spark.createDataFrame([("a", 27, 90), ("a", 28, 88), ("a", 29, 92), ("b", 27, 90), ("b", 28, 80), ("b", 29, 92), ("c", 1, 99), ("c", 3, 99), ("c", 4, 99), ("d", 1, 99),
                               ("e", 1, 85), ("e", 2, 99), ("e", 3, 99)], "chain_id string, round int, score int")
    got = {r["chain_id"]: (r["promoted"], r["reason"]) for r in fd.promote(s).collect()}
    assert got["a"] == (True, None) and got["b"] == (False, "not all > 85")
    assert got["c"][0] is False and got["d"][0] is False and got["e"] == (False, "not all > 85")


def test_promotion_is_monotone_in_the_threshold(spark):
    s = spark.range(300).selectExpr("id % 60 AS chain_id", "CAST(id / 60 AS INT) AS round", "CAST(50 + (id * 37) % 50 AS INT) AS score")
    ok = [{r["chain_id"] for r in fd.promote(s, threshold=t).filter("promoted").collect()} for t in (55, 70, 85)]
    assert ok[0] >= ok[1] >= ok[2] and ok[0]


def test_reconcile(spark):
    def items(n_chain):
        f = spark.createDataFrame([(f"ep{i}", f"c{i}", "CRITICAL" if i < 2 else "HIGH", "confirmed_vuln", 90, "final") for i in range(5)],
                                  "endpoint_fqn string, chain_id string, severity string, poc_status string, score int, status string")
        eps = spark.createDataFrame([(f"ep{i}",) for i in range(10)], "endpoint_fqn string")
        kv = spark.createDataFrame([("final",)] * 5 + [("chain",)] * n_chain, "kind string")
        fails = spark.createDataFrame([], "failure_type string")
        return reconcile.reconcile(f, eps, kv, fails, eps)
    verdict = one(reconcile.reconcile_verdict(items(5)))
    assert (verdict["all_ok"], verdict["warn_count"], verdict["may_end"]) == (True, 0, True)
    bad = {r["item"] for r in items(2).filter("NOT ok").collect()}
    assert bad == {"9_cache_chains"}


def test_reconcile_of_nothing_still_has_nine_items(spark):
    f = spark.createDataFrame([], "endpoint_fqn string, chain_id string, severity string, poc_status string, score int, status string")
    eps, kv, fails = (spark.createDataFrame([], t) for t in ("endpoint_fqn string", "kind string", "failure_type string"))
    assert reconcile.reconcile(f, eps, kv, fails, eps).count() == 9


def test_pruned_list(spark):
    log = spark.createDataFrame([("L1", "P-L1-001")] * 3 + [("L2", "P-L2-001")] * 2, "level string, rule_id string")
    got = {(r["scope"], r["rule_id"]): r["n"] for r in prune.list_pruned(log).collect()}
    assert got[("rule", "P-L1-001")] == 3 and got[("rule", "P-L2-001")] == 2 and got[("total", None)] == 5


def test_first_matching_rule_wins(spark):
    df = spark.sql("""SELECT * FROM VALUES ('/health', array(), array(), false, false, false), ('/actuator/x', array(struct('a', 'String')), array(), false, false, false),
        ('/n', array(struct('a', 'int')), array(), false, false, false), ('/u', array(struct('a', 'String')), array('@Odd'), true, false, false), ('/ok', array(struct('a', 'String')), array(), true, true, false)
        AS t(path, params, annotations, permit_all, filter_covered, internal_network)""").withColumn("params", F.col("params").cast("array<struct<name:string,type:string>>")).withColumn("annotations", F.col("annotations").cast("array<string>"))
    got = {r["path"]: (r["rule_id"], r["reversible"]) for r in prune.l1_prune(df).collect()}
    assert got == {"/health": ("P-L1-001", True), "/actuator/x": ("P-L1-005", False), "/n": ("P-L1-002", True), "/u": ("P-L1-007", True), "/ok": (None, None)}


def test_force_rescan(spark):
    df = spark.createDataFrame([("com.x.Y::z", ["C", "D"]), ("e", ["A", "C"])], "endpoint_fqn string, modes array<string>")
    got = {r["endpoint_fqn"]: r for r in prune.force_rescan(df, "g", "H").collect()}
    assert got["com.x.Y::z"]["status"] == "queued" and hashlib.sha256(b"com.x.Y::z").hexdigest()[:16] in got["com.x.Y::z"]["key"]
    assert got["e"]["status"] == "error" and got["e"]["key"] is None


def test_prefetch(spark):
    chains = spark.createDataFrame([("c1",), ("c0",)], "chain_id string")
    methods = spark.createDataFrame([("c1", i, f"pkg::C::m{i}", None if i == 0 else f"h{i}", "hello world", "F.java", 1) for i in range(30)],
                                    "chain_id string, pos int, fqn string, sig_hash string, body string, file string, line int")
    out = keys.prefetch(chains, methods, "g", "H").collect()
    assert sum(r["kind"] == "method" for r in out) == 30
    heads = {r["chain_id"]: r for r in out if r["kind"] == "prefetch"}
    assert heads["c1"]["key"].endswith("prefetch:c1") and len(json.loads(heads["c1"]["value"])["methods"]) == 30
    assert json.loads(heads["c0"]["value"])["methods"] == []
    first = next(json.loads(r["value"]) for r in out if r["kind"] == "method" and "m0#" in r["key"])
    assert first["sig_hash"] == "b94d27b9934d3e08"


def test_long_chain_gives_pages(spark):
    methods = spark.range(2500).selectExpr("'c' AS chain_id", "CAST(id % 3 AS INT) AS pos", "concat('f', id) AS fqn", "'h' AS sig_hash", "'b' AS body", "'F' AS file", "1 AS line")
    out = keys.prefetch(methods.select("chain_id").distinct(), methods, "g", "H").filter("kind = 'prefetch'").collect()
    assert sorted(len(json.loads(r["value"])["methods"]) for r in out) == [500, 1000, 1000]


@pytest.mark.parametrize("kind,entity,sub", [("method", "pkg::C::m0", "h0"), ("final", "c1", None), ("score", "c1", "7"), ("chain", "abc", None), ("killed", "w1", None), ("env", None, None)])
def test_key_round_trip(spark, kind, entity, sub):
    df = spark.createDataFrame([("g", "H", kind, entity, sub)], "group_id string, commit_hash string, kind string, entity string, sub string")
    row = one(records.read_kv(records.encode_kv(df).select("key")))
    assert (row["group_id"], row["commit_hash"], row["kind"], row["entity"], row["sub"]) == ("g", "H", kind, entity, sub)


def test_self_check(spark):
    kv = spark.createDataFrame([(f"k{i}", f"b{i}") for i in range(50)], "key string, body string")
    truth = spark.createDataFrame([(f"k{i}", f"b{i}" if i else "other") for i in range(50)], "key string, body string")
    assert reconcile.self_check(kv, kv).filter("to_delete").count() == 0
    assert rows(reconcile.self_check(kv, truth).filter("to_delete"), "key", "reason") == [("k0", "body_mismatch")]
    assert one(reconcile.self_check_summary(reconcile.self_check(kv.limit(0), truth)))["warning"] == "no keys found"


def test_kv_stats_and_expiry(spark):
    kinds = {"method": 120, "chain": 10, "prefetch": 8, "draft": 15, "final": 5}
    kv = spark.createDataFrame([(k,) for k, n in kinds.items() for _ in range(n)], "kind string")
    assert one(reconcile.kv_stats(kv)).asDict() == {f"n_{k}": n for k, n in kinds.items()}
    at = kv.withColumn("written_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    left = keys.expire(at, F.lit("2026-01-01 02:00:00").cast("timestamp"))
    assert rows(left.groupBy("kind").count(), "kind", "count") == [("draft", 15), ("final", 5), ("method", 120)]


def test_propagation(spark):
    chain = spark.createDataFrame([("v", 0, 'search(name)\nq = "x" + name\nrun.query(name)'), ("s", 0, 'id.matches("\\d+")\nrun.query(id)'), ("n", 0, "log(x)")], "chain_id string, depth int, body string")
    params = spark.createDataFrame([("v", "name"), ("s", "id"), ("n", "x")], "chain_id string, param string")
    uses = flow.trace_params(params, chain, {"SQL": [r"\.query\("]})
    assert rows(uses.filter("chain_id = 'v'"), "line", "use") == [(0, "function_call"), (1, "concat"), (2, "sink_call")]
    got = {r["chain_id"]: r["risk"] for r in flow.evaluate_risk(uses).collect()}
    assert got == {"v": "VULNERABLE", "s": "SANITIZED", "n": "NO_SINK"}


def test_sanitizer_of_another_kind_does_not_help(spark):
    uses = spark.createDataFrame([("c", "p", 0, 0, "sanitizer", "SQL"), ("c", "p", 1, 0, "sink_call", "CMD")], "chain_id string, param string, depth int, line int, use string, kind string")
    assert one(flow.evaluate_risk(uses))["risk"] == "VULNERABLE"


def test_validation(spark):
    ok = ("c", "GET /x", "f", "IDOR", "HIGH", ["A.java:42 (n)"], "s", "A", 0.5)
    bad = (None, "GET /x", "f", "IDOR", "HUGE", ["A.java"], "s" * 501, "B", 1.5)
    df = spark.createDataFrame([ok, bad], "chain_id string, endpoint string, fqn string, vuln_type string, severity string, evidence array<string>, summary string, mode string, confidence double")
    got = [r["errors"] for r in fd.validate_findings(df).orderBy("confidence").collect()]
    assert got[0] == [] and set(got[1]) == {"missing:chain_id", "enum:severity", "evidence:no_line", "length:summary", "mode:vuln_type", "range:confidence"}
    extra = fd.validate_findings(df.withColumn("payload_x", F.lit(1)))
    assert "unknown_key:payload_x" in extra.first()["errors"]


def test_write_findings(spark, tmp_path):
    df = spark.createDataFrame([("c1", "x"), ("c2", "y")], "chain_id string, summary string")
    records.write_findings(df, str(tmp_path / "flat"), buckets=2)
    assert sorted(tuple(r) for r in spark.read.json(str(tmp_path / "flat")).select("chain_id", "summary").collect()) == [("c1", "x"), ("c2", "y")]
    records.write_findings(df, str(tmp_path / "out"), folders=True)
    assert sorted(p.name for p in (tmp_path / "out").glob("chain_id=*")) == ["chain_id=c1", "chain_id=c2"]


def test_report_quality(spark):
    df = spark.createDataFrame([
        ("是问题_严重_com__x__A_run_deadbeef.md", "curl -d id=1 or\nHTTP/1.1 200\nroot:x:0:0\nA.java:10\n**验证状态**: 是问题"),
        ("是问题_严重_com__x__D_run_deadbeef.md", "curl http://x/\nHTTP/1.1 200\nroot:x:0:0\nA.java:10\n**验证状态**: 是问题"),
        ("是问题_严重_com__x__E_run_deadbeef.md", "curl -d id=1\nHTTP/1.1 200\nA.java:10\n**验证状态**: 是问题"),
        ("是问题_严重_com__x__B_run_deadbeef.md", "**验证状态**: 暂时无法确认"),
        ("是问题_严重_com__x__C_run_deadbeef.md", "curl HTTP/1.1 200 缺乏充分的输入验证和输出编码\n**验证状态**: 是问题")], "name string, text string")
    judged = reconcile.report_quality(df)
    assert sorted(r["verdict"] for r in judged.collect()) == ["CONTRADICTION", "FAKE", "FAKE", "FAKE", "OK"]
    assert one(reconcile.quality_round(judged))["failed"] is True


def test_impact_patterns_are_grouped(spark):
    df = spark.createDataFrame([("FROM a INTO b 500 words",), ("root:x:0:0 UPDATE t SET a 503 Service Error",)], "t string")
    got = [r["e"] for r in df.select(text.impact_evidence(F.col("t")).alias("e")).collect()]
    assert (got[0]["n_integrity"], got[0]["n_availability"], got[0]["n_empty"]) == (0, 0, 3) and got[1]["n_empty"] == 0


def test_redaction_and_excerpt(spark):
    df = spark.createDataFrame([("mail a@b.com from 10.0.0.1 password=abc",)], "t string")
    r = one(df.select(text.redact(F.col("t")).alias("r")))["r"]
    assert r["redaction_count"] == 3 and r["redaction_types"] == ["email", "ip", "secret"] and "abc" not in r["text"]
    x = one(spark.createDataFrame([("y" * 600,)], "t string").select(text.excerpt(F.col("t")).alias("x")))["x"]
    assert len(x["output_excerpt"]) == 500 and x["external"] and x["output_sha256"] == hashlib.sha256(b"y" * 600).hexdigest()


def test_verdict_parsing(spark):
    df = spark.createDataFrame([("```\n**Y**\nunsafe concat\n```", '```json\n[{"key": "k", "verdict": "n"}]\n```'), ("no letter here", "none")], "a string, b string")
    got = df.select(verdicts.parse_verdict(F.col("a")).alias("v"), verdicts.parse_verdict_array(F.col("b")).alias("l")).collect()
    assert (got[0]["v"]["verdict"], got[0]["v"]["note"], got[0]["l"][0]["key"]) == ("y", "unsafe concat", "k")
    assert got[1]["v"]["verdict"] is None and got[1]["l"] is None


def test_outputs(spark):
    df = spark.createDataFrame([('[{"type":"status"},{"type":"version","version":"3"},{"type":"row_affect","rowCount":2},{"type":"x","message":"m"}]',)], "r string")
    assert one(df.select(verdicts.extract_output(F.col("r")).alias("o")))["o"] == "3\nrowCount: 2\nm"
    st = spark.createDataFrame([(401, None, None), (404, None, None), (500, None, None), (200, "SUCCEEDED", "fine"), (200, "SUCCEEDED", ""), (200, "PROCESSING", None), (None, None, None)], "c int, s string, o string")
    got = [r[0] for r in st.select(verdicts.classify_result(F.col("c"), F.col("s"), F.col("o"))).collect()]
    assert got == ["AUTH_FAILURE", "AGENT_OFFLINE", "CONNECTION_ERROR", "OK", "ARTHAS_ERROR", "TIMEOUT", "CONNECTION_ERROR"]


def test_transcript(spark):
    lines = [(1, "session_start", "s1", None, None), (2, "log", "s1", "1", "ok"), (3, "session_end", "s1", None, None), (4, "session_start", "s2", None, None), (5, "log", "s2", "2", "fail"), (6, "log", "s2", "1", "ok")]
    df = spark.createDataFrame([("f", *x) for x in lines], "file string, line_no int, _type string, session_id string, phase string, status string")
    st = one(logs.log_status(df, ["file"]))
    assert (st["active_session"], st["total_sessions"], st["closed_sessions"], st["entries"], st["ok_count"], st["fail_count"], st["phases"]) == ("s2", 2, 1, 2, 1, 1, "1,2")
    blocks = logs.assign_sessions(df, ["file"], ["line_no"], F.floor(F.col("line_no") / 2))
    assert [r["session_no"] for r in blocks.orderBy("line_no").collect()] == [1, 1, 1, 2, 2, 2]
    assert rows(logs.last_n(logs.query_log(df, status="ok"), 1), "line_no") == [(6,)]


def test_numbering_is_global(spark):
    df = spark.range(1500).selectExpr("id", "array('a', 'b') AS evidence")
    got = fd.number_ids(df, ["id"]).collect()
    assert len(got) == 3000 and {(r["id"], r["finding_id"]) for r in got} >= {(0, "F-001"), (1499, "F-1500")} and {r["evidence_id"] for r in got} == {"E-001", "E-002"}


def test_sql_surface(spark, ctl):
    register_functions(spark)
    row = spark.sql("SELECT sink_type('executeQuery') a, java_schema_type('Long') b, path_risk('/XSS/x') c, level_rank('严重') d, join_path('api', 'x') e, short_hash('hello world') f").first()
    assert tuple(row) == ("SQLI", "integer", "MEDIUM", 2, "/api/x", "b94d27b9934d3e08")
    register_endpoint_function(spark)
    assert spark.sql("SELECT e.* FROM {t} AS t, LATERAL mapped_endpoints(t.text) AS e", t=ctl).select("kind", "args").distinct().count() == 4
    assert run_sql(spark, "SELECT count(*) AS n FROM {t} WHERE file = :f", {"f": "B.java"}, t=ctl).first()["n"] == 1


def test_filter_patterns(spark):
    eps = spark.createDataFrame([(1, "/api/a/b"), (2, "/api"), (3, "/apix/a"), (4, "/x/one.html"), (5, "/")], "endpoint_id int, path string")
    rules = spark.createDataFrame([("/api/**",), ("/*/one.html",)], "pattern string")
    got = {r["endpoint_id"]: r["covered"] for r in prune.filter_coverage(eps, rules).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}


def test_environment_gate(spark):
    ts = lambda m: f"2026-01-01 {m // 60:02d}:{m % 60:02d}:00"
    req = spark.createDataFrame([("g", ts(10), 1), ("g", ts(200), 2), ("h", ts(10), 3)], "group_id string, ts string, req_id int").withColumn("ts", F.to_timestamp("ts"))
    env = spark.createDataFrame([("g", ts(5), 9, "up"), ("g", ts(100), 8, "down")], "group_id string, ts string, rec_id int, state string").withColumn("ts", F.to_timestamp("ts"))
    assert rows(fd.env_asof(req, env), "req_id", "state") == [(1, "up"), (2, "unknown"), (3, "unknown")]


def test_illegal_transitions(spark):
    ev = spark.sql("""SELECT * FROM VALUES ('o', 1, timestamp'2026-01-01', 'PENDING'), ('o', 2, timestamp'2026-01-02', 'PAID'), ('o', 3, timestamp'2026-01-20', 'REFUNDED'), ('p', 4, timestamp'2026-01-01', 'PENDING'), ('p', 5, timestamp'2026-01-02', 'SHIPPED')
        AS t(k, n, ts, s)""")
    got = logs.illegal_transitions(ev, "k", "ts", "n", "s", F.to_date("ts"))
    assert rows(got, "n", "fault") == [(3, "not_allowed"), (5, "skipped")]


def test_promotion_stream_equals_the_batch(spark, tmp_path):
    scores = spark.range(210).selectExpr("id % 70 AS chain_id", "CAST(id / 70 AS INT) AS round", "CAST(70 + (id * 13) % 30 AS INT) AS score")
    for i in range(3):  # three files, three micro-batches, rounds out of order
        scores.filter(f"round = {(i + 1) % 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = jobs.latest(jobs.run_to_table(jobs.promote_stream(stream), "update", "p", idle_batches=False), ["chain_id"])
    assert rows(live, "chain_id", "promoted") == rows(fd.promote(scores), "chain_id", "promoted")


def test_promotion_stream_runs_in_a_session_with_another_state_store(spark, tmp_path):
    spark.createDataFrame([(1, i, 99) for i in range(3)], "chain_id bigint, round int, score int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chain_id bigint, round int, score int").parquet(str(tmp_path / "in"))
    given, other = spark.conf.get(jobs.STATE_STORE), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(jobs.STATE_STORE, other)
    try:
        assert rows(jobs.run_to_table(jobs.promote_stream(stream), "update", "p", idle_batches=False), "chain_id", "promoted") == [(1, True)]
        assert spark.conf.get(jobs.STATE_STORE) == other
    finally:
        spark.conf.set(jobs.STATE_STORE, given)


def test_rounds_are_forgotten_after_their_lifetime(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(1, i, 99)], "chain_id bigint, round int, score int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chain_id bigint, round int, score int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept, lost = (jobs.run_to_table(jobs.promote_stream(stream, **life), "update", "p", idle_batches=False).collect() for life in ({}, {"lifetime_ms": 1}))
    assert sorted(r.promoted for r in kept) == [False, False, True] and [r.promoted for r in lost] == [False] * 3


class Held:
    """State of one piece, and how often it was asked for."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getCurrentProcessingTimeInMs(self):
        return 1


def test_promotion_asks_for_the_state_of_a_piece_once():
    held, job = Held(), jobs.LastRounds(3, 85, 1000)
    job.init(held)
    batch = lambda r, chains: pd.DataFrame({"known": True, "chain_id": range(chains), "round": r, "score": 99})
    out = [pd.concat(job.handleInputRows((0,), iter(pdfs), held)) for pdfs in ([batch(0, 500), batch(1, 500)], [batch(2, 100)])]
    assert held.calls == 4 and [len(o) for o in out] == [500, 100]
    assert not out[0]["promoted"].any() and out[1]["promoted"].all()


def test_chains_of_one_piece_keep_their_own_rounds(spark, tmp_path):
    rnd = random.Random(4)
    scores = [(c, r, rnd.choice([84, 86, 99])) for c in [*range(40), 2**60, 2**60 + 1, None] for r in rnd.sample(range(7), rnd.randint(1, 6))]
    rnd.shuffle(scores)
    schema = "chain_id bigint, round int, score int"
    for i in range(4):
        spark.createDataFrame(scores[i::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live = jobs.latest(jobs.run_to_table(jobs.promote_stream(stream, pieces=3), "update", "p", idle_batches=False), ["chain_id"])
    plain = lambda df: sorted(map(str, df.select("chain_id", "last_round", "worst", "promoted").collect()))
    assert plain(live) == plain(fd.promote(spark.createDataFrame(scores, schema)))


def test_null_rounds_and_scores_of_a_piece_count_as_they_do_for_one_chain():
    rnd, nan = random.Random(5), float("nan")
    came = [(rnd.randrange(60), rnd.choice([nan, *range(6)]), rnd.choice([nan, 80, 90, 99])) for _ in range(240)]
    want = {}
    for chain in {c for c, *_ in came}:
        kept = {}
        kept.update((r if r == r else float("nan"), s) for c, r, s in came if c == chain)
        kept = {r: kept[r] for r in sorted(kept)[-3:]}
        last, worst = max(kept), min(kept.values())
        want[chain] = (last, worst, len(kept) == 3 and last - min(kept) == 2 and worst > 85)
    held, job = Held(), jobs.LastRounds(3, 85, 1000)
    job.init(held)
    pdf = pd.DataFrame([(True, c, r if r == r else jobs.NO_ROUND, s if s == s else jobs.NO_SCORE) for c, r, s in came], columns=["known", "chain_id", "round", "score"])
    (out,) = job.handleInputRows((0,), iter([pdf]), held)
    plain = lambda v: None if pd.isna(v) else int(v)
    got = {int(c): (plain(r), plain(w), bool(p)) for c, r, w, p in out.itertuples(index=False)}
    assert got == {c: (plain(r), plain(w), p) for c, (r, w, p) in want.items()} and any(r is None for r, *_ in got.values()) and any(p for *_, p in got.values())


def test_heartbeat_closes_only_silent_workers(spark, tmp_path):
    ev = spark.sql("""SELECT * FROM VALUES (1, timestamp'2026-01-01 00:00:00', true), (1, timestamp'2026-01-01 00:30:00', false), (2, timestamp'2026-01-01 05:00:00', true) AS t(worker, ts, done)""")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    out = jobs.run_to_table(jobs.heartbeat(stream), "append", "h")
    assert [(r["worker"], str(r["killed_at"]), r["completed"], r["remaining"]) for r in out.collect()] == [(1, "2026-01-01 01:30:00", 1, 1)]


def test_expiring_stream_and_duplicates(spark, tmp_path):
    kv = spark.sql("SELECT 'chain' AS kind, timestamp'2020-01-01' AS written_at, 1 AS id UNION ALL SELECT 'final', timestamp'2020-01-01', 2 UNION ALL SELECT 'final', timestamp'2020-01-01', 2")
    kv.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kv.schema).parquet(str(tmp_path / "in"))
    once = jobs.distinct_records(stream, ["id"], "written_at")
    assert rows(jobs.run_to_table(jobs.expire_stream(once), "append", "e"), "id") == [(2,)]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    rows_in = lambda a, b: spark.range(a, b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    (tmp_path / "in").mkdir()
    home = str(tmp_path / "home")
    assert jobs.run_to_table(read(), "append", "r", home).count() == 0
    rows_in(0, 5)
    assert jobs.run_to_table(read(), "append", "r", home).count() == 5
    rows_in(5, 8)
    again = [jobs.run_to_table(read(), "append", "r", home) for _ in range(2)][-1]
    assert sorted(r["id"] for r in again.collect()) == list(range(8))


def test_one_chain_of_many_methods(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("'c' AS chain_id", "CAST(id AS INT) AS depth", "'SQL' AS sink_kind", "CASE WHEN id = 70000 THEN 'x.setString(1)' ELSE 'y' END AS body")
    clean = flow.sanitizer_state(chain, ["depth"])
    assert clean.filter("clean").count() == n - 70000
    methods = spark.range(n).selectExpr("'c' AS chain_id", "id AS pos", "concat('m', id) AS fqn", "CAST(NULL AS STRING) AS sig_hash", "'b' AS body", "'f' AS file", "1 AS line")
    pages = keys.prefetch(chain.select("chain_id").distinct(), methods, "g", "h").filter("kind = 'prefetch'")
    got = pages.select(F.get_json_object("value", "$.pages").cast("int").alias("p"), F.from_json("value", "methods array<struct<fqn:string>>").alias("v")).collect()
    assert {r["p"] for r in got} == {100} and sorted(m["fqn"] for r in got for m in r["v"]["methods"]) == sorted(f"m{i}" for i in range(n))


def test_inverted_and_endless_ranges_hold_no_line(spark):
    methods = spark.createDataFrame([("a", "f", 10, 5), ("b", "f", 1, 2_000_000_000), ("c", "f", 6, 8)], "id string, file_path string, start_line int, end_line int")
    points = spark.createDataFrame([("f", 7), ("f", 300), ("g", 1)], "file string, line int")
    assert rows(structure.enclosing_method(points, methods), "line", "method_id") == [(1, None), (7, "c"), (300, "b")]


def test_paths_and_parameters_of_mappings(spark):
    text = """@RestController
class C {
@GetMapping(produces = "text/html", value = {"/1", "/2", "/3", "/4"})
public String a(@PathVariable(name="id") Long id, @RequestParam final Map<String, List<String>> all, @RequestHeader("X, y") String h, @RequestBody(required = false) List<Map<String, Form>> b) {}
}"""
    out = java.extract_endpoints(spark.createDataFrame([("C.java", text)], "file string, text string")).collect()
    assert [r["path"] for r in out] == ["/1", "/2", "/3", "/4"]
    assert [(p["name"], p["in"], p["type"]) for p in out[0]["params"]] == [("id", "path", "integer"), ("all", "query", "string"), ("X, y", "header", "string")]
    assert out[0]["body"] == "List<Map<String, Form>>"
    assert java.extract_endpoints(spark.createDataFrame([("C.java", text)], "file string, text string"), mode="ref").filter("path <> '/'").count() == 3


def test_captures_of_matches_are_laid_out_without_lambdas(spark):
    t = lambda *xs: [(x,) for x in xs]
    cases = [("both", {"A": ("a",), "B": ("b",), "C": None}, {"L": t("x", None), "E": []}), ("lists", None, {"L": t("x", "y"), "M": t("z")}),
             ("empty lists", {}, {"L": [], "M": []}), ("null list", {"A": ("a",)}, {"L": None, "M": t("z")}), ("null list alone", None, {"L": None, "M": t("z")}),
             ("null element", None, {"L": [None, ("y",)]}), ("none", None, None)]
    m = spark.createDataFrame([(f, "r", ((1, 2),), (s, k)) for f, s, k in cases], records.match_fields().simpleString().replace(
        "range:struct<byteOffset:struct<start:int,end:int>,start:struct<line:int,column:int>,end:struct<line:int,column:int>>", "range:struct<byteOffset:struct<start:int,end:int>>"))
    out = records.flatten_matches(m.unionAll(m.filter("file = 'both'")))
    got = sorted((r["file"], str(r["var"]), str(r["at"]), str(r["captured"])) for r in out.collect())
    want = []
    for f, s, k in [*cases, cases[0]]:
        c = [(v, 0, x and x[0]) for v, x in (s or {}).items()]
        if k and all(x is not None for x in k.values()):
            c += [(v, i, x and x[0]) for v, xs in k.items() for i, x in enumerate(xs)]
        want += [(f, *map(str, x)) for x in c or [(None, None, None)]]
    assert got == sorted(want) and out.columns == ["file", "ruleId", "start", "end", "var", "at", "captured"]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
