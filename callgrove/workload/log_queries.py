"""Queries over transcripts, chats, worker logs, outputs, documents, and the streaming jobs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from callgrove.constants import IMPACT_PATTERNS
from callgrove.functions import sql as sqlf
from callgrove.functions import text, verdicts
from callgrove.operators import logs, reconcile
from callgrove.operators.profile import kind_counts, profile
from callgrove.operators.prune import applicable_types
from callgrove.plans.scratch import materialize, scratch_root
from callgrove.schemas import schema
from callgrove.sources import code, logs as log_sources, records
from callgrove.sources.graph import Graph, read_graph, write_graph
from callgrove.streaming import jobs
from callgrove.workload import views as V
from callgrove.workload.code_queries import ENDPOINTS_SQL, flat
from callgrove.workload.registry import Registry

R = Registry()
S = lambda c: F.col(c).cast("string")
Q = lambda s: "'" + s.replace("'", "''") + "'"

# --- graph profiles ---------------------------------------------------------------------------------


@R.query("a1_profile", f"""WITH {V.GRAPH_SQL} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM nodes WHERE kind = 'route') AS n_routes,
  (SELECT count(*) FROM nodes WHERE kind = 'method') AS n_methods, (SELECT count(*) FROM edges WHERE kind = 'calls') AS n_calls, (SELECT count(*) FROM nodes WHERE len(decorators) > 0) AS n_decorated""")
def _(spark, d):
    return profile(V.graph(spark, d))


@R.query("a2_kind_counts", f"""WITH {V.GRAPH_SQL}, {V.FILES_SQL} SELECT 'node' AS scope, kind AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM files GROUP BY 2""")
def _(spark, d):
    return kind_counts(V.graph(spark, d))


# --- transcripts ------------------------------------------------------------------------------------

@R.query("w11_assign_sessions", f"WITH {V.TRANSCRIPT_SQL} SELECT file, line_no, session_no FROM transcript")
def _(spark, d):
    return V.transcript(spark, d).select("file", "line_no", F.col("session_no").cast("long").alias("session_no"))


@R.query("f11_w4_query_log", f"""WITH {V.TRANSCRIPT_SQL}, q AS (SELECT * FROM transcript WHERE _type = 'log' AND phase = 'error' AND contains(step, 'err') AND contains(command, '"k": 7') AND status = 'fail')
  SELECT file, line_no, session_id FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS r FROM q) x WHERE r <= 2""")
def _(spark, d):
    hits = logs.query_log(V.transcript(spark, d), phase="error", step="err", command='"k": 7', status="fail")
    return logs.last_n(hits, 2, keys=["file"]).select("file", "line_no", "session_id")


@R.query("w4_last_n", f"WITH {V.TRANSCRIPT_SQL} SELECT file, line_no, phase FROM lines WHERE _type = 'log' ORDER BY line_no DESC LIMIT 20")
def _(spark, d):
    return logs.last_n(logs.query_log(V.log_lines(spark, d)), 20).select("file", "line_no", "phase")


_HEADS = """heads AS (SELECT file, arg_max(session_id, line_no) FILTER (_type = 'session_start') AS session_id, count(*) FILTER (_type = 'session_start') AS total_sessions, count(*) FILTER (_type = 'session_end') AS closed_sessions FROM transcript GROUP BY 1),
  ended AS (SELECT DISTINCT file, session_id FROM transcript WHERE _type = 'session_end'), cur AS (SELECT h.*, h.session_id IS NOT NULL AND e.session_id IS NULL AS active FROM heads h LEFT JOIN ended e ON e.file = h.file AND e.session_id = h.session_id)"""


@R.query("w3_current_session", f"WITH {V.TRANSCRIPT_SQL}, {_HEADS} SELECT * FROM cur")
def _(spark, d):
    return logs.current_session(V.transcript(spark, d), ["file"])


@R.query("a16_log_status", f"""WITH {V.TRANSCRIPT_SQL}, {_HEADS}, l AS (SELECT file, session_id, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, string_agg(DISTINCT phase, ',' ORDER BY phase) AS phases FROM transcript WHERE _type = 'log' GROUP BY 1, 2)
  SELECT c.file, CASE WHEN active THEN c.session_id END AS active_session, total_sessions, closed_sessions, CASE WHEN active THEN coalesce(n, 0) ELSE 0 END AS entries, CASE WHEN active THEN coalesce(ok, 0) ELSE 0 END AS ok_count,
  CASE WHEN active THEN coalesce(n - ok, 0) ELSE 0 END AS fail_count, CASE WHEN active THEN coalesce(phases, '') ELSE '' END AS phases FROM cur c LEFT JOIN l ON l.file = c.file AND l.session_id = c.session_id""")
def _(spark, d):
    return logs.log_status(V.transcript(spark, d), ["file"])


@R.query("a17_close_session", f"""WITH {V.TRANSCRIPT_SQL} SELECT file, session_id, count(*) FILTER (_type = 'log') AS log_entries, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS total_duration_ms,
  coalesce(string_agg(DISTINCT phase, ',' ORDER BY phase) FILTER (_type = 'log'), '') AS phases_completed FROM transcript GROUP BY 1, 2""")
def _(spark, d):
    return logs.close_session(V.transcript(spark, d), ["file"])


@R.query("a14_repeat_failures", """SELECT role, failure_type, count(*) AS n, max(ts) AS last_ts FROM (SELECT concat('w', user_id % 20) AS role, CASE WHEN value < 20 THEN 'timeout' WHEN value < 60 THEN 'json_parse' ELSE 'stuck' END AS failure_type, ts FROM events WHERE event_type = 'error') q
  GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(spark, d):
    return logs.repeat_failures(_failures(V.table(spark, d, "events")))


def _failures(ev):
    return ev.filter("event_type = 'error'").select(
        F.concat(F.lit("w"), (F.col("user_id") % 20).cast("string")).alias("role"),
        F.when(F.col("value") < 20, "timeout").when(F.col("value") < 60, "json_parse").otherwise("stuck").alias("failure_type"), "ts")


@R.query("a15_batch_outcome", "SELECT user_id AS batch, count(*) AS run, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def _(spark, d):
    return logs.batch_outcome(V.table(spark, d, "events").select(F.col("user_id").alias("batch"), F.when(F.col("event_type") == "error", "TIMEOUT").otherwise("OK").alias("status")))


@R.query("a18_role_counts", """SELECT c.conv_id AS file, role, count(*) AS n, any_value(f.t) AS first_user FROM conversations c JOIN (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY 1) f ON f.conv_id = c.conv_id GROUP BY 1, 2""")
def _(spark, d):
    chat = V.table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), "role", F.col("text").alias("content"))
    return logs.role_counts(chat)


@R.query("s11_parse_chat", "SELECT concat(conv_id, '/', turn) AS file, CAST(1 AS INTEGER) AS line_no, CASE WHEN turn % 4 = 3 THEN 'unknown' ELSE role END AS role, text AS content FROM conversations")
def _(spark, d):
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    parts = F.array(F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    listed = F.to_json(F.struct(F.col("role").alias("type"), parts.alias("message")))
    neither = F.to_json(F.struct(F.col("text").alias("content")))
    rec = F.when(F.col("turn") % 4 == 3, neither).when(F.col("turn") % 2 == 1, listed).otherwise(plain)
    texts = V.table(spark, d, "conversations").select(F.concat(S("conv_id"), F.lit("/"), S("turn")).alias("file"), F.concat(F.lit("\n"), rec, F.lit("\n{broken\n")).alias("text"))
    return log_sources.parse_chat(texts)


@R.query("s2_parse_jsonl", """SELECT CAST(o_orderkey AS VARCHAR) AS file, 'good' AS side, CAST(1 AS INTEGER) AS line_no, concat('c', o_custkey) AS detail FROM orders UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), 'bad', 3, concat('malformed JSON at ', o_orderkey, ':3') FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, d):
    good = F.to_json(F.struct(F.concat(F.lit("c"), S("o_custkey")).alias("chain_id"), F.lit(90).alias("score")))
    texts = V.table(spark, d, "orders").select(S("o_orderkey").alias("file"), F.concat(good, F.lit("\n\n"), F.when(F.col("o_orderstatus") == "P", '{"chain_id": "x", ').otherwise(" ")).alias("text"))
    ok, bad = log_sources.parse_jsonl(texts, schema("finding"))
    return ok.select("file", F.lit("good").alias("side"), "line_no", F.col("chain_id").alias("detail")).unionByName(
        bad.select("file", F.lit("bad").alias("side"), "line_no", F.col("warning").alias("detail")))


_FILES = "SELECT *, o_orderkey // 1000 % 6 AS part, row_number() OVER (PARTITION BY o_orderkey // 1000 % 6 ORDER BY o_orderkey) AS r FROM orders"


def _in_blocks(spark, rows, read):
    """``rows(part, o_orderkey, value)`` as a text file for each part, in order, and what ``read`` makes of them in blocks of 64 kB."""
    path = f"{scratch_root(spark)}/lines-{uuid4().hex}"
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(path)
    name = "spark.sql.files.maxPartitionBytes"
    given = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        return materialize(read(path).withColumn("file", F.regexp_extract("file", "part=(\\d+)", 1)), "numbered")
    finally:
        spark.conf.set(name, given)


@R.query("s2_line_numbers", f"""WITH f AS ({_FILES}) SELECT CAST(part AS VARCHAR) AS file, CAST(r * 2 - 1 AS INTEGER) AS line_no, concat('c', o_custkey) AS detail FROM f WHERE o_orderstatus <> 'P' UNION ALL
  SELECT CAST(part AS VARCHAR), CAST(r * 2 - 1 AS INTEGER), 'malformed' FROM f WHERE o_orderstatus = 'P'""")
def _(spark, d):
    """Every second line is blank; lines of some orders are cut off."""
    good = F.to_json(F.struct(F.concat(F.lit("c"), S("o_custkey")).alias("chain_id"), F.lit(90).alias("score")))
    line = F.concat(F.when(F.col("o_orderstatus") == "P", F.substring(good, 1, 9)).otherwise(good), F.lit("\r\n"))
    rows = V.table(spark, d, "orders").select(F.expr("o_orderkey DIV 1000 % 6 AS part"), "o_orderkey", line.alias("value"))

    def read(path):
        ok, bad = log_sources.read_jsonl(spark, path, schema("finding"), line_numbers=True)
        return ok.select("file", "line_no", F.col("chain_id").alias("detail")).unionAll(bad.select("file", "line_no", F.lit("malformed")))

    return _in_blocks(spark, rows, read)


@R.query("s11_read_chat", f"""WITH f AS ({_FILES}) SELECT CAST(part AS VARCHAR) AS file, CAST(r - 1 AS INTEGER) AS line_no, lower(o_orderpriority) AS role, concat('order ', o_orderkey) AS content FROM f WHERE o_orderstatus <> 'P'""")
def _(spark, d):
    said = F.to_json(F.struct(F.lower("o_orderpriority").alias("role"), F.concat(F.lit("order "), S("o_orderkey")).alias("content")))
    rows = V.table(spark, d, "orders").select(F.expr("o_orderkey DIV 1000 % 6 AS part"), "o_orderkey", F.when(F.col("o_orderstatus") == "P", "{broken").otherwise(said).alias("value"))
    return _in_blocks(spark, rows, lambda path: log_sources.read_chat(spark, path))


@R.query("s12_read_pom", "SELECT c_custkey, concat('com.', lower(c_mktsegment)) AS group_id, concat('app', c_custkey) AS artifact_id FROM customer")
def _(spark, d):
    pom = F.concat(F.lit("<parent/><groupId> com."), F.lower("c_mktsegment"), F.lit(" </groupId>\n<artifactId>app"), S("c_custkey"), F.lit("</artifactId><version>"))
    return V.table(spark, d, "customer").select("c_custkey", *code.pom_fields(pom))


@R.query("s8_flatten_runtime", """SELECT concat('F', o_orderkey) AS finding_id, concat('E', l_linenumber, '-', l_partkey) AS id, l_suppkey AS duration_ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def _(spark, d):
    items = V.table(spark, d, "lineitem").select("l_orderkey", F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("F"), S("l_orderkey")).alias("id"), F.array(F.struct(F.concat(F.lit("E"), S("l_linenumber"), F.lit("-"), S("l_partkey")).alias("id"), F.col("l_suppkey").alias("duration_ms"))).alias("evidence"))).alias("findings"))).alias("doc"))
    docs = items.select(F.from_json("doc", schema("runtime_finding")).alias("d")).select("d.*")
    return records.flatten_runtime(docs)[1].select("finding_id", "id", "duration_ms")


@R.query("s9_flatten_matches", """SELECT CAST(l_orderkey AS VARCHAR) AS file, l_partkey AS start, v AS var, pos AS "at", c AS captured FROM (SELECT l_orderkey, CAST(l_partkey AS INTEGER) AS l_partkey, 'A' AS v, CAST(0 AS INTEGER) AS pos, l_returnflag AS c FROM lineitem
  UNION ALL SELECT l_orderkey, CAST(l_partkey AS INTEGER), 'ARGS', 0, l_linestatus FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_partkey AS INTEGER), 'ARGS', 1, CAST(l_linenumber AS VARCHAR) FROM lineitem) q""")
def _(spark, d):
    t = lambda c: F.struct(c.alias("text"))
    rec = F.struct(S("l_orderkey").alias("file"), F.struct(F.struct(F.col("l_partkey").alias("start"), F.col("l_partkey").alias("end")).alias("byteOffset")).alias("range"),
                   F.struct(F.create_map(F.lit("A"), t(F.col("l_returnflag"))).alias("single"), F.create_map(F.lit("ARGS"), F.array(t(F.col("l_linestatus")), t(S("l_linenumber")))).alias("multi")).alias("metaVariables"))
    rows = V.table(spark, d, "lineitem").select(F.from_json(F.to_json(rec), records.match_fields()).alias("m")).select("m.*")
    return records.flatten_matches(rows).select("file", "start", "var", "at", "captured")


@R.query("a27_session_usage", "SELECT count(*) AS n, CAST(sum(tin) AS BIGINT) AS tokens_input, CAST(sum(tout) AS BIGINT) AS tokens_output, round(sum(cost), 4) AS cost FROM (SELECT min_by(text, turn) AS title, sum(length(text)) AS tin, count(*) AS tout, sum(length(text)) * 0.001 AS cost FROM conversations GROUP BY conv_id) q WHERE starts_with(title, 'T')")
def _(spark, d):
    n = F.sum(F.length("text"))
    s = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"), n.alias("tokens_input"), F.count(F.lit(1)).alias("tokens_output"), (n * 0.001).alias("cost"))
    return logs.session_usage(s, "T")


@R.query("e21_process_quality", """SELECT conv_id AS session_id, count(*) FILTER (role = 'assistant') AS n_look, count(*) FILTER (role = 'user') AS n_write, count(*) FILTER (length(text) > 0 AND role <> 'user') AS n_output,
  CASE WHEN count(*) FILTER (length(text) > 0 AND role <> 'user') = 0 AND (max(turn) - min(turn)) * 300 >= 600 THEN 'HUNG' WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'REAL_WORK' ELSE 'TEMPLATE' END AS quality FROM conversations GROUP BY 1""")
def _(spark, d):
    parts = V.table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.when(F.col("role") == "assistant", "read").when(F.col("role") == "user", "write").otherwise("note").alias("tool"),
        F.when(F.col("role") == "user", "").otherwise(F.col("text")).alias("output"), F.timestamp_seconds(F.col("turn") * 300).alias("ts"))
    return reconcile.process_quality(parts)


# --- sources and sinks: write to the shared scratch space, read back ---------------------------------

def _home(spark, name):
    return f"{scratch_root(spark)}/{name}-{uuid4().hex}"


@R.query("s1_read_graph", f"WITH {V.GRAPH_SQL} SELECT 'node' AS scope, kind AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY 2")
def _(spark, d):
    g, home = V.graph(spark, d), _home(spark, "graph")
    fill = lambda df, name: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])
    write_graph(Graph(fill(g.nodes, "nodes"), fill(g.edges, "edges"), fill(g.files, "files")), home)
    back = read_graph(spark, home)
    return kind_counts(Graph(back.nodes, back.edges))


@R.query("s3_append_jsonl", "SELECT user_id AS worker, 2 * count(*) AS n, max(ts) AS last_ts FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, d):
    home = _home(spark, "failures")
    rows = V.table(spark, d, "events").filter("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("ts"), S("user_id").alias("role"), F.lit("timeout").alias("failure_type"))
    log_sources.append_jsonl(rows, home)
    log_sources.append_jsonl(rows, home)
    back, _bad = log_sources.read_log(spark, home, "failures")
    return back.groupBy(F.col("role").cast("long").alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@R.query("s6_read_preset", "SELECT concat('com.', lower(n_name)) AS group_id, CAST(n_regionkey AS VARCHAR) AS framework, 2 AS n_types FROM nation")
def _(spark, d):
    home = _home(spark, "presets")
    fw = S("n_regionkey")
    docs = V.table(spark, d, "nation").select("n_nationkey", F.struct(F.concat(F.lit("com."), F.lower("n_name")).alias("groupId")).alias("project"),
                                              F.struct(fw.alias("primary")).alias("framework"), F.create_map(fw, F.array(F.lit("a"), F.lit("b"))).alias("tech_stack_vuln_whitelist"))
    docs.repartition("n_nationkey").write.partitionBy("n_nationkey").json(home)
    back = code.read_preset(spark, home)
    return back.select(F.col("project.groupId").alias("group_id"), F.col("framework.primary").alias("framework"),
                       F.size(F.try_element_at("tech_stack_vuln_whitelist", F.col("framework.primary"))).alias("n_types"))


@R.query("s10_read_findings", f"WITH {V.FINDINGS_SQL} SELECT severity, count(*) AS n, CAST(sum(len(evidence)) AS BIGINT) AS n_evidence, CAST(sum(score) AS BIGINT) AS score FROM findings GROUP BY 1")
def _(spark, d):
    home = _home(spark, "findings")
    log_sources.append_jsonl(V.findings(spark, d).drop("ts", "n"), home)
    good, _bad = records.read_findings(spark, home)
    return good.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("evidence")).alias("n_evidence"), F.sum("score").alias("score"))


@R.query("s13_read_sessions", "SELECT conv_id AS session_id, to_timestamp(1704067200 + conv_id * 60)::TIMESTAMP AS created, count(*) AS n_parts, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY 1")
def _(spark, d):
    home, t = _home(spark, "sessions"), V.table(spark, d, "conversations")
    ms = (F.lit(1704067200) + F.col("conv_id") * 60) * 1000
    s = t.select(S("conv_id").alias("id"), F.lit("t").alias("title"), ms.alias("time_created"), F.lit(1).cast("long").alias("tokens_input"), F.lit(1).cast("long").alias("tokens_output"), F.lit(0.0).alias("cost")).distinct()
    s.write.parquet(f"{home}/session")
    t.select(F.concat_ws("/", S("conv_id"), S("turn")).alias("id"), S("conv_id").alias("session_id"), F.lit("text").alias("type"),
             F.to_json(F.struct("role", "text")).alias("data"), ms.alias("time_created")).write.parquet(f"{home}/part")
    sessions, parts = log_sources.read_sessions(spark, home)
    n = parts.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_parts"), F.count_if(F.variant_get("data", "$.role", "string") == "user").alias("n_user"))
    return sessions.join(n, sessions["id"] == n["session_id"]).select(F.col("id").cast("long").alias("session_id"), F.col("time_created").alias("created"), "n_parts", "n_user")


@R.query("s15_write_rounds", f"WITH {V.ROUNDS_SQL} SELECT round, CAST(total_reports AS INTEGER) AS total_reports, p54_pass FROM rounds")
def _(spark, d):
    home = _home(spark, "rounds")
    log_sources.write_rounds(V.rounds(spark, d), home)
    return log_sources.read_log(spark, home, "rounds")[0].select("round", "total_reports", "p54_pass")


@R.query("s16_write_kv", f"WITH {V.KV_SQL} SELECT kind, CASE WHEN kind <> 'global' THEN commit_hash END AS commit_hash, count(*) AS n, count(DISTINCT key) AS n_keys FROM kv GROUP BY 1, 2")
def _(spark, d):
    home = _home(spark, "kv")
    records.write_kv(V.kv(spark, d).withColumnRenamed("body", "value"), home)
    back = records.read_kv(spark.read.parquet(home).select("key", "value", "written_at"))
    return back.groupBy("kind", "commit_hash").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"))


# --- state histories --------------------------------------------------------------------------------

_STATE = "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'purchase' THEN 'PAID' WHEN 'view' THEN 'SHIPPED' WHEN 'click' THEN 'REFUNDED' ELSE 'DELIVERED' END"


@R.query("w9_illegal_transitions", f"""WITH e AS (SELECT user_id, event_id, ts, {_STATE} AS s FROM events), l AS (SELECT *, lag(s) OVER w AS f, lag(ts) OVER w AS pt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  k AS (SELECT *, list_position(['PENDING', 'PAID', 'SHIPPED', 'DELIVERED', 'CONFIRMED'], f) AS pf, list_position(['PENDING', 'PAID', 'SHIPPED', 'DELIVERED', 'CONFIRMED'], s) AS pto FROM l WHERE f IS NOT NULL)
  SELECT user_id, event_id, ts, f AS from_state, s AS to_state, CASE WHEN f = s THEN 'repeated' WHEN pf > 0 AND pto > 0 AND pto < pf THEN 'reversed' WHEN pf > 0 AND pto > pf + 1 THEN 'skipped' ELSE 'not_allowed' END AS fault FROM k
  WHERE NOT ((f = 'PENDING' AND s = 'PAID') OR (f = 'PAID' AND s = 'SHIPPED') OR (f = 'SHIPPED' AND s = 'DELIVERED') OR (f = 'PAID' AND s = 'REFUNDED' AND epoch_us(ts) - epoch_us(pt) <= 604800000000))""")
def _(spark, d):
    ev = V.table(spark, d, "events").select("user_id", "event_id", "ts", F.expr(_STATE).alias("state"))
    return logs.illegal_transitions(ev, "user_id", "ts", "event_id", "state", F.to_date("ts"))


@R.query("w10_racing_updates", """SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(p) AS gap_us FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) q WHERE epoch_us(ts) - epoch_us(p) <= 600000000""")
def _(spark, d):
    out = logs.racing_updates(V.table(spark, d, "events"), "user_id", "ts", "event_id", 600_000, F.to_date("ts"))
    return out.select("user_id", "event_id", "ts", "gap_us")


@R.query("a25_round_trend", f"""WITH {V.ROUNDS_SQL}, l AS (SELECT *, lag(total_reports) OVER (ORDER BY round) AS prev FROM rounds), c AS (SELECT *, coalesce(abs(total_reports - prev) <= prev * 0.1, false) AS calm FROM l)
  SELECT round + round // 3 AS round, CAST(total_reports AS BIGINT) AS reports, CAST(n_poc AS BIGINT) AS poc, p54_pass AS passed, total_reports - prev AS change,
  count(*) FILTER (calm) OVER (ORDER BY round ROWS 2 PRECEDING) = 3 AS steady FROM c""")
def _(spark, d):
    """Every fourth number is left out, so the round before is not always the number before."""
    r = F.col("round")
    return reconcile.round_trend(V.rounds(spark, d).withColumn("round", (r + F.floor(r / 3)).cast("int")))


@R.query("w5_delta", "WITH v AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS version, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY version) AS prev, n - lag(n) OVER (PARTITION BY user_id ORDER BY version) AS delta FROM v")
def _(spark, d):
    v = V.table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("version")).agg(F.count(F.lit(1)).alias("n"))
    return reconcile.delta(v, "user_id", "version", "n")


@R.query("w8_resume_round", f"WITH {V.ROUNDS_SQL} SELECT CAST(coalesce(max(round) FILTER (p54_pass), 0) + 1 AS INTEGER) AS next_round FROM rounds")
def _(spark, d):
    return reconcile.resume_round(V.rounds(spark, d))


# --- texts and outputs ------------------------------------------------------------------------------

_HITS = ", ".join("CAST(" + " + ".join(f"len(regexp_extract_all(text, {Q(p)}))" for p in ps) + f" AS INTEGER) AS n_{k}" for k, ps in IMPACT_PATTERNS.items())
_EGS = ", ".join("coalesce(" + ", ".join(f"nullif(regexp_extract(text, {Q('(' + p + ')')}, 1), '')" for p in ps) + f") AS eg_{k}" for k, ps in IMPACT_PATTERNS.items())


@R.query("e18_impact_evidence", f"WITH h AS (SELECT doc_id, {_HITS}, {_EGS} FROM documents) SELECT *, CAST((n_confidentiality = 0)::INT + (n_integrity = 0)::INT + (n_availability = 0)::INT AS INTEGER) AS n_empty FROM h")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.impact_evidence(F.col("text")).alias("e")).select("doc_id", "e.*")


@R.query("e19_judge_response", f"""WITH h AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 + page_id % 7 END AS code, regexp_matches(html, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}') AS ev FROM pages)
  SELECT page_id, CASE WHEN code < 300 AND ev THEN 'PASS' WHEN code < 300 THEN 'FAIL' WHEN code = 404 THEN 'RECHECK' ELSE 'FAIL' END AS verdict FROM h""")
def _(spark, d):
    p = F.col("page_id")
    c = F.when(p % 5 == 0, 404).when(p % 5 == 1, 500).otherwise(200 + p % 7)
    return V.table(spark, d, "pages").select("page_id", verdicts.judge_response(c, F.col("html").rlike(IMPACT_PATTERNS["confidentiality"][2])).alias("verdict"))


@R.query("e27_leaks", r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)password\s*[:=]') THEN 'password' END, CASE WHEN regexp_matches(text, '(?i)token') THEN 'token' END, CASE WHEN regexp_matches(text, '\b\d{17}[\dXx]\b') THEN 'id_card' END,
  CASE WHEN regexp_matches(text, '\b\d{16,19}\b') THEN 'bank_card' END, CASE WHEN regexp_matches(text, 'printStackTrace\(|(?i:stack\s*trace)') THEN 'stack_output' END,
  CASE WHEN regexp_matches(text, '(?i)log\w*\.(?:info|debug|warn|error)\([^)]*(?:password|token|secret)') THEN 'secret_log' END) AS leaks FROM documents""")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.array_join(text.leaks(F.col("text")), ",").alias("leaks"))


_RED = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("ip", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), ("bearer", r"Bearer\s+[A-Za-z0-9._-]+"), ("secret", r"(?i)(?:password|token|api[_-]?key)\s*[:=]\s*\S+")]


def _redact_sql():
    ctes, prev = [], "SELECT doc_id, text AS t, 0 AS n, [] :: VARCHAR[] AS k FROM documents"
    for i, (kind, p) in enumerate(_RED):
        ctes.append(f"r{i} AS (SELECT doc_id, regexp_replace(t, {Q(p)}, '[REDACTED]', 'g') AS t, n + len(regexp_extract_all(t, {Q(p)})) AS n, CASE WHEN regexp_matches(t, {Q(p)}) THEN list_append(k, '{kind}') ELSE k END AS k FROM ({prev}) q)")
        prev = f"SELECT * FROM r{i}"
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, sha256(t) AS digest, CAST(n AS INTEGER) AS redaction_count, array_to_string(k, ',') AS redaction_types FROM r{len(_RED) - 1}"


@R.query("e28_redact", _redact_sql())
def _(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("r"))
    return rows.select("doc_id", F.sha2("r.text", 256).alias("digest"), "r.redaction_count", F.array_join("r.redaction_types", ",").alias("redaction_types"))


@R.query("e29_excerpt", "SELECT doc_id, substr(text, 1, 500) AS output_excerpt, sha256(text) AS output_sha256, length(text) > 500 AS external FROM documents")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("x")).select("doc_id", "x.*")


_ERR = "no class found|no classloader found|class\\s+\\S+\\s+not\\s+found|no method found|error:|exception|not support|agent(\\s+|-).*offline"
_OUT = "CASE WHEN event_type = 'error' THEN concat('Error: ', props) WHEN event_type = 'view' THEN concat('Class x', user_id, ' not found') WHEN event_type = 'signup' THEN 'Agent- is OFFLINE' WHEN value < 5 THEN '' ELSE concat('row ', user_id) END"


@R.query("e30_classify_output", f"SELECT event_id, CASE WHEN o = '' OR regexp_matches(lower(o), {Q(_ERR)}) THEN 'ARTHAS_ERROR' ELSE 'OK' END AS status FROM (SELECT event_id, {_OUT} AS o FROM events) q")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", verdicts.classify_output(F.expr(_OUT)).alias("status"))


_CODE = "CASE WHEN event_id % 10 = 0 THEN 401 WHEN event_id % 10 = 1 THEN 404 WHEN event_id % 10 = 2 THEN 503 WHEN event_id % 10 = 3 THEN NULL ELSE 200 END"
_ST = "CASE event_type WHEN 'view' THEN 'SCHEDULED' WHEN 'click' THEN 'FAILED' ELSE 'SUCCEEDED' END"


@R.query("e31_classify_result", f"""WITH q AS (SELECT event_id, {_CODE} AS c, {_ST} AS s, {_OUT} AS o FROM events), r AS (SELECT event_id, CASE WHEN c IS NULL AND event_id % 2 = 0 THEN 'TIMEOUT' WHEN c IS NULL THEN 'CONNECTION_ERROR' WHEN c = 401 THEN 'AUTH_FAILURE' WHEN c = 404 THEN 'AGENT_OFFLINE' WHEN c >= 500 THEN 'CONNECTION_ERROR'
  WHEN s = 'SUCCEEDED' THEN CASE WHEN o = '' OR regexp_matches(lower(o), {Q(_ERR)}) THEN 'ARTHAS_ERROR' ELSE 'OK' END WHEN s = 'SCHEDULED' THEN 'TIMEOUT' ELSE 'ARTHAS_ERROR' END AS status FROM q)
  SELECT event_id, status, CAST(CASE status WHEN 'OK' THEN 0 WHEN 'CONNECTION_ERROR' THEN 10 WHEN 'TIMEOUT' THEN 11 WHEN 'AUTH_FAILURE' THEN 12 WHEN 'AGENT_OFFLINE' THEN 13 ELSE 20 END AS INTEGER) AS exit_code FROM r""")
def _(spark, d):
    st = verdicts.classify_result(F.expr(_CODE), F.expr(_ST), F.expr(_OUT), F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("refused"))
    return V.table(spark, d, "events").select("event_id", st.alias("status")).withColumn("exit_code", verdicts.exit_code(F.col("status")))


@R.query("e32_extract_output", "SELECT event_id, concat(CASE event_type WHEN 'view' THEN '3.7' WHEN 'click' THEN 'class X' WHEN 'signup' THEN 'rowCount: 4' ELSE concat('m', user_id) END, chr(10), 'tail') AS output FROM events")
def _(spark, d):
    one = F.expr("""CASE event_type WHEN 'view' THEN '{"type":"version","version":"3.7"}' WHEN 'click' THEN '{"type":"jad","source":"class X"}' WHEN 'signup' THEN '{"type":"row_affect","rowCount":4}'
        ELSE concat('{"type":"message","message":"m', user_id, '"}') END""")
    res = F.concat(F.lit('[{"type":"status","statusCode":0},'), one, F.lit(',{"type":"other","command":"tail"}]'))
    return V.table(spark, d, "events").select("event_id", verdicts.extract_output(res).alias("output"))


@R.query("e33_parse_verdict", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'y' WHEN 'assistant' THEN 'n' ELSE 'o' END AS verdict, concat('why ', turn) AS note, CAST(turn AS VARCHAR) AS k FROM conversations")
def _(spark, d):
    letter = F.when(F.col("role") == "user", "**Y**").when(F.col("role") == "assistant", "# n").otherwise("o.")
    ans = F.concat(F.lit("```\nAnalysis follows\n"), letter, F.lit("\nwhy "), S("turn"), F.lit("\n```"))
    arr = F.concat(F.lit('```json\n[{"key": "'), S("turn"), F.lit('", "verdict": "y"}]\n```'))
    return V.table(spark, d, "conversations").select("conv_id", "turn", verdicts.parse_verdict(ans).alias("v"), verdicts.parse_verdict_array(arr)[0]["key"].alias("k")).select("conv_id", "turn", "v.*", "k")


@R.query("f20_is_retryable", "SELECT event_id, NOT (event_type IN ('click', 'signup')) AS retryable FROM events")
def _(spark, d):
    cmd = F.when(F.col("event_type") == "click", "Redefine /tmp/x").when(F.col("event_type") == "signup", "vmtool --action forceGc").otherwise(F.concat(F.lit("sc "), "event_type"))
    return V.table(spark, d, "events").select("event_id", verdicts.is_retryable(cmd).alias("retryable"))


@R.query("f13_strip_frames", "SELECT event_id, CASE WHEN event_type = 'error' THEN concat('app.', event_type) ELSE concat('app.', event_type, ';java.lang.String') END AS stack FROM events")
def _(spark, d):
    own = F.concat(F.lit("app."), "event_type")
    tail = F.when(F.col("event_type") == "error", "sun.reflect.Y").otherwise("java.lang.String")
    return V.table(spark, d, "events").select("event_id", F.array_join(verdicts.strip_frames(F.array(F.lit("java.lang.reflect.Method"), own, tail)), ";").alias("stack"))


@R.query("f12_applicable_types", "SELECT p_partkey, p_type AS vuln_type FROM part WHERE p_type IN ('ECONOMY', 'LARGE')")
def _(spark, d):
    preset = V.table(spark, d, "region").filter("r_name = 'ASIA'").select(
        F.struct(F.lower("r_name").alias("primary")).alias("framework"),
        F.create_map(F.lit("asia"), F.array(F.lit("ECONOMY"), F.lit("LARGE")), F.lit("x"), F.array(F.lit("SMALL"))).alias("tech_stack_vuln_whitelist"))
    return applicable_types(V.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("vuln_type")), preset).select("p_partkey", "vuln_type")


@R.query("e40_level_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['致命','严重','中危','低危'][1 + l_linenumber % 4] AS level, ['CRITICAL','HIGH','MEDIUM','LOW'][1 + l_linenumber % 4] AS name, CAST(1 + l_linenumber % 4 AS INTEGER) AS rank FROM lineitem")
def _(spark, d):
    level = F.get(F.array(*map(F.lit, ["致命", "严重", "中危", "低危"])), F.col("l_linenumber") % 4)
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", level.alias("level"), verdicts.level_name(level).alias("name"), verdicts.level_rank(level).alias("rank"))


@R.query("f10_run_sql", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY 1")
def _(spark, d):
    return sqlf.run_sql(spark, "SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = :state AND o_totalprice > :least GROUP BY 1",
                        {"state": "F", "least": 100000}, orders=V.table(spark, d, "orders"))


@R.query("x1_sql_functions", r"""SELECT p_partkey, CASE WHEN p_name ILIKE '%exec%' THEN 'RCE' END AS sink, 'LOW' AS risk, left(sha256(p_name), 16) AS h, '/' || replace(p_brand, '#', '') || '/' || p_type AS path, 'string' AS t, CAST(1 AS INTEGER) AS r FROM part""")
def _(spark, d):
    sqlf.register_functions(spark)
    return spark.sql("""SELECT p_partkey, sink_type(p_name) AS sink, path_risk(p_name) AS risk, short_hash(p_name) AS h, join_path(replace(p_brand, '#', ''), p_type) AS path,
        java_schema_type(p_type) AS t, level_rank('致命') AS r FROM {part}""", part=V.table(spark, d, "part"))


@R.query("x2_mapped_endpoints", f"""WITH {V.JAVA_SQL}, m AS (SELECT file, unnest(regexp_extract_all(text, '@(Post|Get|Put|Delete|Patch|Request)Mapping\\s*\\((?:[^()"]|"[^"]*"|\\([^()]*\\))*\\)')) AS s FROM sources),
  a AS (SELECT file, regexp_extract(s, '^@(\\w+)Mapping', 1) AS kind, trim(regexp_extract(s, '(?s)Mapping\\s*\\((.*)\\)$', 1)) AS args FROM m),
  p AS (SELECT *, string_split(regexp_replace(args, '(produces|consumes)\\s*=\\s*"[^"]*"', ''), '"') AS bits FROM a)
  SELECT file, kind, args, unnest(list_filter(bits, lambda x, i: i % 2 = 0)) AS path FROM p""")
def _(spark, d):
    sqlf.register_endpoint_function(spark)
    return spark.sql("SELECT s.file, e.kind, e.args, e.path FROM {sources} AS s, LATERAL mapped_endpoints(s.text) AS e", sources=V.sources(spark, d).select("file", "text"))


@R.query("x2_extract_endpoints", f"WITH {ENDPOINTS_SQL} SELECT * FROM endpoints")
def _(spark, d):
    """The table function must give what the operator does, so both are held against the same SQL."""
    sqlf.register_extract_endpoints(spark)
    return flat(spark.sql("SELECT s.file, e.* FROM {sources} AS s, LATERAL extract_endpoints(s.text) AS e", sources=code.controllers(V.sources(spark, d)).select("file", "text")))


# --- streaming --------------------------------------------------------------------------------------

def _stream(spark, d, name="events"):
    path, shape = d, V.table(spark, d, name).schema
    out = jobs.stream_log(spark, path, shape, "parquet", f"{name}.parquet")
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out


_CLOSED = "SELECT max(ts) - INTERVAL 10 MINUTE FROM events"


def _sessions_sql(key, gap):
    return f"""g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) < INTERVAL {gap} THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS sn FROM g)"""


@R.query("r1_stream_log", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    once = jobs.distinct_records(_stream(spark, d), ["event_id"])
    return jobs.run_to_table(once, "append", "log").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@R.query("r2_heartbeat", f"""WITH {_sessions_sql('user_id', '1 HOUR')} SELECT user_id AS worker, min(ts) AS first_seen, max(ts) + INTERVAL 1 HOUR AS killed_at, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS completed,
  count(*) FILTER (event_type <> 'purchase') AS remaining FROM s GROUP BY user_id, sn HAVING max(ts) + INTERVAL 1 HOUR <= ({_CLOSED})""")
def _(spark, d):
    ev = _stream(spark, d).select(F.col("user_id").alias("worker"), "ts", (F.col("event_type") == "purchase").alias("done"))
    return jobs.run_to_table(jobs.heartbeat(ev), "append", "heartbeat").drop("batch")


@R.query("r4_debounce", f"""WITH {_sessions_sql('user_id % 10', '2 SECOND')} SELECT user_id % 10 AS project, min(ts) AS first_change, max(ts) + INTERVAL 2 SECOND AS sync_at, count(*) AS n_changes FROM s GROUP BY user_id % 10, sn
  HAVING max(ts) + INTERVAL 2 SECOND <= ({_CLOSED})""")
def _(spark, d):
    ev = _stream(spark, d).select((F.col("user_id") % 10).alias("project"), "ts")
    return jobs.run_to_table(jobs.debounce(ev), "append", "debounce").drop("batch")


@R.query("r5_failure_alerts", """SELECT role, failure_type, count(*) AS n, max(ts) AS last_ts FROM (SELECT concat('w', user_id % 20) AS role, CASE WHEN value < 20 THEN 'timeout' WHEN value < 60 THEN 'json_parse' ELSE 'stuck' END AS failure_type, ts FROM events WHERE event_type = 'error') q
  GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(spark, d):
    return jobs.latest(jobs.run_to_table(jobs.failure_alerts(_failures(_stream(spark, d))), "update", "alerts"), ["role", "failure_type"])


@R.query("r6_prune_rates", f"""SELECT date_trunc('hour', ts) AS from_ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS to_ts, event_type AS rule_id, count(*) AS hits FROM events GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= ({_CLOSED})""")
def _(spark, d):
    ev = _stream(spark, d).select("ts", F.col("event_type").alias("rule_id"))
    return jobs.run_to_table(jobs.prune_rates(ev), "append", "rates").drop("batch")


@R.query("r6_false_kill_share", f"""WITH w AS (SELECT event_type AS rule_id, value > 100 AS fk, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS from_ts FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) o)
  SELECT from_ts, rule_id, count(*) AS hits, count(*) FILTER (fk) AS false_kills, round(count(*) FILTER (fk) / count(*), 6) AS share FROM w GROUP BY 1, 2 HAVING from_ts + INTERVAL 1 HOUR <= ({_CLOSED})""")
def _(spark, d):
    ev = _stream(spark, d).select("ts", F.col("event_type").alias("rule_id"), (F.col("value") > 100).alias("false_kill"))
    return jobs.run_to_table(jobs.false_kill_share(ev), "append", "share").drop("batch")


@R.query("r7_promote_stream", """WITH s AS (SELECT l_orderkey AS chain_id, l_linenumber AS round, CAST(max(least(100, 60 + l_quantity)) AS INTEGER) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY round DESC) AS r FROM s),
  p AS (SELECT chain_id, count(*) AS n, min(round) AS lo, max(round) AS last_round, min(score) AS worst FROM r WHERE r <= 3 GROUP BY 1) SELECT chain_id, last_round, worst, n = 3 AND last_round - lo = 2 AND worst > 70 AS promoted FROM p""")
def _(spark, d):
    best = F.least(F.lit(100), 60 + F.col("l_quantity")).cast("int")
    scores = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chain_id"), F.col("l_linenumber").alias("round")).agg(F.max(best).alias("score"))
    home = _home(spark, "score-log")
    scores.write.parquet(home)
    states = jobs.promote_stream(jobs.stream_log(spark, home, scores.schema, "parquet"), threshold=70)
    return jobs.latest(jobs.run_to_table(states, "update", "promote", idle_batches=False), ["chain_id"])


@R.query("r8_session_status", """WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100)
  SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS phase, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS fail FROM events WHERE user_id NOT IN (SELECT user_id FROM c) AND event_type NOT IN ('signup', 'purchase') GROUP BY 1, 2""")
def _(spark, d):
    kind = F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "purchase", "session_end").otherwise("log")
    lines = _stream(spark, d).select(S("user_id").alias("session_id"), kind.alias("_type"), F.col("event_type").alias("phase"), F.when(F.col("event_type") == "error", "fail").otherwise("ok").alias("status"))
    closed = V.table(spark, d, "events").filter("event_type = 'purchase' AND value > 100").select(S("user_id").alias("session_id"))
    return jobs.latest(jobs.run_to_table(jobs.session_status(lines, closed), "update", "status"), ["session_id", "phase"])
