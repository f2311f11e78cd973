"""The library's tables derived from the benchmark tables, each in Spark and as the oracle's SQL.

Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.plans.chunked import neighbour
from callgrove.sources.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- code graph: customers and brands are classes, orders and parts are methods -------------------

NODES = """
SELECT 'c' || c_custkey AS id, 'class' AS kind, c_name AS name, concat('shop::Customer', c_custkey) AS qualified_name,
  concat('shop/Customer', c_custkey, '.java') AS file_path, 1 AS start_line, 100000 AS end_line,
  CAST(NULL AS ARRAY<STRING>) AS decorators FROM customer
UNION ALL
SELECT 'f' || c_custkey, 'field', concat('nation', c_nationkey), concat('shop::Customer', c_custkey, '::nation'),
  concat('shop/Customer', c_custkey, '.java'), 2, 2, NULL FROM customer
UNION ALL
SELECT 'm' || o_orderkey, 'method', concat('order', o_orderkey), concat('shop::Customer', o_custkey, '::order', o_orderkey),
  concat('shop/Customer', o_custkey, '.java'), datediff(o_orderdate, DATE'1995-01-01') + 3,
  datediff(o_orderdate, DATE'1995-01-01') + 3 + CAST(floor(o_totalprice / 5000) AS INT),
  CASE WHEN o_orderstatus = 'P' THEN array('@PreAuthorize') END FROM orders
UNION ALL
SELECT 'r' || o_orderkey, 'route',
  concat(CASE o_orderpriority WHEN '1-URGENT' THEN 'POST' WHEN '2-HIGH' THEN 'PUT' WHEN '5-LOW' THEN 'DELETE' ELSE 'GET' END,
    ' /customer/', o_custkey, '/order/', o_orderkey), concat('shop::Customer', o_custkey, '::route', o_orderkey),
  concat('shop/Customer', o_custkey, '.java'), datediff(o_orderdate, DATE'1995-01-01') + 3,
  datediff(o_orderdate, DATE'1995-01-01') + 3, NULL FROM orders WHERE o_orderstatus = 'O'
UNION ALL
SELECT 'p' || p_partkey, 'method', name, concat('lib::', brand, '::', name), concat('lib/', brand, '.java'),
  p_size * 10, p_size * 10 + CAST(floor(p_retailprice / 100) AS INT), NULL FROM (
  SELECT p_partkey, p_size, p_retailprice, replace(p_brand, '#', '') AS brand,
    concat(CASE p_type WHEN 'ECONOMY' THEN 'executeQuery' WHEN 'LARGE' THEN 'RuntimeExec' WHEN 'MEDIUM' THEN 'readObject'
      WHEN 'PROMO' THEN 'openConnection' WHEN 'SMALL' THEN 'Paths.get' ELSE 'render' END, '_', replace(p_name, ' ', '_')) AS name
  FROM part) p
UNION ALL
SELECT DISTINCT 'b' || replace(p_brand, '#', ''), 'class', concat(replace(p_brand, '#', ''), 'Controller'),
  concat('lib::', replace(p_brand, '#', '')), concat('lib/', replace(p_brand, '#', ''), '.java'), 1, 100000, NULL FROM part
"""
NODES_SQL = (NODES.replace("CAST(NULL AS ARRAY<STRING>)", "CAST(NULL AS VARCHAR[])")
             .replace("datediff(o_orderdate, DATE'1995-01-01')", "CAST(date_diff('day', DATE '1995-01-01', o_orderdate) AS INT)")
             .replace("array('@PreAuthorize')", "['@PreAuthorize']"))

EDGES_SQL = """
SELECT 'c' || o_custkey AS source, 'm' || o_orderkey AS target, 'contains' AS kind, CAST(NULL AS INT) AS line FROM orders
UNION ALL SELECT 'b' || replace(p_brand, '#', ''), 'p' || p_partkey, 'contains', NULL FROM part
UNION ALL SELECT 'r' || o_orderkey, 'm' || o_orderkey, 'references', NULL FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'm' || l_orderkey, 'p' || l_partkey, 'calls', l_linenumber FROM lineitem
UNION ALL SELECT 'm' || o_orderkey, 'm' || nxt, 'calls', 0 FROM (
  SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) q
  WHERE nxt IS NOT NULL
UNION ALL SELECT 'm' || hi, 'm' || lo, 'calls', 0 FROM (
  SELECT o_custkey, arg_max(o_orderkey, {k}) AS hi, arg_min(o_orderkey, {k}) AS lo FROM orders GROUP BY o_custkey) q
""".replace("{k}", "struct_pack(d := o_orderdate, k := o_orderkey)")

GRAPH_SQL = f"nodes AS MATERIALIZED ({NODES_SQL}), edges AS MATERIALIZED ({EDGES_SQL})"


_plans: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a table folder; its plan is analysed once per application (no data is kept)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _plans:
        _plans[key] = _graph(spark, sf_dir)
    return _plans[key]


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders of a customer call the next one, the last calls the first (a cycle), and each order calls its parts."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "part", "lineitem")}
    nodes = spark.sql(NODES.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}")
                      .replace("FROM part", "FROM {part}"), customer=t["customer"], orders=t["orders"], part=t["part"])
    o, line = t["orders"], F.lit(None).cast("int")
    mid = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    brand = F.concat(F.lit("b"), F.replace("p_brand", F.lit("#"), F.lit("")))
    row = lambda df, s, d, kind, at: df.select(s.alias("source"), d.alias("target"), F.lit(kind).alias("kind"), at.alias("line"))
    nxt = neighbour(o.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"],
                    F.year("o_orderdate"), F.col("o_orderkey"), "nxt", forward=True).filter("nxt is not null")
    when = F.struct("o_orderdate", "o_orderkey")
    ends = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", when).alias("hi"), F.min_by("o_orderkey", when).alias("lo"))
    edges = (row(o, tag("c", "o_custkey"), mid("o_orderkey"), "contains", line)
             .unionAll(row(t["part"], brand, tag("p", "p_partkey"), "contains", line))
             .unionAll(row(o.filter("o_orderstatus = 'O'"), tag("r", "o_orderkey"), mid("o_orderkey"), "references", line))
             .unionAll(row(t["lineitem"], mid("l_orderkey"), tag("p", "l_partkey"), "calls", F.col("l_linenumber")))
             .unionAll(row(nxt, mid("o_orderkey"), mid("nxt"), "calls", F.lit(0)))
             .unionAll(row(ends, mid("hi"), mid("lo"), "calls", F.lit(0))))
    return Graph(nodes, edges, files(spark, sf_dir))


FILES_SQL = """files AS (SELECT concat('docs/', lang, '/', source, '/', doc_id, '.txt') AS path, sha256(text) AS content_hash,
  lang AS language, n_chars AS size, doc_id, text FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), "doc_id", "text")


ENTRIES_SQL = """entries AS (SELECT m.id, m.qualified_name AS fqn FROM nodes r JOIN nodes m
  ON m.file_path = r.file_path AND m.start_line = r.start_line AND r.kind = 'route' AND m.kind = 'method')"""


def entries(g: Graph) -> DataFrame:
    """Endpoints: methods declared where a route is."""
    return g.methods.join(g.routes.select("file_path", "start_line"), ["file_path", "start_line"]).select(
        "id", F.col("qualified_name").alias("fqn"))


# --- Java sources: every page becomes a controller, every link a mapped method ---------------------

_LINKS = [
    ('<a href="(/[A-M][^"]*)">([^<]*)</a>',
     '\n@PostMapping(value = "{1}")\npublic String save(@RequestParam(name = "q", required = false) String word, @RequestBody Form form) {\n  return "{2}" + word;\n}\n'),
    ('<a href="(/[a-f][^"]*)">([^<]*)</a>',
     '\n@RequestMapping(path = "{1}/{id}", method = RequestMethod.PUT)\npublic int put(@PathVariable(name = "id") Long id, @RequestHeader("User-Agent") final String agent) {\n  return 1;\n}\n'),
    ('<a href="(/[^"]*)">([^<]*)</a>',
     '\n@GetMapping(produces = "text/html", value = { "{1}", "{2}/exec", "/third", "{1}/{key:[a-z]+}" })\n// lookup\n@ResponseBody\npublic Map<String, Object> find(@RequestParam int page, @RequestParam(required = false) Map<String, List<String>> all, @RequestBody List<Map<String, Form>> forms, MultipartFile file) {\n  return null;\n}\n'),
]
_HEAD = ('package site.page;\nimport org.springframework.boot.SpringApplication;\nimport java.util.Map;\n', "@RestController\n@RequestMapping(\"/", "\")\npublic class Page", " {\n")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _java_sql() -> str:
    text = "html"
    for pattern, body in _LINKS:
        body = body.replace("{1}", "\\1").replace("{2}", "\\2")
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(body)}, 'g')"
    a, b, c, d = map(_quoted, _HEAD)
    return f"""sources AS (SELECT page_id, concat('src/lessons/', regexp_extract(url, '^https?://([^/.]*)', 1), '/Page', page_id, '.java') AS file,
  {a} || CASE WHEN page_id >= 0 THEN {b} || regexp_extract(url, '^https?://[^/]*/([a-z]*)', 1) || {c} || page_id || {d} END || {text} || '\n}}' AS text FROM pages)"""


JAVA_SQL = _java_sql()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("html")
    for pattern, body in _LINKS:
        text = F.regexp_replace(text, pattern, body.replace("$", "\\$").replace("{1}", "$1").replace("{2}", "$2"))
    a, b, c, d = map(F.lit, _HEAD)
    page = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("src/lessons/"), F.regexp_extract("url", r"^https?://([^/.]*)", 1), F.lit("/Page"), page, F.lit(".java")).alias("file"),
        F.concat(a, b, F.regexp_extract("url", "^https?://[^/]*/([a-z]*)", 1), c, page, d, text, F.lit("\n}")).alias("text"))


# --- findings: one per order ------------------------------------------------------------------------

FINDINGS = """
SELECT left(sha2(concat('m', o_orderkey), 256), 16) AS chain_id, concat('GET /customer/', o_custkey) AS endpoint,
  concat('shop::Customer', o_custkey) AS endpoint_fqn, concat('shop::Customer', o_custkey, '::order', o_orderkey) AS fqn,
  CASE year(o_orderdate) WHEN 1995 THEN 'A' WHEN 1996 THEN 'B' WHEN 1997 THEN 'C' WHEN 1998 THEN 'D' WHEN 1999 THEN 'INFO' ELSE 'X' END AS mode,
  CASE o_orderstatus WHEN 'F' THEN 'MISSING_AUTH' WHEN 'O' THEN 'SQL_INJECTION' ELSE 'IDOR' END AS vuln_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'INFO' END AS severity,
  round(o_totalprice / 450000, 4) AS confidence,
  array(concat('Customer', o_custkey, '.java:', day(o_orderdate), ' (call)'), CASE WHEN o_orderstatus = 'P' THEN 'see log' ELSE concat('Dao.java:', month(o_orderdate)) END) AS evidence,
  concat('order ', o_orderkey) AS summary,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed_vuln' WHEN 'O' THEN 'pending' ELSE 'confirmed_safe' END AS poc_status,
  CASE WHEN o_totalprice > 250000 THEN 'final' ELSE 'draft' END AS status, CAST(floor(o_totalprice / 4900) AS INT) AS score,
  o_orderdate AS ts, o_orderkey AS n FROM orders
"""
FINDINGS_SQL = "findings AS (" + (FINDINGS.replace("sha2(concat('m', o_orderkey), 256)", "sha256(concat('m', o_orderkey))")
                                  .replace("array(", "list_value(").replace("CAST(floor(o_totalprice / 4900) AS INT)", "CAST(floor(o_totalprice / 4900) AS INTEGER)")) + ")"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FINDINGS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


# --- scores: line items are scoring events; repeated (chain, round) pairs are updates ---------------

SCORES_SQL = """score_events AS (SELECT l_orderkey AS chain_id, l_linenumber AS round, CAST(least(100, 60 + l_quantity) AS INTEGER) AS score,
  l_shipdate, l_partkey, l_suppkey FROM lineitem),
  scores AS (SELECT chain_id, round, arg_max(score, {a: l_shipdate, b: l_partkey, c: l_suppkey, d: score}) AS score FROM score_events GROUP BY 1, 2)"""


def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chain_id"), F.col("l_linenumber").alias("round"),
        F.least(F.lit(100), 60 + F.col("l_quantity")).cast("int").alias("score"), "l_shipdate", "l_partkey", "l_suppkey")


# --- reports: documents with a generated name and a state field -------------------------------------

_STATE = "CASE CAST({x} AS BIGINT) % 3 WHEN 0 THEN '是问题' WHEN 1 THEN '非问题' ELSE '暂时无法确认' END"
REPORTS = f"""SELECT doc_id, source, concat('com.example.', source) AS cls,
  CASE WHEN doc_id % 17 = 0 THEN concat('notes', doc_id, '.md') ELSE concat(CASE WHEN doc_id % 4 = 0 THEN concat({_STATE.replace('{x}', 'doc_id')}, '_') ELSE '' END,
    CASE lang WHEN 'en' THEN '严重' WHEN 'fr' THEN '致命' WHEN 'de' THEN '中危' ELSE '低危' END,
    '_com__example__', source, '_', lang, doc_id % 50, '_', left(sha2(text, 256), 8), '.md') END AS name,
  concat(text, '\n- **验证状态**: ', {_STATE.replace('{x}', 'n_chars')}, '\n- **等级**：', lang, '\n', CASE doc_id % 5 WHEN 0 THEN 'curl -d id=union+select http://x/ then HTTP/1.1 200 root:x:0:0 at Dao.java:12\n'
    WHEN 1 THEN 'curl http://x/ gives HTTP/1.1 200 at Dao.java:12\n' WHEN 2 THEN 'curl -X DELETE http://x/1 gives HTTP/1.1 204 at Dao.java:3\n' ELSE '' END) AS text FROM documents"""
REPORTS_SQL = "reports AS (" + REPORTS.replace("sha2(text, 256)", "sha256(text)").replace("'\n- ", "chr(10) || '- ").replace("'\n')", "chr(10))") + ")"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPORTS.replace("\n- ", "\\n- ").replace("'\n'", "'\\n'").replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents"))


# --- transcripts: events of a user are the lines of one log -----------------------------------------

TRANSCRIPT_SQL = """lines AS (SELECT user_id AS file, event_id AS line_no, ts, CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'purchase' THEN 'session_end' ELSE 'log' END AS _type,
  event_type AS phase, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END AS status, concat('run ', event_type, ' ', props) AS command, concat('step-', event_type) AS step FROM events),
  blocks AS (SELECT *, CAST(sum(CASE WHEN _type = 'session_start' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS session_no FROM lines),
  transcript AS (SELECT *, concat(file, '-', session_no) AS session_id FROM blocks)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "purchase", "session_end").otherwise("log")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), "ts", kind.alias("_type"), F.col("event_type").alias("phase"),
        F.when(F.col("event_type") == "error", "fail").otherwise("ok").alias("status"),
        F.concat(F.lit("run "), "event_type", F.lit(" "), "props").alias("command"), F.concat(F.lit("step-"), "event_type").alias("step"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrove.operators.logs import assign_sessions

    rows = assign_sessions(log_lines(spark, sf_dir), ["file"], ["line_no"], F.to_date("ts"))
    return rows.withColumn("session_id", F.concat(F.col("file").cast("string"), F.lit("-"), F.col("session_no").cast("string")))


# --- cache rows: one per order, of every kind -------------------------------------------------------

KV = """SELECT o_orderkey AS n, 'shop' AS group_id, concat('h', o_custkey % 7) AS commit_hash,
  CASE o_orderkey % 17 WHEN 0 THEN 'method' WHEN 1 THEN 'chain' WHEN 2 THEN 'prefetch' WHEN 3 THEN 'judgment' WHEN 4 THEN 'astmatch' WHEN 5 THEN 'draft' WHEN 6 THEN 'final'
    WHEN 7 THEN 'score' WHEN 8 THEN 'env' WHEN 9 THEN 'killed' WHEN 10 THEN 'force-rescan' WHEN 11 THEN 'file_status' WHEN 12 THEN 'file_chain_count'
    WHEN 13 THEN 'round_counters' WHEN 14 THEN 'stats' WHEN 15 THEN 'sink' ELSE 'global' END AS kind,
  concat('shop::Customer', o_custkey, '::order', o_orderkey) AS entity, CAST(o_orderkey % 30 AS STRING) AS sub, o_orderdate AS written_at,
  CAST(o_totalprice AS STRING) AS body FROM orders"""
KV_SQL = "kv_rows AS (" + KV.replace("AS STRING", "AS VARCHAR") + """), kv AS (SELECT *, concat(CASE WHEN kind = 'global' THEN 'audit:' ELSE concat('audit:shop:commit:', commit_hash, ':') END,
  CASE WHEN kind = 'file_status' THEN concat('file:', entity, '#', sub, ':status') WHEN kind = 'file_chain_count' THEN concat('file:', entity, '#', sub, ':chain_count')
  WHEN kind = 'round_counters' THEN concat('round:', entity, ':counters') WHEN kind IN ('method', 'judgment', 'astmatch') THEN concat(kind, ':', entity, '#', sub) WHEN kind IN ('draft', 'final') THEN concat('finding:', entity, ':', kind)
  WHEN kind = 'score' THEN concat('score:', entity, ':r', sub) WHEN kind = 'env' THEN 'env:reachability' WHEN kind = 'killed' THEN concat('subagent-killed:', entity)
  ELSE concat(kind, ':', entity) END) AS key FROM kv_rows)"""


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrove.sources.records import encode_kv

    return encode_kv(spark.sql(KV.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")))


# --- rounds: days of events ---------------------------------------------------------------------------

ROUNDS_SQL = """rounds AS (SELECT CAST(day(ts) AS INTEGER) AS round, count(*) FILTER (event_type <> 'error') AS total_reports, count(*) FILTER (event_type = 'purchase') AS n_poc,
  count(*) FILTER (event_type = 'view') AS ep_lines, count(*) FILTER (event_type = 'error') <= count(*) FILTER (event_type = 'click') AS p54_pass FROM events GROUP BY 1)"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda t: F.col("event_type") == t
    return table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("round")).agg(
        F.count_if(~is_("error")).alias("total_reports"), F.count_if(is_("purchase")).alias("n_poc"), F.count_if(is_("view")).alias("ep_lines"),
        (F.count_if(is_("error")) <= F.count_if(is_("click"))).alias("p54_pass"))
