"""Queries over source texts, syntax ranges and documents."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from callgrove.constants import HIGH_RISK_WORDS
from callgrove.functions import java
from callgrove.operators import flow, profile, search, structure
from callgrove.plans.scratch import scratch_root
from callgrove.plans.scratch import materialize
from callgrove.sources import code
from callgrove.workload import views as V
from callgrove.workload.registry import Registry

R = Registry()

# The extraction in SQL: cut before each mapping, drop class-level cuts, find each annotated parameter by its own pattern.
_MAP = "@(?:Post|Get|Put|Delete|Patch|Request)Mapping\\b"
_IN = '((?:[^()"]|"[^"]*"|\\([^()]*\\))*)'
_ARG = f"'^@(\\w+)Mapping\\s*(?:\\({_IN}\\))?'"
_CLS = f"""coalesce(regexp_matches(list_filter(list_transform(string_split(regexp_replace(S, {_ARG}, ''), chr(10)), lambda s: trim(s)),
  lambda s: s <> '' AND NOT regexp_matches(s, '^(?://|/\\*|\\*|@)'))[1], '\\b(?:class|interface|enum|record)\\b'), false)"""
_QP, _PV, _RH, _RB = (f"'@{by}\\b(?:\\s*\\({_IN}\\))?\\s*(?:final\\s+)?([\\w.]+(?:<(?:[^<>]|<[^<>]*>)*>)?(?:\\[\\])*)\\s+(\\w+)'"
                      for by in ("RequestParam", "PathVariable", "RequestHeader", "RequestBody"))
_NAMED = "coalesce(nullif(regexp_extract({a}, '(?:^|[,\\s])(?:value|name)\\s*=\\s*\"([^\"]*)\"', 1), ''), nullif(regexp_extract({a}, '^\\s*\"([^\"]*)\"', 1), ''), {v})"
_TY = """CASE WHEN {t} IN ('int','Integer','long','Long') THEN 'integer' WHEN {t} IN ('boolean','Boolean') THEN 'boolean'
  WHEN {t} IN ('double','float') THEN 'number' ELSE 'string' END"""


def _named(pattern):
    return _NAMED.replace("{a}", f"regexp_extract(m, {pattern}, 1)").replace("{v}", f"regexp_extract(m, {pattern}, 3)")


def _params(pattern, where):
    req = "'true'" if where == "path" else f"CASE WHEN regexp_matches(regexp_extract(m, {pattern}, 1), 'required\\s*=\\s*false') THEN 'false' ELSE 'true' END"
    ty = _TY.replace("{t}", f"regexp_extract(m, {pattern}, 2)")
    return f"list_transform(regexp_extract_all(block, {pattern}), lambda m: concat_ws(':', {_named(pattern)}, '{where}', {req}, {ty}))"


def _paths(args):
    listed = '(\\{\\s*(?:"[^"]*"\\s*,?\\s*)*\\}|"[^"]*")'
    parts = [f"nullif(regexp_extract({args}, '(?:^|[,\\s]){n}\\s*=\\s*{listed}', 1), '')" for n in ("path", "value")]
    text = f"coalesce({', '.join(parts)}, regexp_extract({args}, '^{listed}', 1))"
    return f"""CASE WHEN contains({text}, '"') THEN regexp_extract_all({text}, '"([^"]*)"', 1) ELSE [''] END"""


_DECL = f"'(?:public|private|protected)\\s+[\\w<>\\[\\], ?.]+?\\s+\\w+\\s*\\({_IN}\\)'"
_RISK = "CASE WHEN regexp_matches(lower(path), '" + "|".join(HIGH_RISK_WORDS) + "') THEN 'HIGH' WHEN contains(lower(path), 'xss') THEN 'MEDIUM' ELSE 'LOW' END"
ENDPOINTS_SQL = f"""{V.JAVA_SQL}, cuts AS (SELECT file, string_split(regexp_replace(text, '({_MAP})', chr(1) || '\\1', 'g'), chr(1)) AS segs FROM sources),
  seg AS (SELECT file, segs, unnest(segs) AS s, generate_subscripts(segs, 1) - 1 AS seq FROM cuts),
  pref AS (SELECT file, ({_paths("coalesce(trim(regexp_extract(list_filter(segs[2:], lambda g: " + _CLS.replace('S,', 'g,') + ")[1], " + _ARG + ", 2)), '')")})[1] AS prefix FROM cuts),
  raw AS (SELECT seg.file, seq, s, prefix, regexp_extract(s, {_ARG}, 1) AS kind, trim(regexp_extract(s, {_ARG}, 2)) AS args FROM seg JOIN pref ON pref.file = seg.file
    WHERE seq > 0 AND NOT {_CLS.replace('S,', 's,')}),
  pth AS (SELECT *, unnest({_paths('args')}) AS rp, regexp_extract(regexp_replace(s, {_ARG}, ''), {_DECL}, 1) AS block FROM raw),
  joined AS (SELECT *, CASE WHEN rp = '' THEN prefix WHEN prefix = '' THEN rp WHEN NOT starts_with(rp, '/') AND NOT ends_with(prefix, '/') THEN prefix || '/' || rp ELSE prefix || rp END AS jp FROM pth),
  ep AS (SELECT *, CASE WHEN jp = '' THEN '/' WHEN starts_with(jp, '/') THEN jp ELSE '/' || jp END AS path,
    CASE WHEN kind <> 'Request' THEN lower(kind) ELSE coalesce(nullif(lower(regexp_extract(args, 'method\\s*=\\s*(?:RequestMethod\\.)?(\\w+)', 1)), ''), 'get') END AS http_method FROM joined),
  endpoints AS (SELECT file, CAST(seq AS INTEGER) AS seq, http_method, path, '@' || kind || 'Mapping' AS annotation, args,
    array_to_string(list_concat({_params(_PV, 'path')},
      list_transform(list_filter(list_distinct(regexp_extract_all(path, '\\{{(\\w+)[^{{}}]*\\}}', 1)), lambda v: NOT list_contains(list_transform(regexp_extract_all(block, {_PV}), lambda m: {_named(_PV)}), v)), lambda v: v || ':path:true:string'),
      {_params(_QP, 'query')}, {_params(_RH, 'header')}), ',') AS params,
    nullif(regexp_extract(block, {_RB}, 2), '') AS body,
    regexp_matches(block, '@RequestParam|@RequestBody|@PathVariable|@RequestHeader|\\bMultipartFile\\b') AS has_input, {_RISK} AS risk FROM ep)"""


def endpoints(spark, d):
    return java.extract_endpoints(code.controllers(V.sources(spark, d)).select("file", "text"))


def flat(df):
    text = F.transform("params", lambda p: F.concat_ws(":", p["name"], p["in"], p["required"].cast("string"), p["type"]))
    return df.withColumn("params", F.array_join(text, ","))


@R.query("e1_extract_endpoints", f"WITH {ENDPOINTS_SQL} SELECT * FROM endpoints")
def _(spark, d):
    return flat(endpoints(spark, d))


@R.query("s4_controllers", f"WITH {V.JAVA_SQL} SELECT file, sha256(text) AS digest FROM sources WHERE contains(text, '@RestController') OR contains(text, '@Controller')")
def _(spark, d):
    return code.controllers(V.sources(spark, d)).select("file", F.sha2("text", 256).alias("digest"))


@R.query("a8_risk_breakdown", f"WITH {ENDPOINTS_SQL} SELECT risk, count(*) AS n FROM endpoints GROUP BY 1")
def _(spark, d):
    return profile.risk_breakdown(endpoints(spark, d))


@R.query("e3_normalize_path", """WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN concat('/api', l_suppkey) ELSE concat('api', l_suppkey, '/') END AS prefix,
  CASE l_linestatus WHEN 'O' THEN concat('/p', l_partkey) ELSE CASE WHEN l_linenumber = 1 THEN '' ELSE concat('p', l_partkey) END END AS path FROM lineitem),
  j AS (SELECT *, CASE WHEN path = '' THEN prefix WHEN prefix = '' THEN path WHEN NOT starts_with(path, '/') AND NOT ends_with(prefix, '/') THEN prefix || '/' || path ELSE prefix || path END AS jp FROM x)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN jp = '' THEN '/' WHEN starts_with(jp, '/') THEN jp ELSE '/' || jp END AS full_path FROM j""")
def _(spark, d):
    s = lambda c: F.col(c).cast("string")
    prefix = F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", F.concat(F.lit("/api"), s("l_suppkey"))).otherwise(F.concat(F.lit("api"), s("l_suppkey"), F.lit("/")))
    path = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("/p"), s("l_partkey"))).when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("p"), s("l_partkey")))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", java.normalize_path(prefix, path).alias("full_path"))


@R.query("e7_body_type", f"""WITH {ENDPOINTS_SQL} SELECT file, seq, path, http_method, CASE WHEN body IN ('String', 'string') THEN 'text/plain' WHEN body = 'MultipartFile' THEN 'multipart/form-data'
  WHEN body IS NOT NULL THEN 'application/json' WHEN http_method IN ('post', 'put', 'patch') AND NOT contains(params, ':query:') THEN 'application/x-www-form-urlencoded' END AS content_type,
  regexp_extract(file, '([^/]*)\\.java$', 1) || '_' || http_method AS operation_id FROM endpoints""")
def _(spark, d):
    return endpoints(spark, d).select("file", "seq", "path", "http_method",
                                      java.body_content_type(F.col("body"), F.col("http_method"), F.col("params")).alias("content_type"),
                                      java.operation_id(F.col("file"), F.col("http_method")).alias("operation_id"))


@R.query("s14_api_paths", f"""WITH {ENDPOINTS_SQL}, one AS (SELECT path, http_method, arg_max({{'file': file, 'annotation': annotation}}, {{'f': file, 's': seq, 'a': args}}) AS e FROM endpoints GROUP BY 1, 2)
  SELECT path, string_agg(http_method || '=' || regexp_extract(e.file, '([^/]*)\\.java$', 1) || '_' || http_method || '|' || e.annotation || ' ' || path, ';' ORDER BY http_method) AS operations FROM one GROUP BY path""")
def _(spark, d):
    ops = F.transform(F.map_entries("operations"), lambda e: F.concat(
        e["key"], F.lit("="), F.get_json_object(e["value"], "$.operationId"), F.lit("|"), F.get_json_object(e["value"], "$.summary")))
    return code.api_paths(endpoints(spark, d)).select("path", F.array_join(F.array_sort(ops), ";").alias("operations"))


@R.query("e34_detect_preset", f"""WITH {V.JAVA_SQL}, r AS (
  SELECT 'import' AS kind, unnest(regexp_extract_all(text, '(?m)^\\s*import\\s+(?:static\\s+)?([\\w.]+)', 1)) AS value FROM sources UNION ALL
  SELECT 'package', unnest(regexp_extract_all(text, '(?m)^\\s*package\\s+([\\w.]+)', 1)) FROM sources UNION ALL
  SELECT 'annotation', unnest(list_distinct(regexp_extract_all(text, '@([A-Z]\\w*)', 1))) FROM sources)
  SELECT kind, value, count(*) AS n, CASE WHEN kind = 'import' AND starts_with(value, 'org.springframework.boot') THEN 'spring-boot' END AS framework FROM r GROUP BY 1, 2""")
def _(spark, d):
    return code.detect_preset(V.sources(spark, d))


@R.query("e34_preset_draft", f"""WITH {V.JAVA_SQL}, a AS (SELECT unnest(list_distinct(regexp_extract_all(text, '@([A-Z]\\w*)', 1))) AS value FROM sources), n AS (SELECT value, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, value LIMIT 3)
  SELECT 'com.shop' AS group_id, 'site' AS artifact_id, 'spring-boot' AS "primary", 'site.page' AS base_package, (SELECT string_agg(value, ',' ORDER BY n DESC, value) FROM n) AS annotations, 'IDOR,SQLI' AS whitelist""")
def _(spark, d):
    poms = V.sources(spark, d).select(F.lit("<project><groupId>com.shop</groupId><artifactId>site</artifactId></project>").alias("text")).select(*code.pom_fields(F.col("text")))
    types = V.table(spark, d, "region").select(F.lit("spring-boot").alias("framework"), F.when(F.col("r_regionkey") % 2 == 0, "SQLI").otherwise("IDOR").alias("vuln_type"))
    draft = code.preset_draft(V.sources(spark, d), poms, types, 3)
    return draft.withColumns({c: F.array_join(c, ",") for c in ("annotations", "whitelist")})


@R.query("e36_j17_endpoint_sinks", f"""WITH {ENDPOINTS_SQL}, x AS (SELECT regexp_extract(file, '(?:^|/)(lessons/[^/]+)/', 1) AS module, count(*) AS n_endpoints FROM endpoints GROUP BY 1),
  s AS (SELECT regexp_extract(file, '(?:^|/)(lessons/[^/]+)/', 1) AS module, count(*) AS n_sinks FROM sources WHERE contains(text, 'track(') AND page_id % 2 = 0 GROUP BY 1)
  SELECT x.module, n_endpoints, coalesce(n_sinks, 0) AS n_sinks FROM x LEFT JOIN s ON s.module = x.module""")
def _(spark, d):
    sinks = V.sources(spark, d).filter(F.col("text").contains("track(") & (F.col("page_id") % 2 == 0))
    return profile.endpoint_sinks(endpoints(spark, d), sinks)


@R.query("e2_class_prefix", f"WITH {ENDPOINTS_SQL} SELECT * FROM pref")
def _(spark, d):
    return V.sources(spark, d).select("file", java.class_prefix(F.col("text")).alias("prefix"))


@R.query("e4_extract_params", f"""WITH {ENDPOINTS_SQL}, p AS (SELECT file, seq, path, unnest(string_split(params, ',')) AS p FROM endpoints WHERE params <> '')
  SELECT file, seq, path, split_part(p, ':', 1) AS name, split_part(p, ':', 2) AS "in", split_part(p, ':', 3) = 'true' AS required, split_part(p, ':', 4) AS type FROM p""")
def _(spark, d):
    return endpoints(spark, d).select("file", "seq", "path", F.inline("params")).select("file", "seq", "path", "name", "in", "required", "type")


@R.query("e5_has_input", f"WITH {ENDPOINTS_SQL} SELECT file, count(*) FILTER (has_input) AS n_input, count(*) AS n FROM endpoints GROUP BY 1")
def _(spark, d):
    return endpoints(spark, d).groupBy("file").agg(F.count_if("has_input").alias("n_input"), F.count(F.lit(1)).alias("n"))


@R.query("e6_java_type", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ['string','integer','integer','boolean','number','string','string'][l_linenumber] AS type,
  CASE l_linenumber WHEN 3 THEN 'int64' WHEN 6 THEN 'binary' END AS format FROM lineitem""")
def _(spark, d):
    name = F.get(F.array(*map(F.lit, ["String", "int", "Long", "boolean", "float", "byte[]", "Map"])), F.col("l_linenumber") - 1)
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", java.java_type(name).alias("type"), java.java_type(name, "format").alias("format"))


@R.query("e8_risk", f"WITH {V.GRAPH_SQL} SELECT id, {_RISK.replace('path', 'qualified_name')} AS risk FROM nodes")
def _(spark, d):
    return V.graph(spark, d).nodes.select("id", java.risk(F.col("qualified_name")).alias("risk"))


@R.query("e10_e12_method_blocks", f"""WITH {ENDPOINTS_SQL} SELECT file, CAST(seq AS INTEGER) AS seq, {_CLS.replace('S,', 's,')} AS class_level, regexp_extract(trim(regexp_extract(s, {_ARG}, 2)), '"([^"]*)"', 1) AS first_text,
  regexp_extract(regexp_replace(s, {_ARG}, ''), {_DECL}, 1) AS block, regexp_extract(substr(regexp_replace(s, {_ARG}, ''), 1, 600), {_DECL}, 1) AS block_600 FROM seg WHERE seq > 0""")
def _(spark, d):
    seg = F.col("seg")
    rows = V.sources(spark, d).select("file", F.posexplode(java.mapping_segments(F.col("text"))).alias("seq", "seg")).filter("seq > 0")
    return rows.select("file", "seq", java.is_class_level(seg).alias("class_level"), java.first_quoted(java.mapping_args(seg)).alias("first_text"),
                       java.method_block(seg).alias("block"), java.method_block(seg, window=600).alias("block_600"))


@R.query("e9_operation", f"""WITH {ENDPOINTS_SQL} SELECT file, seq, path, regexp_extract(file, '([^/]*)\\.java$', 1) || '_' || http_method AS operation_id, annotation || ' ' || path AS summary FROM endpoints""")
def _(spark, d):
    return endpoints(spark, d).select("file", "seq", "path", java.operation_id(F.col("file"), F.col("http_method")).alias("operation_id"),
                                      F.concat("annotation", F.lit(" "), "path").alias("summary"))


@R.query("e11_class_level", f"WITH {ENDPOINTS_SQL} SELECT file, count(*) FILTER ({_CLS.replace('S,', 's,')}) AS n_class_level, count(*) AS n_mappings FROM seg WHERE seq > 0 GROUP BY 1")
def _(spark, d):
    seg = V.sources(spark, d).select("file", F.posexplode(java.mapping_segments(F.col("text"))).alias("seq", "seg")).filter("seq > 0")
    return seg.groupBy("file").agg(F.count_if(java.is_class_level(F.col("seg"))).alias("n_class_level"), F.count(F.lit(1)).alias("n_mappings"))


@R.query("u5_path_values", f"WITH {ENDPOINTS_SQL} SELECT file, seq, count(*) AS n_paths FROM endpoints GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return endpoints(spark, d).groupBy("file", "seq").agg(F.count(F.lit(1)).alias("n_paths")).filter("n_paths > 1")


# --- flow ------------------------------------------------------------------------------------------

_CHAIN = """chain AS (SELECT l_orderkey AS chain_id, l_linenumber AS depth, l_partkey, l_suppkey, CASE l_linestatus WHEN 'O' THEN 'SQL' ELSE 'FILE' END AS sink_kind,
  CASE WHEN l_quantity > 45 THEN 'clean(x)' WHEN l_returnflag = 'R' THEN 'stmt.setString(1, x)' WHEN l_returnflag = 'A' THEN 'f.getCanonicalPath()' ELSE 'x + y' END AS body FROM lineitem)"""


_EFF = "((sink_kind = 'SQL' AND contains(body, '.setString(')) OR (sink_kind = 'FILE' AND contains(body, '.getCanonicalPath()')))"


@R.query("f17_l2_prune", f"""WITH {_CHAIN}, t AS (SELECT *, CASE WHEN (sink_kind = 'SQL' AND contains(body, '.setString(')) OR (sink_kind = 'FILE' AND contains(body, '.getCanonicalPath()')) THEN 'pruned'
  WHEN starts_with(body, 'clean(') THEN 'maybe_sanitized' ELSE 'active' END AS decision FROM chain), c AS (SELECT chain_id, min(depth) AS cut FROM t WHERE decision = 'pruned' GROUP BY 1)
  SELECT t.* FROM t LEFT JOIN c ON c.chain_id = t.chain_id WHERE c.cut IS NULL OR t.depth <= c.cut""")
def _(spark, d):
    return flow.l2_prune(_chain(spark, d))


def _chain(spark, d):
    body = (F.when(F.col("l_quantity") > 45, "clean(x)").when(F.col("l_returnflag") == "R", "stmt.setString(1, x)")
            .when(F.col("l_returnflag") == "A", "f.getCanonicalPath()").otherwise("x + y"))
    return V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("chain_id"), F.col("l_linenumber").alias("depth"), "l_partkey", "l_suppkey",
        F.when(F.col("l_linestatus") == "O", "SQL").otherwise("FILE").alias("sink_kind"), body.alias("body"))


@R.query("w13_sanitizer_state", f"""WITH {_CHAIN}, t AS (SELECT *, {_EFF} AS effective FROM chain) SELECT *, bool_or(effective) OVER (PARTITION BY chain_id ORDER BY depth, l_partkey, l_suppkey, body, sink_kind ROWS UNBOUNDED PRECEDING) AS clean FROM t""")
def _(spark, d):
    return flow.sanitizer_state(_chain(spark, d), ["depth", "l_partkey", "l_suppkey", "body", "sink_kind"])


@R.query("e26_sanitizers", f"WITH {_CHAIN} SELECT sink_kind, body, count(*) FILTER ({_EFF}) AS n_effective, count(*) AS n FROM chain GROUP BY 1, 2")
def _(spark, d):
    rows = _chain(spark, d).withColumn("e", flow.sanitizers(F.col("body"), F.col("sink_kind")))
    return rows.groupBy("sink_kind", "body").agg(F.count_if("e").alias("n_effective"), F.count(F.lit(1)).alias("n"))


_SINKS = {"NET": [r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"], "MAIL": [r"@\w"]}
_CLEAN = {"NET": ["###"], "MAIL": [r"\*\*\*"]}
_USES = r"""lines AS (SELECT source AS chain_id, doc_id AS depth, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
  w AS (SELECT *, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda t: t IN ('token', 'the', 'que', 'la')))) AS param FROM lines),
  strong AS (SELECT *, 'sink_call' AS use, 'NET' AS kind FROM w WHERE regexp_matches(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') UNION ALL SELECT *, 'sink_call', 'MAIL' FROM w WHERE regexp_matches(text, '@\w')
    UNION ALL SELECT *, 'sanitizer', 'NET' FROM w WHERE contains(text, '###') UNION ALL SELECT *, 'sanitizer', 'MAIL' FROM w WHERE contains(text, '***')),
  plain AS (SELECT * FROM w WHERE NOT (regexp_matches(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|@\w') OR contains(text, '###') OR contains(text, '***'))),
  u AS (SELECT * FROM strong UNION ALL SELECT *, 'concat', NULL FROM plain WHERE regexp_matches(text, '"\s*\+|\+\s*"') UNION ALL SELECT *, 'function_call', NULL FROM plain WHERE regexp_matches(text, '\w\s*\(')),
  uses AS (SELECT chain_id, param, depth, CAST(line AS INTEGER) AS line, use, kind FROM u)"""


def _uses(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("source").alias("chain_id"), F.col("doc_id").alias("depth"), F.col("text").alias("body"))
    params = docs.select("chain_id").distinct().select("chain_id", F.explode(F.array(*map(F.lit, ["token", "the", "que", "la"]))).alias("param"))
    return flow.trace_params(params, docs, _SINKS, _CLEAN)


@R.query("g10_trace_params", f"WITH {_USES} SELECT * FROM uses")
def _(spark, d):
    return _uses(spark, d)


@R.query("g11_evaluate_risk", f"""WITH {_USES}, o AS (SELECT *, sum(CASE WHEN use = 'sanitizer' THEN 1 ELSE 0 END) OVER (PARTITION BY chain_id, param, kind ORDER BY depth, line) AS cleaned FROM uses)
  SELECT chain_id, param, count(*) AS n_uses, CASE WHEN count(*) FILTER (use = 'sink_call' AND cleaned = 0) > 0 THEN 'VULNERABLE' WHEN count(*) FILTER (use = 'sink_call') > 0 THEN 'SANITIZED' ELSE 'NO_SINK' END AS risk
  FROM o GROUP BY 1, 2""")
def _(spark, d):
    return flow.evaluate_risk(_uses(spark, d))


@R.query("f18_node_prune", """SELECT c_custkey, qualified_name, name, CASE WHEN starts_with(qualified_name, 'java.') OR starts_with(qualified_name, 'org.hibernate.') THEN 'framework'
  WHEN regexp_matches(name, '^((get|set|is)[A-Z]\\w*|equals|hashCode)$') THEN 'accessor' WHEN argument IS NULL OR argument IN ('constant', 'null', 'unpropagated') THEN 'argument' END AS pruned_by FROM (
  SELECT c_custkey, concat(CASE c_nationkey WHEN 1 THEN 'java.' WHEN 2 THEN 'org.hibernate.' ELSE 'shop.' END, c_mktsegment) AS qualified_name,
  CASE c_nationkey % 5 WHEN 0 THEN concat('get', c_mktsegment) WHEN 1 THEN 'hashCode' ELSE lower(c_mktsegment) END AS name,
  CASE WHEN c_acctbal < 0 THEN 'null' WHEN c_acctbal < 1000 THEN 'constant' ELSE 'request' END AS argument FROM customer) q""")
def _(spark, d):
    n = F.col("c_nationkey")
    rows = V.table(spark, d, "customer").select(
        "c_custkey", F.concat(F.when(n == 1, "java.").when(n == 2, "org.hibernate.").otherwise("shop."), "c_mktsegment").alias("qualified_name"),
        F.when(n % 5 == 0, F.concat(F.lit("get"), "c_mktsegment")).when(n % 5 == 1, "hashCode").otherwise(F.lower("c_mktsegment")).alias("name"),
        F.when(F.col("c_acctbal") < 0, "null").when(F.col("c_acctbal") < 1000, "constant").otherwise("request").alias("argument"))
    return flow.node_prune(rows, ["java.", "org.hibernate."]).drop("argument")


@R.query("x3_rule_tables", """WITH r AS (SELECT CASE r_regionkey % 2 WHEN 0 THEN 'en' ELSE 'fr' END AS kind, CASE r_regionkey WHEN 0 THEN 'token' WHEN 1 THEN '[0-9]+\\.[0-9]+' WHEN 2 THEN '@' WHEN 3 THEN '###' ELSE 'ing$' END AS pattern, r_name AS label FROM region)
  SELECT doc_id, label FROM documents JOIN r ON r.kind = lang AND regexp_matches(text, r.pattern)""")
def _(spark, d):
    rules = V.table(spark, d, "region").selectExpr(
        "CASE r_regionkey % 2 WHEN 0 THEN 'en' ELSE 'fr' END AS kind", "r_name AS label",
        r"CASE r_regionkey WHEN 0 THEN 'token' WHEN 1 THEN '[0-9]+\\.[0-9]+' WHEN 2 THEN '@' WHEN 3 THEN '###' ELSE 'ing\\z' END AS pattern")
    return flow.match_rules(V.table(spark, d, "documents").select("doc_id", F.col("lang").alias("kind"), "text"), rules).select("doc_id", "label")


# --- structure -------------------------------------------------------------------------------------

_AST = """ast AS (SELECT o_orderkey AS id, o_custkey AS file, o_custkey AS parent, o_orderpriority AS kind, o_orderstatus AS tag,
  CAST(date_diff('day', DATE '1995-01-01', o_orderdate) AS INTEGER) AS start, CAST(date_diff('day', DATE '1995-01-01', o_orderdate) + floor(o_totalprice / 1000) AS INTEGER) AS "end", o_orderpriority AS text FROM orders),
  a AS (SELECT * FROM ast WHERE tag <> 'P'), b AS (SELECT * FROM ast WHERE tag <> 'F')"""


def _ast(spark, d):
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    ast = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("kind"),
        F.col("o_orderstatus").alias("tag"), day.alias("start"), (day + F.floor(F.col("o_totalprice") / 1000)).cast("int").alias("end"), F.col("o_orderpriority").alias("text"))
    return ast, ast.filter("tag <> 'P'"), ast.filter("tag <> 'F'")


def _relation(name, cond, fn):
    sql = f"""WITH {_AST} SELECT a.id, a.file, a.start, a."end" FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.file = a.file AND {cond})"""

    @R.query(name, sql)
    def _(spark, d):
        _, a, b = _ast(spark, d)
        return fn(a, b).select("id", "file", "start", "end")


_relation("j23_rel_inside", 'b.start <= a.start AND b."end" >= a."end" AND (b.start < a.start OR b."end" > a."end")', structure.rel_inside)
_relation("j23_rel_has", 'b.start >= a.start AND b."end" <= a."end" AND (b.start > a.start OR b."end" < a."end")', structure.rel_has)
_relation("j23_rel_follows", 'b."end" <= a.start', structure.rel_follows)
_relation("j23_rel_precedes", 'b.start >= a."end"', structure.rel_precedes)


# A syntax tree for each customer: blocks of orders, orders, lines and what the lines hold.
_NESTED = """lines AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2),
  nested AS (SELECT DISTINCT concat('g', o_custkey, '-', o_orderkey // 4000) AS id, o_custkey AS file, o_orderkey // 4000 * 400000 AS start, (o_orderkey // 4000 + 1) * 400000 AS "end", concat('G', o_orderkey // 4000 % 3) AS kind FROM orders
  UNION ALL SELECT concat('o', o_orderkey), o_custkey, o_orderkey * 100, o_orderkey * 100 + 95, o_orderstatus FROM orders
  UNION ALL SELECT concat('l', l_orderkey, '-', l_linenumber), o_custkey, l_orderkey * 100 + l_linenumber * 10, l_orderkey * 100 + l_linenumber * 10 + 9, concat('L', flag) FROM lines JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT concat('p', l_orderkey, '-', l_linenumber), o_custkey, l_orderkey * 100 + l_linenumber * 10 + 2, l_orderkey * 100 + l_linenumber * 10 + 5, concat('P', status) FROM lines JOIN orders ON o_orderkey = l_orderkey)"""


def _nested(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file"), "o_orderstatus", F.expr("o_orderkey DIV 4000").alias("g"))
    lines = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    lines = lines.join(o, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("at", F.expr("l_orderkey * 100 + l_linenumber * 10"))
    shape = lambda df, name, start, end, kind: df.selectExpr(f"concat({name}) AS id", "file", f"{start} AS start", f"{end} AS end", f"{kind} AS kind")
    line = "l_orderkey, '-', l_linenumber"
    return (shape(o.select("file", "g").distinct(), "'g', file, '-', g", "g * 400000", "(g + 1) * 400000", "concat('G', g % 3)")
            .unionAll(shape(o, "'o', o_orderkey", "o_orderkey * 100", "o_orderkey * 100 + 95", "o_orderstatus"))
            .unionAll(shape(lines, f"'l', {line}", "at", "at + 9", "concat('L', flag)")).unionAll(shape(lines, f"'p', {line}", "at + 2", "at + 5", "concat('P', status)")))


def _stopped(name, between, relation, fn, a, b, stop):
    """A relation that ends at nodes of the kinds ``stop``, against a search of all pairs."""
    sql = f"""WITH {_NESTED}, a AS (SELECT * FROM nested WHERE kind IN ({a})), b AS (SELECT * FROM nested WHERE kind IN ({b})), s AS (SELECT * FROM nested WHERE kind IN ({stop}))
  SELECT a.id, a.file, a.kind FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.file = a.file AND {relation}
    AND NOT EXISTS (SELECT 1 FROM s WHERE s.file = a.file AND {between}))"""

    @R.query(name, sql)
    def _(spark, d):
        tree = materialize(_nested(spark, d), "tree")
        return fn(*(tree.filter(f"kind IN ({kinds})") for kinds in (a, b, stop))).select("id", "file", "kind")


_WITHIN = lambda x, y: f'{y}.start <= {x}.start AND {y}."end" >= {x}."end" AND ({y}.start < {x}.start OR {y}."end" > {x}."end")'
_stopped("j23_stop_inside", f"{_WITHIN('a', 's')} AND {_WITHIN('s', 'b')}", _WITHIN("a", "b"), structure.rel_inside, "'PO', 'PF', 'LN'", "'G0', 'O'", "'LA', 'F'")
_stopped("j23_stop_has", f"{_WITHIN('s', 'a')} AND {_WITHIN('b', 's')}", _WITHIN("b", "a"), structure.rel_has, "'G0', 'G1', 'G2', 'O', 'P'", "'PO', 'LR'", "'P', 'LA', 'LN'")
_stopped("j23_stop_follows", 's.start >= b."end" AND s."end" <= a.start', 'b."end" <= a.start', structure.rel_follows, "'LA', 'O'", "'LR', 'F'", "'P', 'PO'")
_stopped("j23_stop_precedes", 's.start >= a."end" AND s."end" <= b.start', 'b.start >= a."end"', structure.rel_precedes, "'LA', 'O'", "'LR', 'F'", "'P', 'PO'")


_TREE = """tree AS (SELECT concat('c', c_custkey) AS id, concat('n', c_nationkey) AS parent, c_mktsegment AS kind, CASE WHEN c_acctbal < 0 THEN 'body' ELSE 'name' END AS field FROM customer
  UNION ALL SELECT concat('o', o_orderkey), concat('c', o_custkey), o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'body' ELSE 'name' END FROM orders)"""


def _tree(spark, d):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    field = lambda hit: F.when(hit, "body").otherwise("name").alias("field")
    c = V.table(spark, d, "customer").select(tag("c", "c_custkey").alias("id"), tag("n", "c_nationkey").alias("parent"), F.col("c_mktsegment").alias("kind"), field(F.col("c_acctbal") < 0))
    return c.unionByName(V.table(spark, d, "orders").select(tag("o", "o_orderkey").alias("id"), tag("c", "o_custkey").alias("parent"), F.col("o_orderstatus").alias("kind"), field(F.col("o_totalprice") > 200000)))


@R.query("j23_inside_neighbor", f"""WITH {_TREE} SELECT a.id, a.kind FROM tree a WHERE a.kind = 'P' AND a.parent IN (SELECT id FROM tree WHERE kind = 'BUILDING')
  UNION ALL SELECT a.id, 'in body' FROM tree a WHERE a.field = 'body' AND a.parent IN (SELECT id FROM tree WHERE kind = 'BUILDING')""")
def _(spark, d):
    t = _tree(spark, d)
    up = t.filter("kind = 'BUILDING'")
    return structure.rel_inside_neighbor(t.filter("kind = 'P'"), up).select("id", "kind").unionAll(
        structure.rel_inside_neighbor(t, up, "body").select("id", F.lit("in body")))


@R.query("j23_has_neighbor", f"""WITH {_TREE} SELECT a.id, a.kind FROM tree a WHERE a.id IN (SELECT parent FROM tree WHERE kind = 'P' AND field = 'body')""")
def _(spark, d):
    t = _tree(spark, d)
    return structure.rel_has_neighbor(t, t.filter("kind = 'P'"), "body").select("id", "kind")


@R.query("j23_rel_next_to", f"""WITH {_AST}, l AS (SELECT *, lag(kind) OVER (PARTITION BY parent ORDER BY start, id) AS near FROM ast)
  SELECT id, parent, start FROM l WHERE kind = '1-URGENT' AND near = '5-LOW'""")
def _(spark, d):
    return structure.rel_next_to(_ast(spark, d)[0], "1-URGENT", "5-LOW").select("id", "parent", "start")


@R.query("f23_w12_rule_nth", f"""WITH {_AST}, r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY start DESC, id DESC) AS nth FROM ast)
  SELECT id, parent, nth FROM r WHERE (nth - 1) % 2 = 0""")
def _(spark, d):
    return structure.rule_nth(_ast(spark, d)[0], 2, 1, reverse=True).select("id", "parent", "nth")


@R.query("f23_rule_atoms", f"""WITH {_AST} SELECT id, kind FROM ast WHERE kind = '2-HIGH' AND regexp_matches(text, 'H.*H') AND start >= 100 AND "end" <= 2000""")
def _(spark, d):
    ast = _ast(spark, d)[0]
    return structure.rule_range(structure.rule_regex(structure.rule_kind(ast, "2-HIGH"), "H.*H"), 100, 2000).select("id", "kind")


@R.query("j24_rule_composition", f"""WITH {_AST} SELECT id, kind, tag FROM ast WHERE (kind = '1-URGENT' OR tag = 'P') AND start >= 365 AND NOT regexp_matches(text, 'LOW')""")
def _(spark, d):
    ast = _ast(spark, d)[0].select("id", "kind", "tag", "start", "text")
    some = structure.rule_any(structure.rule_kind(ast, "1-URGENT"), ast.filter("tag = 'P'"))
    both = structure.rule_all(some, ast.filter("start >= 365"))
    return structure.rule_not(both, structure.rule_regex(ast, "LOW")).select("id", "kind", "tag")


@R.query("j10_enclosing_method", f"""WITH {V.GRAPH_SQL}, p AS (SELECT event_id, concat('shop/Customer', user_id, '.java') AS file, CAST(floor(value * 20) AS INTEGER) AS line FROM events),
  x AS (SELECT p.*, n.id AS method_id, row_number() OVER (PARTITION BY event_id ORDER BY n.end_line - n.start_line, n.start_line DESC, n.id) AS r
  FROM p LEFT JOIN nodes n ON n.kind = 'method' AND n.file_path = p.file AND p.line BETWEEN n.start_line AND n.end_line) SELECT event_id, file, line, method_id FROM x WHERE r = 1""")
def _(spark, d):
    points = V.table(spark, d, "events").select("event_id", F.concat(F.lit("shop/Customer"), F.col("user_id").cast("string"), F.lit(".java")).alias("file"),
                                                F.floor(F.col("value") * 20).cast("int").alias("line"))
    return structure.enclosing_method(points, V.graph(spark, d).methods)


# --- search ----------------------------------------------------------------------------------------

def _bm25(table, text, key, terms, keep):
    n = range(len(terms))
    tf = ", ".join(f"len(list_filter(t, lambda w: w = '{x}')) AS tf{i}" for i, x in enumerate(terms))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in n)
    return f"""tk AS (SELECT *, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS t FROM {table}),
  tf AS (SELECT *, len(t) AS dl, {tf} FROM tk), st AS (SELECT count(*) AS n, avg(dl) AS av, {', '.join(f'count(*) FILTER (tf{i} > 0) AS d{i}' for i in n)} FROM tf),
  sc AS (SELECT tf.*, round({score}, 6) AS score FROM tf, st WHERE {keep.join(f'tf{i} > 0' for i in n)})"""


@R.query("k1_search", f"WITH {_bm25('documents', 'text', 'doc_id', ['the', 'token'], ' AND ')} SELECT doc_id, lang, source, score FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def _(spark, d):
    return search.search(V.table(spark, d, "documents"), "the token", ["text"], "doc_id").select("doc_id", "lang", "source", "score")


@R.query("k1_search_symbols", f"WITH {_bm25('part', "concat_ws(' ', p_name, p_brand, p_type)", 'p_partkey', ['red', 'widget'], ' AND ')} SELECT p_partkey, p_name, score FROM sc ORDER BY score DESC, p_partkey LIMIT 10")
def _(spark, d):
    return search.search(V.table(spark, d, "part"), "red widget", ["p_name", "p_brand", "p_type"], "p_partkey").select("p_partkey", "p_name", "score")


@R.query("k1_search_kinds", f"WITH {_bm25('documents', 'text', 'doc_id', ['the', 'token'], ' AND ')} SELECT doc_id, lang, source, score FROM sc WHERE lang IN ('de', 'fr') ORDER BY score DESC, doc_id LIMIT 10")
def _(spark, d):
    docs = V.table(spark, d, "documents").withColumn("kind", F.col("lang"))
    return search.search(docs, "the token", ["text"], "doc_id", kinds=["de", "fr"]).select("doc_id", "lang", "source", "score")


@R.query("k1_search_index", f"WITH {_bm25('documents', 'text', 'doc_id', ['the', 'token'], ' AND ')} SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def _(spark, d):
    """Builds the index, then answers from the postings of the two terms."""
    index = search.build_index(V.table(spark, d, "documents"), ["text"], "doc_id", f"{scratch_root(spark)}/index-{uuid4().hex}")
    return search.search_index(index, "the token")


_NOW = "(SELECT doc_id, source, CASE WHEN doc_id % 10 = 2 THEN concat(text, ' the token') ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1) AS cur"


def _updated_index(spark, d):
    """An index to which a tenth of the documents is added, in which a tenth is changed, and from which a tenth goes."""
    docs = V.table(spark, d, "documents").select("doc_id", "source", "text")
    part = F.col("doc_id") % 10
    index = search.build_index(docs.filter(part != 0), ["text"], "doc_id", f"{scratch_root(spark)}/index-{uuid4().hex}", 16, "source")
    search.update_index(index, docs.filter(part == 0), ["text"], docs.filter(part == 1), "source")
    return search.update_index(index, docs.filter(part == 2).withColumn("text", F.concat("text", F.lit(" the token"))), ["text"], None, "source")


@R.query("k1_index_segments", f"WITH {_bm25(_NOW, 'text', 'doc_id', ['the', 'token'], ' AND ')} SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def _(spark, d):
    return search.search_index(_updated_index(spark, d), "the token")


@R.query("k6_explore_index", f"""WITH {_bm25(_NOW, 'text', 'doc_id', ['that', 'token'], ' OR ')}
  , f AS (SELECT source, max(score) AS best, count(*) AS n_symbols FROM sc GROUP BY 1 ORDER BY best DESC, source LIMIT 12)
  SELECT f.source AS file, best, n_symbols, doc_id AS key, score FROM f JOIN sc ON sc.source = f.source""")
def _(spark, d):
    return search.explore_index(_updated_index(spark, d), "that token")


@R.query("k6_explore", f"""WITH {_bm25('documents', 'text', 'doc_id', ['that', 'token'], ' OR ')}
  , f AS (SELECT source, max(score) AS best, count(*) AS n_symbols FROM sc GROUP BY 1 ORDER BY best DESC, source LIMIT 12)
  SELECT f.source AS file, best, n_symbols, doc_id AS key, score FROM f JOIN sc ON sc.source = f.source""")
def _(spark, d):
    return search.explore(V.table(spark, d, "documents"), "that token", ["text"], "doc_id", "source")
