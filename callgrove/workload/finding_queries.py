"""Queries over findings, scores, prunings, endpoints, reports and the cache."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from callgrove.constants import ATTACK_PAYLOADS, IMPACT_PATTERNS
from callgrove.functions import keys, text, verdicts
from callgrove.operators import findings as fd
from callgrove.operators import prune, reconcile
from callgrove.plans.scratch import scratch_root
from callgrove.sources import records
from callgrove.plans.scratch import materialize
from callgrove.workload import views as V
from callgrove.workload.registry import Registry

R = Registry()
S = lambda c: F.col(c).cast("string")
Q = lambda s: "'" + s.replace("'", "''") + "'"

# --- pruning and dispatch ------------------------------------------------------------------------

_EP = r"""eps AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host, '/' || regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS path,
  list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: CASE WHEN regexp_matches(p, '=\d+$') THEN 'int' ELSE 'String' END) AS types FROM pages),
  ep AS (SELECT *, starts_with(host, 'm.') AS inner_api, ends_with(host, '.org') AS filtered, ends_with(host, '.net') AS open FROM eps)"""


def _endpoints(spark, d):
    query = F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda p: p != "")
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    return V.table(spark, d, "pages").select(
        "page_id", host.alias("host"), F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1)).alias("path"),
        F.transform(query, lambda p: F.struct(F.split(p, "=")[0].alias("name"), F.when(p.rlike(r"=\d+$"), "int").otherwise("String").alias("type"))).alias("params"),
        F.when(host.startswith("m."), F.array(F.lit("@Inner"))).when(host.startswith("blog."), F.array(F.lit("@Blog"))).otherwise(F.array().cast("array<string>")).alias("annotations"),
        host.endswith(".net").alias("permit_all"), host.endswith(".org").alias("filter_covered"), F.lit(True).alias("internal_network"))


_RULE = """CASE WHEN len(types) = 0 THEN 'P-L1-001' WHEN len(list_filter(types, lambda t: t <> 'int')) = 0 THEN 'P-L1-002' WHEN NOT open AND filtered THEN 'P-L1-003'
  WHEN inner_api THEN 'P-L1-004' WHEN regexp_matches(path, '/health|/actuator/') THEN 'P-L1-005' WHEN regexp_matches(path, '/swagger|/v3/api-docs') THEN 'P-L1-006'
  WHEN starts_with(host, 'blog.') THEN 'P-L1-007' END"""
_L1 = f"""{_EP}, l1 AS (SELECT *, {_RULE} AS rule_id FROM ep), pruned AS (SELECT page_id, path, rule_id, CASE rule_id WHEN 'P-L1-001' THEN 'no_params' WHEN 'P-L1-002' THEN 'numeric_only'
  WHEN 'P-L1-003' THEN 'filter_coverage' WHEN 'P-L1-004' THEN 'internal_network' WHEN 'P-L1-005' THEN 'health_check' WHEN 'P-L1-006' THEN 'api_doc' WHEN 'P-L1-007' THEN 'needs_human' END AS reason,
  CASE rule_id WHEN 'P-L1-001' THEN 'A,B,C,D,INFO' WHEN 'P-L1-002' THEN 'A,B,INFO' WHEN 'P-L1-003' THEN 'B' WHEN 'P-L1-004' THEN 'A' WHEN 'P-L1-005' THEN 'A,B,C,D,INFO' WHEN 'P-L1-006' THEN 'A,B,C,D,INFO' ELSE '' END AS modes_skipped FROM l1)"""
_INTERN = ["@Inner"]


@R.query("f14_l1_prune", f"WITH {_L1} SELECT * FROM pruned")
def _(spark, d):
    return prune.l1_prune(_endpoints(spark, d)).select("page_id", "path", "rule_id", "reason", F.array_join("modes_skipped", ",").alias("modes_skipped"))


def _prioritised(spark, d):
    out = prune.l1_prune(_endpoints(spark, d))
    return out.withColumn("endpoint_fqn", S("page_id")).withColumn("priority", F.concat(F.lit("P"), (F.length("path") % 3).cast("string")))


_PRI = f"{_L1}, pri AS (SELECT *, concat('P', length(path) % 3) AS priority FROM pruned)"


@R.query("f15_dispatch", f"""WITH {_PRI}, m AS (SELECT *, unnest(CASE priority WHEN 'P0' THEN ['A','B','C','D','INFO'] WHEN 'P1' THEN ['A','B'] ELSE ['A'] END) AS mode FROM pri)
  SELECT CAST(page_id AS VARCHAR) AS endpoint_fqn, priority, mode FROM m WHERE NOT list_contains(string_split(modes_skipped, ','), mode)""")
def _(spark, d):
    return prune.dispatch(_prioritised(spark, d))


@R.query("k3_bucket", f"""WITH {_PRI} SELECT CASE WHEN modes_skipped = 'A,B,C,D,INFO' THEN 'pruned' ELSE priority END AS bucket, count(*) AS n FROM pri GROUP BY 1""")
def _(spark, d):
    return prune.bucket(_prioritised(spark, d)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@R.query("f16_force_rescan", """WITH r AS (SELECT o_orderkey AS n, concat('shop::Customer', o_custkey, '::order', o_orderkey) AS endpoint_fqn,
  CASE o_orderstatus WHEN 'F' THEN ['C','D'] WHEN 'O' THEN ['A','C'] ELSE ['D'] END AS modes FROM orders)
  SELECT n, endpoint_fqn, CASE WHEN list_contains(modes, 'A') THEN 'error' ELSE 'queued' END AS status,
  CASE WHEN NOT list_contains(modes, 'A') THEN concat('audit:shop:commit:HEAD:force-rescan:', left(sha256(endpoint_fqn), 16)) END AS key,
  CASE WHEN list_contains(modes, 'A') THEN 'modes not allowed: A' END AS error FROM r""")
def _(spark, d):
    modes = lambda *m: F.array(*map(F.lit, m))
    req = V.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("n"), F.concat(F.lit("shop::Customer"), S("o_custkey"), F.lit("::order"), S("o_orderkey")).alias("endpoint_fqn"),
        F.when(F.col("o_orderstatus") == "F", modes("C", "D")).when(F.col("o_orderstatus") == "O", modes("A", "C")).otherwise(modes("D")).alias("modes"))
    return prune.force_rescan(req, "shop", "HEAD").drop("modes")


@R.query("f19_l3_route", f"""WITH {V.FINDINGS_SQL}, chains AS (SELECT DISTINCT l_orderkey, left(sha256(concat('m', l_orderkey)), 16) AS chain_id FROM lineitem WHERE l_returnflag <> 'R'),
  f AS (SELECT chain_id, bool_or(status = 'final') AS f, bool_or(status = 'draft') AS dr FROM findings WHERE mode <> 'X' GROUP BY 1)
  SELECT l_orderkey, c.chain_id, CASE WHEN f.f THEN 'skip' WHEN f.dr THEN 'continue' ELSE 'new' END AS route FROM chains c LEFT JOIN f ON f.chain_id = c.chain_id""")
def _(spark, d):
    chains = V.table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey").distinct().withColumn(
        "chain_id", keys.short_hash(F.concat(F.lit("m"), S("l_orderkey"))))
    return prune.l3_route(chains, V.findings(spark, d).filter("mode <> 'X'"))


@R.query("j15_pending_chains", f"""WITH {V.FINDINGS_SQL} SELECT chain_id, n FROM findings WHERE chain_id NOT IN (SELECT chain_id FROM findings WHERE status = 'final')""")
def _(spark, d):
    f = V.findings(spark, d)
    return prune.pending_chains(f.select("chain_id", "n"), f)


_LOG = """log AS (SELECT 'L' || (1 + l_linenumber % 3) AS level, concat('P-', l_returnflag, '-', l_linestatus) AS rule_id, l_orderkey AS target_id, l_shipdate AS ts, l_partkey, l_linenumber, l_suppkey FROM lineitem)"""


def _log(spark, d):
    return V.table(spark, d, "lineitem").select(
        F.concat(F.lit("L"), (1 + F.col("l_linenumber") % 3).cast("string")).alias("level"), F.concat(F.lit("P-"), "l_returnflag", F.lit("-"), "l_linestatus").alias("rule_id"),
        F.col("l_orderkey").alias("target_id"), F.col("l_shipdate").alias("ts"), "l_partkey", "l_linenumber", "l_suppkey")


@R.query("a3_list_pruned", f"""WITH {_LOG} SELECT CASE WHEN grouping(level) = 1 THEN 'total' WHEN grouping(rule_id) = 1 THEN 'level' ELSE 'rule' END AS scope, level, rule_id, count(*) AS n
  FROM log GROUP BY ROLLUP (level, rule_id)""")
def _(spark, d):
    return prune.list_pruned(_log(spark, d))


@R.query("a4_rule_stats", f"""WITH {_LOG}, one AS (SELECT DISTINCT rule_id, target_id, ts FROM log), t AS (SELECT doc_id, toxic = 1 OR quality = 0 AS vulnerable FROM labels),
  r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts DESC, target_id) AS r FROM one),
  k AS (SELECT rule_id, count(*) AS sampled, count(*) FILTER (coalesce(vulnerable, false)) AS false_kills FROM r LEFT JOIN t ON t.doc_id = r.target_id WHERE r <= 30 GROUP BY 1),
  h AS (SELECT rule_id, count(*) AS hits FROM one GROUP BY 1)
  SELECT h.rule_id, hits, round(hits / (SELECT count(*) FROM one), 6) AS hit_share, sampled, false_kills, round(false_kills / sampled, 6) AS false_kill_rate,
  CASE WHEN false_kills / sampled > 0.05 THEN 'disabled' WHEN hits / (SELECT count(*) FROM one) < 0.7 THEN 'low_value' ELSE 'active' END AS action FROM h JOIN k ON k.rule_id = h.rule_id""")
def _(spark, d):
    truth = V.table(spark, d, "labels").select(F.col("doc_id").alias("target_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("vulnerable"))
    return prune.rule_stats(_log(spark, d).select("rule_id", "target_id", "ts").distinct(), truth)


@R.query("j19_filter_coverage", r"""WITH e AS (SELECT page_id AS endpoint_id, '/' || regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS path FROM pages),
  c AS (SELECT endpoint_id, count(*) AS n FROM e JOIN (SELECT unnest(['^/en(/.*)?$', '^/[^/]*/5[^/]*$', '^/de/[0-9]*$', '^/fr/.*\.html$', '^/es/[^/]*$|^/.*/es/[^/]*$']) AS p) q ON regexp_matches(e.path, q.p) GROUP BY 1)
  SELECT e.endpoint_id, e.path, coalesce(c.n, 0) AS n_filters, coalesce(c.n, 0) > 0 AS covered FROM e LEFT JOIN c ON c.endpoint_id = e.endpoint_id""")
def _(spark, d):
    pages = V.table(spark, d, "pages")
    eps = pages.select(F.col("page_id").alias("endpoint_id"), F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]*/([^?#]*)", 1)).alias("path"))
    digits = [f"/de/{'?' * n}" for n in (1, 2, 3, 4, 5, 6)]
    filters = pages.select(F.explode(F.array(*map(F.lit, ["/en/**", "/*/5*", "/fr/**.html", "/**/es/*", *digits]))).alias("pattern")).distinct()
    return prune.filter_coverage(eps, filters)


# --- findings --------------------------------------------------------------------------------------

@R.query("e22_validate_findings", f"""WITH {V.FINDINGS_SQL} SELECT n, concat_ws(',', CASE WHEN mode = 'X' THEN 'enum:mode' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'range:confidence' END,
  CASE WHEN score > 100 THEN 'range:score' END, CASE WHEN evidence[2] = 'see log' THEN 'evidence:no_line' END, CASE WHEN mode = 'B' AND vuln_type <> 'MISSING_AUTH' THEN 'mode:vuln_type' END) AS errors FROM findings""")
def _(spark, d):
    f = V.findings(spark, d)
    return fd.validate_findings(f.drop("ts", "n")).withColumn("n", F.regexp_extract("summary", r"(\d+)$", 1).cast("long")).select("n", F.array_join("errors", ",").alias("errors"))


@R.query("e22_closed_keys", f"""WITH {V.FINDINGS_SQL} SELECT n, concat_ws(',', CASE WHEN status = 'final' THEN 'enum:node_type' END, CASE WHEN mode = 'X' THEN 'unknown_key:bogus' END) AS errors FROM findings""")
def _(spark, d):
    """Records are written as JSON lines and read again: keys that the schema lacks must be told."""
    home = f"{scratch_root(spark)}/closed-{uuid4().hex}"
    node = F.array(F.struct(F.lit("a::b").alias("fqn"), F.lit(0).alias("depth"), F.when(F.col("status") == "final", "gateway").otherwise("dao").alias("node_type")))
    f = V.findings(spark, d).withColumn("chain", node).withColumn("bogus", F.when(F.col("mode") == "X", 1))
    f.drop("ts", "n").write.json(home)
    good, _ = records.read_findings(spark, home)
    told = F.filter("errors", lambda e: e.isin("enum:node_type") | e.startswith("unknown_key:"))
    return fd.validate_findings(good).select(F.regexp_extract("summary", r"(\d+)$", 1).cast("long").alias("n"), F.array_join(told, ",").alias("errors"))


@R.query("e23_mode_checks", """SELECT n, concat_ws(',', CASE WHEN a = 'unclear' THEN 'enum:D2_auth_state' END, CASE WHEN b = 'unclear' THEN 'enum:D3_business_rule' END) AS errors FROM (
  SELECT o_orderkey AS n, CASE o_orderstatus WHEN 'F' THEN 'missing' WHEN 'O' THEN 'present' ELSE 'unclear' END AS a, CASE WHEN o_totalprice > 250000 THEN 'enforced' ELSE 'unclear' END AS b FROM orders) q""")
def _(spark, d):
    j = F.struct(F.expr("CASE o_orderstatus WHEN 'F' THEN 'missing' WHEN 'O' THEN 'present' ELSE 'unclear' END").alias("D2_auth_state"),
                 F.when(F.col("o_totalprice") > 250000, "enforced").otherwise("unclear").alias("D3_business_rule"))
    rows = V.table(spark, d, "orders").select(S("o_orderkey").alias("fqn"), j.alias("judgment"))
    enums = F.filter("errors", lambda e: e.startswith("enum:"))
    return fd.validate_findings(rows).select(F.col("fqn").cast("long").alias("n"), F.array_join(enums, ",").alias("errors"))


@R.query("u1_union_modes", f"WITH {V.FINDINGS_SQL} SELECT mode, count(*) AS n, count(DISTINCT chain_id) AS n_chains FROM findings WHERE mode <> 'X' GROUP BY 1")
def _(spark, d):
    f = V.findings(spark, d)
    parts = [f.filter(F.col("mode") == m).drop(*drop) for m, drop in (("A", []), ("B", ["score"]), ("C", ["evidence"]), ("D", []), ("INFO", ["ts"]))]
    return fd.union_modes(*parts).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chain_id").alias("n_chains"))


@R.query("e13_short_hash", "SELECT doc_id, CASE WHEN lang = 'en' THEN left(sha256(text), 16) ELSE lang END AS h FROM documents")
def _(spark, d):
    given = F.when(F.col("lang") != "en", F.col("lang"))
    return V.table(spark, d, "documents").select("doc_id", keys.short_hash(F.col("text"), given).alias("h"))


@R.query("e25_parse_evidence", f"""WITH {V.FINDINGS_SQL}, e AS (SELECT n, unnest(evidence) AS e FROM findings) SELECT n, e, nullif(regexp_extract(e, '([\\w$./-]+\\.\\w+):(\\d+)(?:\\s*\\((.*)\\))?', 1), '') AS file,
  CAST(nullif(regexp_extract(e, '([\\w$./-]+\\.\\w+):(\\d+)(?:\\s*\\((.*)\\))?', 2), '') AS INTEGER) AS line, nullif(regexp_extract(e, '([\\w$./-]+\\.\\w+):(\\d+)(?:\\s*\\((.*)\\))?', 3), '') AS note FROM e""")
def _(spark, d):
    return V.findings(spark, d).select("n", F.explode("evidence").alias("e")).withColumn("p", text.parse_evidence(F.col("e"))).select("n", "e", "p.*")


_COND = "CASE WHEN o_totalprice > 400000 THEN 0 WHEN o_totalprice > 300000 THEN 1 WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 3 ELSE 4 END"


@R.query("e24_grade", f"""WITH f AS (SELECT o_orderkey AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'C' WHEN '5-LOW' THEN 'D' ELSE 'INFO' END AS mode, {_COND} AS c FROM orders)
  SELECT n, mode, ['CRITICAL','HIGH','MEDIUM','LOW','INFO'][c + 1] AS severity, CAST(c + 1 AS INTEGER) AS rank FROM f""")
def _(spark, d):
    mode = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'C' WHEN '5-LOW' THEN 'D' ELSE 'INFO' END")
    conds = F.create_map(*[x for m, cs in verdicts.GRADES.items() for x in (F.lit(m), F.array(*map(F.lit, cs)))])
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), mode.alias("mode"), F.expr(_COND).alias("c"))
    graded = rows.withColumn("severity", verdicts.grade(F.col("mode"), F.get(conds[F.col("mode")], F.col("c"))))
    return graded.select("n", "mode", "severity", verdicts.level_rank(F.col("severity")).alias("rank"))


@R.query("w2_record_score", f"WITH {V.SCORES_SQL} SELECT * FROM scores")
def _(spark, d):
    return _scores(spark, d)


def _scores(spark, d):
    ev = V.score_events(spark, d)
    return fd.record_score(ev.filter("l_shipdate < '1999-01-01'"), ev.filter("l_shipdate >= '1999-01-01'"), ["l_shipdate", "l_partkey", "l_suppkey", "score"])


_PROMO = f"""{V.SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY round DESC) AS r FROM scores),
  p AS (SELECT chain_id, count(*) AS n, min(round) AS lo, max(round) AS last_round, min(score) AS worst FROM r WHERE r <= 3 GROUP BY 1),
  promo AS (SELECT chain_id, last_round, worst, n = 3 AND last_round - lo = 2 AND worst > 70 AS promoted,
  CASE WHEN NOT (n = 3 AND last_round - lo = 2) THEN 'fewer than 3 rounds in a row' WHEN worst <= 70 THEN 'not all > 70' END AS reason FROM p)"""


@R.query("w1_promote", f"WITH {_PROMO} SELECT * FROM promo")
def _(spark, d):
    return fd.promote(_scores(spark, d), threshold=70)


@R.query("s5_promoted_findings", f"""WITH {_PROMO}, dr AS (SELECT o_orderkey AS chain_id, o_orderpriority FROM orders) SELECT dr.chain_id, o_orderpriority, coalesce(promoted, false) AS promoted, reason,
  CASE WHEN promoted THEN 'final' ELSE 'draft' END AS status FROM dr LEFT JOIN promo ON promo.chain_id = dr.chain_id""")
def _(spark, d):
    drafts = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("chain_id"), "o_orderpriority")
    return fd.promote_drafts(_scores(spark, d), drafts, threshold=70)


@R.query("a28_score_round", """WITH s AS (SELECT l_orderkey AS round, CASE l_linenumber WHEN 1 THEN 'execution' WHEN 2 THEN 'judgement' WHEN 3 THEN 'thinking' WHEN 4 THEN 'accuracy' ELSE 'format' END AS dimension, CAST(l_quantity AS INTEGER) AS score FROM lineitem)
  SELECT round, CAST(sum(score) AS BIGINT) AS total, bool_and(CASE WHEN dimension IN ('execution', 'judgement', 'thinking') THEN score >= 27 WHEN dimension = 'accuracy' THEN score >= 9 ELSE true END) AS floors_met,
  count(*) FILTER (dimension <> 'format') AS n_main, bool_and(CASE WHEN dimension IN ('execution', 'judgement', 'thinking') THEN score >= 27 WHEN dimension = 'accuracy' THEN score >= 9 ELSE true END)
  AND count(*) FILTER (dimension <> 'format') >= 4 AS passed FROM s GROUP BY 1""")
def _(spark, d):
    dim = F.expr("CASE l_linenumber WHEN 1 THEN 'execution' WHEN 2 THEN 'judgement' WHEN 3 THEN 'thinking' WHEN 4 THEN 'accuracy' ELSE 'format' END")
    return fd.score_round(V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("round"), dim.alias("dimension"), F.col("l_quantity").cast("int").alias("score")))


_RANK = "CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END"


@R.query("a9_endpoint_severity", f"WITH {V.FINDINGS_SQL} SELECT endpoint_fqn, arg_min(severity, {_RANK}) AS severity, count(*) AS n_findings FROM findings GROUP BY 1")
def _(spark, d):
    return fd.endpoint_severity(V.findings(spark, d))


_LV = ", ".join(f"coalesce(count(*) FILTER (severity = '{s}'), 0) AS n_{s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))


@R.query("a10_chains_by_class", """SELECT concat('shop::Customer', o_custkey) AS endpoint_fqn, o_orderstatus AS chain_class, count(*) AS n_chains FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def _(spark, d):
    chains = V.table(spark, d, "orders").join(V.table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return fd.chains_by_class(chains.select(F.concat(F.lit("shop::Customer"), S("o_custkey")).alias("endpoint_fqn"), F.col("o_orderstatus").alias("chain_class")))


@R.query("a10_api_assets", f"""WITH {V.FINDINGS_SQL}, l AS (SELECT endpoint_fqn, {_LV}, count(DISTINCT vuln_type) AS n_types FROM findings GROUP BY 1),
  c AS (SELECT concat('shop::Customer', o_custkey) AS endpoint_fqn, count(*) AS n_chains, count(DISTINCT o_orderstatus) AS n_classes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
  e AS (SELECT concat('shop::Customer', c_custkey) AS endpoint_fqn FROM customer)
  SELECT e.endpoint_fqn, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low, coalesce(n_info, 0) AS n_info, coalesce(n_types, 0) AS n_types,
  coalesce(n_chains, 0) AS n_chains, coalesce(n_classes, 0) AS n_classes, coalesce(n_critical, 0) + coalesce(n_high, 0) AS n_high_risk
  FROM e LEFT JOIN l ON l.endpoint_fqn = e.endpoint_fqn LEFT JOIN c ON c.endpoint_fqn = e.endpoint_fqn""")
def _(spark, d):
    name = lambda c: F.concat(F.lit("shop::Customer"), S(c)).alias("endpoint_fqn")
    chains = V.table(spark, d, "orders").join(V.table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        name("o_custkey"), F.col("o_orderstatus").alias("chain_class"))
    return fd.api_assets(V.table(spark, d, "customer").select(name("c_custkey")), V.findings(spark, d), chains)


@R.query("a10_high_risk_detail", f"WITH {V.FINDINGS_SQL} SELECT endpoint_fqn, chain_id, vuln_type, severity, score FROM findings WHERE severity IN ('CRITICAL', 'HIGH')")
def _(spark, d):
    return fd.high_risk_detail(V.findings(spark, d))


@R.query("a13_verification_rate", f"""WITH {V.FINDINGS_SQL}, h AS (SELECT count(*) AS n_high, count(*) FILTER (poc_status IN ('confirmed_vuln', 'confirmed_safe')) AS n_verified FROM findings WHERE severity IN ('CRITICAL', 'HIGH'))
  SELECT n_high, n_verified, round(n_verified / n_high, 6) AS rate, n_verified / n_high >= 0.75 AS ok FROM h""")
def _(spark, d):
    return fd.verification_rate(V.findings(spark, d))


@R.query("f24_verification_queue", f"""WITH {V.FINDINGS_SQL}, env AS (SELECT CAST(user_id AS VARCHAR) AS g, arg_max(event_type <> 'error', {{a: ts, b: event_id}}) AS reachable FROM events GROUP BY 1)
  SELECT chain_id, severity, CASE WHEN coalesce(reachable, false) THEN 'verify' ELSE 'needs_human' END AS queue FROM findings LEFT JOIN env ON env.g = CAST(n % 200 AS VARCHAR) WHERE severity IN ('CRITICAL', 'HIGH')""")
def _(spark, d):
    env = V.table(spark, d, "events").select(S("user_id").alias("group_id"), F.struct("ts", "event_id").alias("checked_at"), (F.col("event_type") != "error").alias("reachable"))
    f = V.findings(spark, d).withColumn("group_id", (F.col("n") % 200).cast("string"))
    return fd.verification_queue(f, env).select("chain_id", "severity", "queue")


@R.query("f25_apply_exemptions", f"""WITH {V.FINDINGS_SQL}, ex AS (SELECT DISTINCT concat('shop::Customer', c_custkey) AS e FROM customer WHERE c_acctbal < 0)
  SELECT n, CASE WHEN mode = 'B' THEN 'INFO' ELSE severity END AS severity FROM findings WHERE NOT (endpoint_fqn IN (SELECT e FROM ex) AND vuln_type = 'IDOR') AND mode <> 'X'""")
def _(spark, d):
    exempt = V.table(spark, d, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("shop::Customer"), S("c_custkey")).alias("endpoint_fqn"), F.lit("IDOR").alias("vuln_type"))
    f = V.findings(spark, d).withColumns({"enum_id": F.col("mode") == "X", "internal": F.col("mode") == "B", "internal_network": F.lit(True)})
    return fd.apply_exemptions(f, exempt).select("n", "severity")


@R.query("j20_mark_fp", f"""WITH {V.FINDINGS_SQL}, lib AS (SELECT concat('shop::Customer', o_custkey, '::order', o_orderkey) AS fqn, 'IDOR' AS vuln_type, min(concat('fp', l_partkey)) AS fp FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2)
  SELECT n, fp AS similar_to_fp FROM findings f LEFT JOIN lib ON lib.fqn = f.fqn AND lib.vuln_type = f.vuln_type""")
def _(spark, d):
    o, li = V.table(spark, d, "orders"), V.table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    lib = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("shop::Customer"), S("o_custkey"), F.lit("::order"), S("o_orderkey")).alias("fqn"), F.lit("IDOR").alias("vuln_type"), F.concat(F.lit("fp"), S("l_partkey")).alias("fp_id"))
    return fd.mark_fp(V.findings(spark, d), lib).select("n", "similar_to_fp")


@R.query("j16_attack_matrix", """WITH f AS (SELECT p_brand AS domain, p_type AS pattern, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 48 GROUP BY 1, 2),
  c AS (SELECT domain, unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']) AS pattern FROM (SELECT DISTINCT p_brand AS domain FROM part) q)
  SELECT c.domain, c.pattern, coalesce(n, 0) AS n, coalesce(n, 0) = 0 AS uncovered FROM c LEFT JOIN f ON f.domain = c.domain AND f.pattern = c.pattern""")
def _(spark, d):
    part = V.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("domain"), F.col("p_type").alias("pattern"))
    hits = V.table(spark, d, "lineitem").filter("l_quantity > 48").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return fd.attack_matrix(part, ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], hits)


@R.query("j18_missing_rules", """WITH c AS (SELECT DISTINCT l_orderkey AS chain_id, l_linestatus AS object, concat('r', l_linenumber) AS rule FROM lineitem),
  e AS (SELECT DISTINCT l_linestatus AS object, concat('r', l_linenumber) AS rule FROM lineitem WHERE (l_linestatus = 'O' AND l_linenumber <= 3) OR (l_linestatus = 'F' AND l_linenumber > 5)),
  w AS (SELECT DISTINCT c.chain_id, c.object, e.rule FROM c JOIN e ON e.object = c.object) SELECT w.* FROM w ANTI JOIN c ON c.chain_id = w.chain_id AND c.object = w.object AND c.rule = w.rule""")
def _(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chain_id"), F.col("l_linestatus").alias("object"), F.concat(F.lit("r"), S("l_linenumber")).alias("rule"), "l_linenumber")
    want = li.filter("(object = 'O' AND l_linenumber <= 3) OR (object = 'F' AND l_linenumber > 5)").select("object", "rule").distinct()
    return fd.missing_rules(li, want)


_RT = """rt AS (SELECT concat('rt', l_partkey, '-', l_linenumber, '-', l_suppkey) AS id, CASE WHEN l_linestatus = 'O' THEN left(sha256(concat('m', l_orderkey)), 16) END AS static_reference, CAST(l_linenumber % 4 AS BIGINT) AS n_evidence,
  l_returnflag = 'R' AND l_linenumber = 7 AS diverges, l_returnflag = 'A' AND l_linenumber = 6 AS filtered, l_shipdate, concat('T', l_suppkey) AS target, CAST(l_quantity AS BIGINT) AS duration_ms,
  CASE l_returnflag WHEN 'R' THEN 'RUNTIME-CONFIRMED' WHEN 'A' THEN 'RUNTIME-DENIED' ELSE 'RUNTIME-BLOCKED' END AS status, CASE WHEN l_tax > 0.04 THEN 'HIGH' ELSE 'LOW' END AS severity, concat('A0', l_linenumber, ':2021') AS category FROM lineitem)"""


def _runtime(spark, d):
    return spark.sql("""SELECT concat('rt', l_partkey, '-', l_linenumber, '-', l_suppkey) AS id, CASE WHEN l_linestatus = 'O' THEN left(sha2(concat('m', l_orderkey), 256), 16) END AS static_reference,
        CAST(l_linenumber % 4 AS BIGINT) AS n_evidence, l_returnflag = 'R' AND l_linenumber = 7 AS diverges, l_returnflag = 'A' AND l_linenumber = 6 AS filtered, concat('T', l_suppkey) AS target,
        CAST(l_quantity AS BIGINT) AS duration_ms, CASE l_returnflag WHEN 'R' THEN 'RUNTIME-CONFIRMED' WHEN 'A' THEN 'RUNTIME-DENIED' ELSE 'RUNTIME-BLOCKED' END AS status,
        CASE WHEN l_tax > 0.04 THEN 'HIGH' ELSE 'LOW' END AS severity, concat('A0', l_linenumber, ':2021') AS category FROM {li}""", li=V.table(spark, d, "lineitem"))


@R.query("j13_link_runtime", f"""WITH {V.FINDINGS_SQL}, {_RT}, a AS (SELECT static_reference AS c, sum(n_evidence) AS e, bool_or(diverges) AS dv, bool_or(filtered) AS fl FROM rt GROUP BY 1)
  SELECT chain_id, CAST(coalesce(e, 0) AS BIGINT) AS n_evidence, CASE WHEN fl THEN 'RUNTIME-BLOCKED' WHEN dv THEN 'RUNTIME-DIVERGENCE' WHEN e > 0 THEN 'RUNTIME-CONFIRMED' ELSE 'RUNTIME-DENIED' END AS status FROM findings LEFT JOIN a ON a.c = chain_id""")
def _(spark, d):
    return fd.link_runtime(V.findings(spark, d).select("chain_id"), _runtime(spark, d))


@R.query("a5_runtime_summary", f"""WITH {_RT} SELECT 'total_findings' AS scope, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM rt UNION ALL SELECT 'by_status', status, count(*) FROM rt GROUP BY 2
  UNION ALL SELECT 'by_severity', severity, count(*) FROM rt GROUP BY 2 UNION ALL SELECT 'by_category', category, count(*) FROM rt GROUP BY 2""")
def _(spark, d):
    return fd.runtime_summary(_runtime(spark, d))


@R.query("a6_runtime_totals", f"""WITH {_RT} SELECT count(DISTINCT target) AS unique_targets, round(count(static_reference) / count(*), 6) AS static_linkage_rate, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
  CAST(sum(duration_ms) * 200 AS BIGINT) AS total_token_estimate FROM rt""")
def _(spark, d):
    return fd.runtime_totals(_runtime(spark, d))


@R.query("e35_e38_runtime_grade", f"""WITH {_RT} SELECT id, static_reference, CASE WHEN n_evidence > 1 AND diverges AND severity = 'HIGH' THEN 'HIGH' WHEN n_evidence >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  regexp_matches(category, '^A(?:0[1-9]|10):2021\\b|^Custom-\\S') AS owasp_ok FROM rt""")
def _(spark, d):
    return _runtime(spark, d).select("id", "static_reference", verdicts.confidence(F.col("n_evidence"), F.col("diverges"), F.col("severity") == "HIGH").alias("confidence"),
                                     verdicts.owasp(F.col("category")).alias("owasp_ok"))


@R.query("a29_chain_cardinality", f"WITH {V.SCORES_SQL} SELECT count(*) AS n_findings, count(DISTINCT chain_id) AS n_chains FROM score_events")
def _(spark, d):
    return fd.chain_cardinality(V.score_events(spark, d))


@R.query("a29_merged_cardinality", f"""WITH {V.SCORES_SQL}, g AS (SELECT round, year(l_shipdate) AS y, chain_id FROM score_events),
  e AS (SELECT CAST(round AS VARCHAR) AS scope, count(*) AS n_findings, count(DISTINCT chain_id) AS n_chains FROM g GROUP BY 1
    UNION ALL SELECT concat('year ', y), count(*), count(DISTINCT chain_id) FROM g GROUP BY 1 UNION ALL SELECT 'all', count(*), count(DISTINCT chain_id) FROM g)
  SELECT scope, n_findings, n_chains, true AS within FROM e""")
def _(spark, d):
    """Sketches of (round, year) are stored once and merged three ways; each must be within five standard errors of the exact count."""
    rows = V.score_events(spark, d).withColumn("y", F.year("l_shipdate"))
    stored = materialize(fd.chain_sketches(rows, ["round", "y"]), "sketches")
    scopes = {"round": F.col("round").cast("string"), "y": F.concat(F.lit("year "), F.col("y").cast("string")), None: F.lit("all")}
    out = None
    for by, name in scopes.items():
        about = fd.merged_cardinality(stored, [by] if by else []).select(name.alias("scope"), "n_findings", "about_chains")
        exact = rows.groupBy(*([by] if by else [])).agg(F.count_distinct("chain_id").alias("n_chains")).select(name.alias("scope"), "n_chains")
        both = about.join(exact, "scope")
        out = both if out is None else out.unionAll(both)
    error = 5 * 1.04 / 2 ** (fd.SKETCH_BITS / 2)
    return out.select("scope", "n_findings", "n_chains", (F.abs(F.col("about_chains") - F.col("n_chains")) <= F.col("n_chains") * error + 1).alias("within"))


@R.query("w6_number_ids", f"""WITH {V.FINDINGS_SQL}, x AS (SELECT n, evidence, row_number() OVER (ORDER BY ts, n) AS no FROM findings), y AS (SELECT n, no, unnest(evidence) AS item, generate_subscripts(evidence, 1) AS pos FROM x)
  SELECT n, 'F-' || lpad(CAST(no AS VARCHAR), CAST(greatest(3, length(CAST(no AS VARCHAR))) AS INTEGER), '0') AS finding_id, item, 'E-' || lpad(CAST(pos AS VARCHAR), 3, '0') AS evidence_id FROM y""")
def _(spark, d):
    return fd.number_ids(V.findings(spark, d).select("ts", "n", "evidence"), ["ts", "n"]).select("n", "finding_id", "item", "evidence_id")


@R.query("w7_dedupe_hits", """SELECT file, line, rule, l_suppkey FROM (SELECT l_partkey AS file, l_linenumber AS line, l_returnflag AS rule, l_suppkey,
  row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_suppkey) AS r FROM lineitem) q WHERE r = 1""")
def _(spark, d):
    hits = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("rule"), "l_suppkey")
    return fd.dedupe_hits(hits, F.when(F.col("rule") == "R", 0).when(F.col("rule") == "A", 1).otherwise(2), ["l_suppkey"])


@R.query("k4_top_bottom", f"""WITH {V.FINDINGS_SQL} (SELECT n, score, 'top' AS "end" FROM findings ORDER BY score DESC, n LIMIT 5) UNION ALL (SELECT n, score, 'bottom' FROM findings ORDER BY score, n LIMIT 5)""")
def _(spark, d):
    return fd.top_bottom(V.findings(spark, d).select("n", "score"), "score", "n")


@R.query("k5_sample_reports", "SELECT doc_id, source FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2000")
def _(spark, d):
    return fd.sample_rows(V.table(spark, d, "documents").select("doc_id", "source"), F.col("doc_id"), 0.2)


_VT = """t AS (SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 'y' ELSE 'n' END AS expected, CASE WHEN l_quantity > 40 THEN NULL WHEN l_returnflag = 'R' THEN 'y' WHEN l_returnflag = 'A' THEN 'n' ELSE 'o' END AS actual,
  CASE WHEN l_tax > 0.04 THEN 'v2' ELSE 'v1' END AS version FROM lineitem)"""


def _cases(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "y").otherwise("n").alias("expected"),
                                                F.when(F.col("l_quantity") > 40, None).when(F.col("l_returnflag") == "R", "y").when(F.col("l_returnflag") == "A", "n").otherwise("o").alias("actual"),
                                                F.when(F.col("l_tax") > 0.04, "v2").otherwise("v1").alias("version"))


@R.query("a20_verdict_matrix", f"""WITH {_VT} SELECT expected, count(*) FILTER (actual = 'y') AS actual_y, count(*) FILTER (actual = 'n') AS actual_n, count(*) FILTER (actual = 'o') AS actual_o, count(*) FILTER (actual IS NULL) AS unmatched, count(*) AS n FROM t GROUP BY 1""")
def _(spark, d):
    return fd.verdict_matrix(_cases(spark, d))


@R.query("a20_verdict_rates", f"""WITH {_VT}, q AS (SELECT count(*) AS n, count(actual) AS matched, count(*) FILTER (actual = expected) AS "right" FROM t) SELECT n, matched, "right", round(matched / n, 6) AS matched_rate, round("right" / matched, 6) AS accuracy FROM q""")
def _(spark, d):
    return fd.verdict_rates(_cases(spark, d))


@R.query("a21_compare_versions", f"""WITH {_VT} SELECT actual AS verdict, count(*) FILTER (version = 'v1') AS n_old, count(*) FILTER (version = 'v2') AS n_new, count(*) FILTER (version = 'v2') - count(*) FILTER (version = 'v1') AS change FROM t GROUP BY 1""")
def _(spark, d):
    return fd.compare_versions(_cases(spark, d).withColumnRenamed("actual", "verdict"), "v1", "v2")


@R.query("j25_join_verdicts", """WITH n AS (SELECT DISTINCT concat('k', o_custkey) AS key FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'), v AS (SELECT concat('k', c_custkey) AS key, c_mktsegment AS verdict FROM customer WHERE c_acctbal > 5000)
  SELECT coalesce(n.key, v.key) AS key, verdict, CASE WHEN n.key IS NULL THEN 'only_verdict' WHEN verdict IS NULL THEN 'only_node' ELSE 'matched' END AS side FROM n FULL JOIN v ON v.key = n.key""")
def _(spark, d):
    nodes = V.table(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderpriority = '5-LOW'").select(F.concat(F.lit("k"), S("o_custkey")).alias("key")).distinct()
    answers = V.table(spark, d, "customer").filter("c_acctbal > 5000").select(F.concat(F.lit("k"), S("c_custkey")).alias("key"), F.col("c_mktsegment").alias("verdict"))
    return fd.join_verdicts(nodes, answers)


@R.query("j21_env_asof", """WITH r AS (SELECT user_id AS group_id, ts, event_id AS req_id FROM events WHERE event_type IN ('purchase', 'view', 'click')), v AS (SELECT user_id, ts AS checked, event_id, CASE WHEN value > 20 THEN 'reachable' ELSE 'unreachable' END AS state FROM events WHERE event_type IN ('error', 'signup')),
  j AS (SELECT r.*, v.checked, v.state FROM r ASOF LEFT JOIN v ON v.user_id = r.group_id AND v.checked <= r.ts)
  SELECT req_id, group_id, ts, CASE WHEN epoch_us(ts) - epoch_us(checked) <= 86400000000 THEN checked END AS checked_at, CASE WHEN epoch_us(ts) - epoch_us(checked) <= 86400000000 THEN state ELSE 'unknown' END AS state FROM j""")
def _(spark, d):
    ev = V.table(spark, d, "events").withColumnRenamed("user_id", "group_id")
    req = ev.filter(F.col("event_type").isin("purchase", "view", "click")).select("group_id", "ts", F.col("event_id").alias("req_id"))
    env = ev.filter(F.col("event_type").isin("error", "signup")).select("group_id", "ts", F.col("event_id").alias("rec_id"), F.when(F.col("value") > 20, "reachable").otherwise("unreachable").alias("state"))
    return fd.env_asof(req, env, 86400)


# --- reports and reconciliation ---------------------------------------------------------------------

_NAME = "'^(?:(是问题|非问题|暂时无法确认|failed)_)?(致命|严重|高危|中危|低危|无|CRITICAL|HIGH|MEDIUM|LOW|INFO)_(?:(\\d+(?:\\.\\d+)?)_([^_]+)_)?(.+)_([A-Za-z0-9$-]+)_([0-9a-f]{6,64})\\.md$'"
_PARSED = f"""{V.REPORTS_SQL}, parsed AS (SELECT *, regexp_matches(name, {_NAME}) AS ok, nullif(regexp_extract(name, {_NAME}, 1), '') AS state, nullif(regexp_extract(name, {_NAME}, 2), '') AS level,
  nullif(replace(regexp_extract(name, {_NAME}, 5), '__', '.'), '') AS class, nullif(regexp_extract(name, {_NAME}, 6), '') AS method, nullif(regexp_extract(name, {_NAME}, 7), '') AS sig FROM reports)"""


@R.query("e16_parse_report_name", f"WITH {_PARSED} SELECT doc_id, state, level, class, method, sig FROM parsed")
def _(spark, d):
    return V.reports(spark, d).withColumn("p", text.parse_report_name(F.col("name"))).select("doc_id", "p.state", "p.level", "p.class", "p.method", "p.sig")


@R.query("e17_md_field", f"""WITH {V.REPORTS_SQL} SELECT doc_id, nullif(regexp_extract(text, '(?m)\\*\\*验证状态\\*\\*[:：][ \\t]*(.+?)[ \\t]*$', 1), '') AS state, nullif(regexp_extract(text, '(?m)\\*\\*等级\\*\\*[:：][ \\t]*(.+?)[ \\t]*$', 1), '') AS level FROM reports""")
def _(spark, d):
    return V.reports(spark, d).select("doc_id", text.md_field(F.col("text"), "验证状态").alias("state"), text.md_field(F.col("text"), "等级").alias("level"))


_EPK = "eps AS (SELECT DISTINCT concat('com.example.src', c_custkey % 25, '#', ['en', 'fr', 'de', 'es'][1 + c_nationkey % 4], c_custkey % 50) AS key FROM customer)"


def _report_keys(spark, d):
    lang = F.get(F.array(*map(F.lit, ["en", "fr", "de", "es"])), (F.col("c_nationkey") % 4))
    return V.table(spark, d, "customer").select(F.concat(F.lit("com.example.src"), (F.col("c_custkey") % 25).cast("string"), F.lit("#"), lang, (F.col("c_custkey") % 50).cast("string")).alias("key"))


@R.query("j12_coverage_issues", f"""WITH {_PARSED}, {_EPK}, r AS (SELECT class || '#' || method AS key, count(*) AS n FROM parsed WHERE ok GROUP BY 1)
  SELECT * FROM (SELECT CASE WHEN r.key IS NULL THEN 'missing' WHEN e.key IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' END AS issue, coalesce(e.key, r.key) AS name, coalesce(n, 0) AS n FROM eps e FULL JOIN r ON r.key = e.key) q WHERE issue IS NOT NULL
  UNION ALL SELECT 'unparsable', name, count(*) FROM parsed WHERE NOT ok GROUP BY name""")
def _(spark, d):
    return reconcile.coverage_issues(_report_keys(spark, d), V.reports(spark, d).select("name"))


@R.query("j12_coverage", f"""WITH {_PARSED}, {_EPK}, a AS (SELECT count(*) FILTER (level IN ('致命', '严重', 'CRITICAL')) AS n_hi, count(*) FILTER (ok AND level NOT IN ('致命', '严重', 'CRITICAL')) AS n_lo, count(*) FILTER (NOT ok) AS n_unparsable FROM parsed)
  SELECT (SELECT count(*) FROM eps) AS n_endpoints, n_hi, n_lo, n_unparsable, n_hi + n_lo = (SELECT count(*) FROM eps) AS invariant_ok FROM a""")
def _(spark, d):
    return reconcile.coverage(_report_keys(spark, d), V.reports(spark, d).select("name"))


@R.query("u2_missing_extra", f"""WITH {_PARSED}, {_EPK}, r AS (SELECT DISTINCT class || '#' || method AS key FROM parsed WHERE ok)
  SELECT 'missing' AS side, key FROM eps WHERE key NOT IN (SELECT key FROM r) UNION ALL SELECT 'extra', key FROM r WHERE key NOT IN (SELECT key FROM eps)""")
def _(spark, d):
    issues = reconcile.coverage_issues(_report_keys(spark, d), V.reports(spark, d).select("name"))
    return issues.filter("issue IN ('missing', 'extra')").select(F.col("issue").alias("side"), F.col("name").alias("key"))


_REC = f"""{V.FINDINGS_SQL}, {V.KV_SQL}, ep AS (SELECT DISTINCT concat('shop::Customer', c_custkey) AS e FROM customer), rp AS (SELECT concat('shop::Customer', c_custkey) AS e FROM customer WHERE c_acctbal >= 0),
  m AS (SELECT (SELECT count(*) FROM findings) AS n_f, (SELECT count(DISTINCT endpoint_fqn) FROM findings) AS n_fe, (SELECT count(*) FROM (SELECT DISTINCT endpoint_fqn AS x FROM findings) q WHERE x IS NULL OR x NOT IN (SELECT e FROM ep)) AS unl,
  (SELECT count(*) FROM findings WHERE severity IN ('CRITICAL', 'HIGH')) AS hi, (SELECT count(*) FROM findings WHERE severity IN ('CRITICAL', 'HIGH') AND poc_status IN ('confirmed_vuln', 'confirmed_safe')) AS ve,
  (SELECT count(*) FROM findings WHERE endpoint_fqn IN (SELECT e FROM ep)) AS lis, (SELECT count(chain_id) FROM findings) AS nc,
  (SELECT count(score) FROM findings) AS sc, (SELECT count(*) FROM findings WHERE score >= 85) AS ab, (SELECT count(*) FROM findings WHERE status = 'final') AS fi, (SELECT count(DISTINCT chain_id) FROM findings) AS ch,
  (SELECT count(*) FROM ep) AS ne, (SELECT count(*) FROM kv WHERE kind = 'final') AS kf, (SELECT count(*) FROM kv WHERE kind = 'chain') AS kc, (SELECT count(*) FROM events WHERE event_type = 'error') AS nf,
  (SELECT count(*) FROM events WHERE event_type = 'error' AND value > 300) AS st, (SELECT count(*) FROM rp) AS nr, (SELECT count(*) FROM ep WHERE e IN (SELECT e FROM rp)) AS cov),
  items AS (SELECT '1_endpoints' AS item, n_fe AS declared, ne AS actual, unl = 0 AS ok FROM m UNION ALL SELECT '2_findings', n_f, lis, n_f = lis FROM m UNION ALL SELECT '3_verification', hi, ve, hi = 0 OR ve >= 0.75 * hi FROM m
  UNION ALL SELECT '4_scores', sc, ab, sc = n_f AND ab >= sc FROM m UNION ALL SELECT '5_finals', fi, kf, fi = kf FROM m UNION ALL SELECT '6_chains', nc, ch, ch = nc FROM m UNION ALL SELECT '7_failures', nf, st, st = 0 FROM m
  UNION ALL SELECT '8_report_coverage', ne, cov, cov = ne AND nr = ne FROM m UNION ALL SELECT '9_cache_chains', ch, kc, ch = kc FROM m)"""


def _items(spark, d, findings=None):
    cust = V.table(spark, d, "customer").withColumn("endpoint_fqn", F.concat(F.lit("shop::Customer"), S("c_custkey")))
    fails = V.table(spark, d, "events").filter("event_type = 'error'").select(F.when(F.col("value") > 300, "stuck").otherwise("timeout").alias("failure_type"))
    return reconcile.reconcile(V.findings(spark, d) if findings is None else findings, cust, V.kv(spark, d), fails, cust.filter("c_acctbal >= 0"))


@R.query("a22_reconcile", f"WITH {_REC} SELECT * FROM items")
def _(spark, d):
    return _items(spark, d)


_FAULTS = _REC.replace("findings AS (", "clean_findings AS (", 1).replace(", ep AS (", """, findings AS (
  SELECT * REPLACE (CASE WHEN mode = 'X' THEN NULL ELSE endpoint_fqn END AS endpoint_fqn, CASE WHEN mode = 'INFO' THEN NULL ELSE score END AS score) FROM clean_findings
  UNION ALL SELECT * FROM clean_findings WHERE mode = 'A'), ep AS (""", 1)


@R.query("a22_reconcile_faults", f"WITH {_FAULTS} SELECT * FROM items")
def _(spark, d):
    """Findings without an endpoint or a score and chains named twice: items 2, 4 and 6 must fail."""
    f = V.findings(spark, d)
    bad = f.withColumn("endpoint_fqn", F.when(F.col("mode") != "X", F.col("endpoint_fqn"))).withColumn("score", F.when(F.col("mode") != "INFO", F.col("score")))
    return _items(spark, d, bad.unionByName(f.filter("mode = 'A'")))


@R.query("a22_reconcile_verdict", f"WITH {_REC} SELECT bool_and(ok) AS all_ok, count(*) FILTER (NOT ok) AS warn_count, count(*) FILTER (NOT ok) <= 1 AS may_end FROM items")
def _(spark, d):
    return reconcile.reconcile_verdict(_items(spark, d))


# The four demands on a report, and the rule that a success response without impact proves nothing.
_ATTACK = " OR ".join(f"regexp_matches(text, {Q(p)})" for p in ATTACK_PAYLOADS)
_HARM = " OR ".join(f"regexp_matches(text, {Q(p)})" for ps in IMPACT_PATTERNS.values() for p in ps)
_QUAL = rf"""facts AS (SELECT doc_id, coalesce(state, regexp_extract(name, '^(是问题|非问题|暂时无法确认|failed)', 1)) AS name_state, nullif(regexp_extract(text, '(?m)\*\*验证状态\*\*[:：][ \t]*(.+?)[ \t]*$', 1), '') AS body_state,
  {_ATTACK} AS has_payload, regexp_matches(text, 'HTTP/\d|\b(?:200|30\d|40\d|50\d)\b') AS has_response, regexp_matches(text, '\w+\.\w+:\d+') AS cites_lines, contains(text, '缺乏充分的输入验证和输出编码') AS template,
  {_HARM} AS harm, regexp_matches(text, 'HTTP/\S+ 20\d|\b200\b') AS success FROM parsed),
  judged AS (SELECT *, CASE WHEN name_state <> coalesce(body_state, '') THEN 'CONTRADICTION' WHEN template OR NOT (has_payload AND has_response AND cites_lines) OR (success AND NOT harm) THEN 'FAKE' ELSE 'OK' END AS verdict FROM facts)"""


@R.query("e20_report_quality", f"WITH {_PARSED}, {_QUAL} SELECT doc_id, name_state, body_state, has_payload, has_response, cites_lines, template, verdict FROM judged")
def _(spark, d):
    return reconcile.report_quality(V.reports(spark, d)).select("doc_id", "name_state", "body_state", "has_payload", "has_response", "cites_lines", "template", "verdict")


@R.query("a11_global_stats", f"""WITH {V.FINDINGS_SQL}, {_PARSED}, {_QUAL}
  SELECT lower(s) AS counter, (SELECT count(*) FROM findings WHERE severity = s) AS n FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO']) AS s) q
  UNION ALL SELECT 'total_reports', count(*) FROM judged UNION ALL SELECT 'poc_verified', count(*) FILTER (verdict = 'OK') FROM judged UNION ALL SELECT 'poc_fake', count(*) FILTER (verdict <> 'OK') FROM judged""")
def _(spark, d):
    return fd.global_stats(V.findings(spark, d), reconcile.report_quality(V.reports(spark, d)))


@R.query("e20_quality_round", f"""WITH {_PARSED}, {_QUAL}, x AS (SELECT count(*) AS n, count(*) FILTER (verdict <> 'OK') AS n_fake FROM judged)
  SELECT n, n_fake, round(n_fake / n, 6) AS fake_share, n_fake / n > 0.05 AS failed FROM x""")
def _(spark, d):
    return reconcile.quality_round(reconcile.report_quality(V.reports(spark, d)))


_DIMS = f"""{V.ROUNDS_SQL}, w AS (SELECT (SELECT count(*) FILTER (quality = 1) / count(*) FROM labels) AS completion, (SELECT count(*) FILTER (n_chars > 200) / count(*) FROM documents) AS source_coverage,
  (SELECT CASE WHEN bool_and(p54_pass AND total_reports >= ep_lines) THEN 1.0 ELSE 0.0 END FROM rounds) AS rounds_pass, (SELECT count(*) FILTER (toxic = 1) / count(*) FROM labels) AS fake_share, (SELECT count(*) FILTER (role = 'assistant') / count(*) FROM conversations) AS real_work)"""


@R.query("a23_five_dims", f"""WITH {_DIMS} SELECT 1 AS no, 'completion' AS dimension, round(completion, 6) AS value, completion >= 1 AS ok FROM w UNION ALL SELECT 2, 'source_coverage', round(source_coverage, 6), source_coverage >= 0.95 FROM w
  UNION ALL SELECT 3, 'rounds_pass', CAST(rounds_pass AS DOUBLE), rounds_pass >= 1 FROM w UNION ALL SELECT 4, 'fake_share', round(fake_share, 6), fake_share <= 0.05 FROM w UNION ALL SELECT 5, 'real_work', round(real_work, 6), real_work >= 0.95 FROM w""")
def _(spark, d):
    labels, docs = V.table(spark, d, "labels"), V.table(spark, d, "documents")
    return reconcile.five_dims(
        labels.select((F.col("quality") == 1).alias("finished")), docs.select((F.col("n_chars") > 200).alias("present")), V.rounds(spark, d),
        labels.select(F.when(F.col("toxic") == 1, "FAKE").otherwise("OK").alias("verdict")),
        V.table(spark, d, "conversations").select(F.when(F.col("role") == "assistant", "REAL_WORK").otherwise("TEMPLATE").alias("quality")))


@R.query("a24_end_conditions", f"""WITH {_REC}, {_PROMO.replace('70', '61')}, w AS (SELECT l_linenumber AS round, min(CAST(least(100, 60 + l_quantity) AS INTEGER)) AS score FROM lineitem GROUP BY 1),
  rw AS (SELECT min(score) > 61 AND count(*) = 3 AND max(round) - min(round) = 2 AS ok FROM (SELECT * FROM w ORDER BY round DESC LIMIT 3) q),
  c AS (SELECT (SELECT bool_and(quality = 1) FROM labels) AS reports_finished, (SELECT ve >= 0.75 * hi FROM m) AS verified_enough,
  (SELECT bool_and(p85) FROM (SELECT n = 3 AND last_round - lo = 2 AND worst > 85 AS p85 FROM p) q) AS chains_scored,
  (SELECT min(score) > 85 FROM (SELECT * FROM w ORDER BY round DESC LIMIT 3) q) AS rounds_scored, (SELECT count(*) FILTER (NOT ok) <= 1 FROM items) AS reconciled)
  SELECT *, reports_finished AND verified_enough AND chains_scored AND rounds_scored AND reconciled AS may_end FROM c""")
def _(spark, d):
    ev = V.score_events(spark, d).select("round", "score")
    return reconcile.end_conditions(V.table(spark, d, "labels").select((F.col("quality") == 1).alias("finished")), V.findings(spark, d), _scores(spark, d), ev, _items(spark, d))


@R.query("j22_sync_diff", f"""WITH {V.FILES_SQL}, o AS (SELECT path, content_hash FROM files WHERE doc_id % 10 <> 0), n AS (SELECT path, CASE WHEN size > 1000 THEN sha256(text || ' ') ELSE content_hash END AS content_hash FROM files WHERE doc_id % 10 <> 1)
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON n.path = o.path WHERE o.content_hash IS DISTINCT FROM n.content_hash""")
def _(spark, d):
    f = V.files(spark, d)
    new = f.filter("doc_id % 10 <> 1").withColumn("content_hash", F.when(F.col("size") > 1000, F.sha2(F.concat("text", F.lit(" ")), 256)).otherwise(F.col("content_hash")))
    return reconcile.sync_diff(f.filter("doc_id % 10 <> 0"), new)


# --- cache -------------------------------------------------------------------------------------------

@R.query("e14_kv_parse", f"""WITH {V.KV_SQL} SELECT n, key, CASE WHEN kind <> 'global' THEN group_id END AS group_id, CASE WHEN kind <> 'global' THEN commit_hash END AS commit_hash, kind, CASE WHEN kind <> 'env' THEN entity END AS entity,
  CASE WHEN kind IN ('method', 'judgment', 'astmatch', 'score', 'file_status', 'file_chain_count') THEN sub END AS sub FROM kv""")
def _(spark, d):
    return records.read_kv(V.kv(spark, d).select("n", "key")).select("n", "key", "group_id", "commit_hash", "kind", "entity", "sub")


@R.query("a7_kv_stats", f"WITH {V.KV_SQL} SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("method", "chain", "prefetch", "draft", "final")) + " FROM kv")
def _(spark, d):
    return reconcile.kv_stats(V.kv(spark, d))


@R.query("r3_expire", f"""WITH {V.KV_SQL}, t AS (SELECT *, CASE WHEN kind IN ('method', 'astmatch') THEN 86400 WHEN kind IN ('chain', 'prefetch', 'judgment', 'env') THEN 3600 WHEN kind = 'draft' THEN 2592000 WHEN kind IN ('killed', 'force-rescan') THEN 604800 END AS ttl FROM kv)
  SELECT n, key, kind FROM t WHERE ttl IS NULL OR written_at + to_seconds(ttl) > TIMESTAMP '2001-07-25 00:00:00'""")
def _(spark, d):
    return keys.expire(V.kv(spark, d), F.to_timestamp(F.lit("2001-07-25 00:00:00"))).select("n", "key", "kind")


_TRUTH = "truth AS (SELECT key, CASE WHEN n % 13 = 0 THEN 'other' ELSE body END AS body FROM kv WHERE kind = 'method' AND n % 17 <> 0)"


def _truth(kv):
    return kv.filter("kind = 'method' AND n % 17 <> 0").select("key", F.when(F.col("n") % 13 == 0, "other").otherwise(F.col("body")).alias("body"))


@R.query("j14_self_check", f"""WITH {V.KV_SQL}, {_TRUTH}, p AS (SELECT key, body FROM kv WHERE kind = 'method' ORDER BY md5(key), key LIMIT 50)
  SELECT p.key, CASE WHEN t.key IS NULL THEN 'not_in_graph' WHEN t.body <> p.body THEN 'body_mismatch' END AS reason, t.key IS NULL OR t.body <> p.body AS to_delete FROM p LEFT JOIN truth t ON t.key = p.key""")
def _(spark, d):
    kv = V.kv(spark, d)
    return reconcile.self_check(kv.filter("kind = 'method'").select("key", "body"), _truth(kv))


@R.query("u3_key_overlap", f"WITH {V.KV_SQL}, {_TRUTH} SELECT key FROM kv INTERSECT SELECT key FROM truth")
def _(spark, d):
    kv = V.kv(spark, d)
    return reconcile.key_overlap(kv, _truth(kv))


@R.query("e15_prefetch", """WITH m AS (SELECT l_orderkey AS c, l_linenumber, l_partkey, concat('p', l_partkey) AS fqn, CASE WHEN l_returnflag = 'N' THEN 'given' ELSE left(sha256(concat('b', l_partkey)), 16) END AS h FROM lineitem)
  SELECT CAST(c AS VARCHAR) AS chain_id, 'method' AS kind, concat('audit:g:commit:HEAD:method:', fqn, '#', h) AS key, fqn AS shown FROM m UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), 'prefetch', concat('audit:g:commit:HEAD:prefetch:', o_orderkey), coalesce(l, '') FROM orders LEFT JOIN (SELECT c, string_agg(fqn || '#' || h, ',' ORDER BY l_linenumber, fqn, h) AS l FROM m GROUP BY 1) q ON q.c = o_orderkey""")
def _(spark, d):
    li = V.table(spark, d, "lineitem").select(
        S("l_orderkey").alias("chain_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("p"), S("l_partkey")).alias("fqn"),
        F.when(F.col("l_returnflag") == "N", "given").alias("sig_hash"), F.concat(F.lit("b"), S("l_partkey")).alias("body"), F.lit("F.java").alias("file"), F.lit(1).alias("line"))
    out = keys.prefetch(V.table(spark, d, "orders").select(S("o_orderkey").alias("chain_id")), li, "g", "HEAD")
    pages = F.from_json("value", "methods array<struct<fqn:string,sig_hash:string>>, fqn string")
    shown = F.when(F.col("kind") == "method", pages["fqn"]).otherwise(F.array_join(F.transform(pages["methods"], lambda m: F.concat(m["fqn"], F.lit("#"), m["sig_hash"])), ","))
    return out.select("chain_id", "kind", "key", shown.alias("shown"))


@R.query("s7_named_reports", f"WITH {_PARSED} SELECT doc_id, CASE WHEN level IN ('致命', '严重') THEN 'high' ELSE 'low' END AS folder, class, method, sig FROM parsed WHERE ok")
def _(spark, d):
    high = F.col("name").rlike("^(?:[^_]*_)?(?:致命|严重)_")
    named = records.named_reports(V.reports(spark, d).select("name", F.when(high, "high").otherwise("low").alias("folder"), F.concat_ws("\n", S("doc_id"), "text").alias("text")))
    return named.filter("class IS NOT NULL").select(F.substring_index("text", "\n", 1).cast("long").alias("doc_id"), "folder", "class", "method", "sig")
