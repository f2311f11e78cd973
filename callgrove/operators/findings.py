"""Findings: validation, scores and promotion, summaries, linkage with runtime records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.constants import MODES, POC_STATES, PROMOTION_ROUNDS, PROMOTION_THRESHOLD, ROUND_DIMENSIONS, SEVERITIES, VERIFICATION_RATE
from callgrove.functions.text import parse_evidence
from callgrove.functions.times import micros
from callgrove.functions.verdicts import level_rank
from callgrove.plans.chunked import carry_last, number_rows
from callgrove.schemas import schema

REQUIRED = ["chain_id", "endpoint", "fqn", "vuln_type", "severity", "evidence", "summary", "mode", "confidence"]
# --- fixed values: vulnerability types of a mode ---
# Kinds of chain nodes.
NODE_TYPES = ["endpoint", "service", "dao", "data", "external", "framework"]
MODE_TYPES = {"B": ["MISSING_AUTH", "AUTH_BYPASS", "PRIVILEGE_ESCALATION"]}
JUDGMENT_STATES = {"D2_auth_state": ["present", "missing", "bypassable"], "D3_business_rule": ["enforced", "missing", "conditional"]}


def union_modes(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def validate_findings(f: DataFrame) -> DataFrame:
    """Adds ``errors``: every rule of the finding schema that a row breaks."""
    has = lambda c: c in f.columns
    col = F.col
    checks: list[Column] = [F.when(col(c).isNull() if has(c) else F.lit(True), f"missing:{c}") for c in REQUIRED]
    for c, allowed in (("mode", MODES), ("severity", SEVERITIES), ("poc_status", POC_STATES), ("status", ["draft", "final"])):
        if has(c):
            checks.append(F.when(~col(c).isin(allowed), f"enum:{c}"))
    if has("confidence"):
        checks.append(F.when(~col("confidence").between(0, 1), "range:confidence"))
    if has("score"):
        checks.append(F.when(~col("score").between(0, 100), "range:score"))
    for c, n in (("summary", 500), ("business_impact", 300), ("poc_payload", 500)):
        if has(c):
            checks.append(F.when(F.length(c) > n, f"length:{c}"))
    if has("evidence"):
        checks.append(F.when(~F.forall("evidence", lambda e: parse_evidence(e)["line"].isNotNull()), "evidence:no_line"))
    if has("mode") and has("vuln_type"):
        for mode, types in MODE_TYPES.items():
            checks.append(F.when((col("mode") == mode) & ~col("vuln_type").isin(types), "mode:vuln_type"))
    if has("judgment"):
        for field, states in JUDGMENT_STATES.items():
            if field in f.schema["judgment"].dataType.names:
                checks.append(F.when(~col("judgment")[field].isin(states), f"enum:{field}"))
    if has("chain") and "node_type" in getattr(getattr(f.schema["chain"].dataType, "elementType", None), "names", []):
        checks.append(F.when(F.exists("chain", lambda n: ~n["node_type"].isin(NODE_TYPES)), "enum:node_type"))
    known = {*schema("finding").names, "file", "line_no", "unknown_keys"}
    checks += [F.lit(f"unknown_key:{c}") for c in f.columns if c not in known]
    errors = F.array_compact(F.array(*checks))
    if has("unknown_keys"):
        errors = F.concat(errors, F.transform(F.coalesce("unknown_keys", F.array().cast("array<string>")), lambda k: F.concat(F.lit("unknown_key:"), k)))
    return f.withColumn("errors", errors)


def record_score(scores: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """Scores after an upsert: the latest row per (chain, round); ``order`` says what is later."""
    rows = scores.unionByName(new)
    return rows.groupBy("chain_id", "round").agg(F.max_by("score", F.struct(*order)).alias("score"))


def promote(scores: DataFrame, k: int = PROMOTION_ROUNDS, threshold: int = PROMOTION_THRESHOLD) -> DataFrame:
    """A chain is promoted when its last ``k`` rounds follow each other and all score above the threshold."""
    latest = Window.partitionBy("chain_id").orderBy(F.desc("round"))
    last = scores.withColumn("r", F.row_number().over(latest)).filter(F.col("r") <= k)
    per = last.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.min("round").alias("lo"), F.max("round").alias("hi"), F.min("score").alias("worst"))
    whole = (F.col("n") == k) & (F.col("hi") - F.col("lo") == k - 1)
    reason = F.when(~whole, f"fewer than {k} rounds in a row").when(F.col("worst") <= threshold, f"not all > {threshold}")
    return per.select("chain_id", F.col("hi").alias("last_round"), "worst", reason.isNull().alias("promoted"), reason.alias("reason"))


def promote_drafts(scores: DataFrame, drafts: DataFrame, **kw) -> DataFrame:
    """Draft findings with their new status."""
    ready = promote(scores, **kw).select("chain_id", "promoted", "reason")
    out = drafts.join(ready, "chain_id", "left")
    return out.withColumn("promoted", F.coalesce("promoted", F.lit(False))).withColumn("status", F.when(F.col("promoted"), "final").otherwise("draft"))


def score_round(scores: DataFrame) -> DataFrame:
    """Total and verdict of a round from its dimension rows; every main dimension has its own floor."""
    floor = F
    for name, _, least in ROUND_DIMENSIONS:
        floor = floor.when(F.col("dimension") == name, F.col("score") >= least)
    main = F.col("dimension").isin([n for n, _, _ in ROUND_DIMENSIONS])
    out = scores.groupBy("round").agg(
        F.sum("score").alias("total"), F.bool_and(floor.otherwise(F.lit(True))).alias("floors_met"), F.count_if(main).alias("n_main"))
    return out.withColumn("passed", F.col("floors_met") & (F.col("n_main") >= len(ROUND_DIMENSIONS)))


def endpoint_severity(f: DataFrame) -> DataFrame:
    """Gravest severity over the chains of an endpoint."""
    return f.groupBy("endpoint_fqn").agg(F.min_by("severity", level_rank(F.col("severity"))).alias("severity"), F.count(F.lit(1)).alias("n_findings"))


def api_assets(endpoints: DataFrame, f: DataFrame, chains: DataFrame) -> DataFrame:
    """Per API: findings by level, chains by class, and the number of high-risk findings."""
    by_level = f.groupBy("endpoint_fqn").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES], F.countDistinct("vuln_type").alias("n_types"))
    by_class = chains.groupBy("endpoint_fqn").agg(F.count(F.lit(1)).alias("n_chains"), F.countDistinct("chain_class").alias("n_classes"))
    out = endpoints.select("endpoint_fqn").distinct().join(by_level, "endpoint_fqn", "left").join(by_class, "endpoint_fqn", "left").na.fill(0)
    return out.withColumn("n_high_risk", F.col("n_critical") + F.col("n_high"))


def chains_by_class(chains: DataFrame) -> DataFrame:
    """Chains of each API by class, one row per (endpoint, class)."""
    return chains.groupBy("endpoint_fqn", "chain_class").agg(F.count(F.lit(1)).alias("n_chains"))


def high_risk_detail(f: DataFrame) -> DataFrame:
    return f.filter(F.col("severity").isin("CRITICAL", "HIGH")).select("endpoint_fqn", "chain_id", "vuln_type", "severity", "score")


def global_stats(f: DataFrame, poc: DataFrame) -> DataFrame:
    """Project counters: findings by level, reports, verified and fake ones, as (counter, n)."""
    a = f.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    b = poc.agg(F.count(F.lit(1)).alias("total_reports"), F.count_if(F.col("verdict") == "OK").alias("poc_verified"),
                F.count_if(F.col("verdict") != "OK").alias("poc_fake"))
    long = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in df.columns])))
    return long(a).unionAll(long(b))


def verification_rate(f: DataFrame, least: float = VERIFICATION_RATE) -> DataFrame:
    high = F.col("severity").isin("CRITICAL", "HIGH")
    done = F.col("poc_status").isin("confirmed_vuln", "confirmed_safe")
    out = f.agg(F.count_if(high).alias("n_high"), F.count_if(high & done).alias("n_verified"))
    rate = F.when(F.col("n_high") > 0, F.col("n_verified") / F.col("n_high")).otherwise(1.0)
    return out.withColumn("rate", F.round(rate, 6)).withColumn("ok", rate >= least)


def verification_queue(f: DataFrame, env: DataFrame) -> DataFrame:
    """Findings to verify: the two top levels, unless their environment cannot be reached."""
    state = env.groupBy("group_id").agg(F.max_by("reachable", "checked_at").alias("reachable"))
    top = f.filter(F.col("severity").isin("CRITICAL", "HIGH")).join(state, "group_id", "left")
    return top.withColumn("queue", F.when(F.coalesce("reachable", F.lit(False)), "verify").otherwise("needs_human"))


def apply_exemptions(f: DataFrame, exempt: DataFrame) -> DataFrame:
    """Drop exempt rules and enumerated ids; findings on internal interfaces of an internal net become INFO."""
    kept = f.join(exempt.select("endpoint_fqn", "vuln_type"), ["endpoint_fqn", "vuln_type"], "left_anti").filter(~F.col("enum_id"))
    return kept.withColumn("severity", F.when(F.col("internal") & F.col("internal_network"), "INFO").otherwise(F.col("severity")))


def mark_fp(f: DataFrame, library: DataFrame) -> DataFrame:
    """Tag findings that resemble a known false positive."""
    known = library.groupBy("fqn", "vuln_type").agg(F.min("fp_id").alias("similar_to_fp"))
    return f.join(known, ["fqn", "vuln_type"], "left")


def attack_matrix(domains: DataFrame, patterns: Sequence[str], f: DataFrame) -> DataFrame:
    """Every (domain, pattern) cell with its finding count; the patterns are a short fixed list."""
    cells = domains.select("domain").distinct().withColumn("pattern", F.explode(F.array(*map(F.lit, patterns))))
    counts = f.groupBy("domain", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["domain", "pattern"], "left").na.fill(0, ["n"]).withColumn("uncovered", F.col("n") == 0)


def missing_rules(chain_rules: DataFrame, expected: DataFrame) -> DataFrame:
    """Rules expected for the business objects of a chain that the chain never checks."""
    want = chain_rules.select("chain_id", "object").distinct().join(expected, "object")
    return want.join(chain_rules.select("chain_id", "object", "rule").distinct(), ["chain_id", "object", "rule"], "left_anti")


def link_runtime(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """Status of each static finding from its runtime records."""
    seen = runtime.groupBy(F.col("static_reference").alias("chain_id")).agg(
        F.sum("n_evidence").alias("n_evidence"), F.bool_or("diverges").alias("diverges"), F.bool_or("filtered").alias("filtered"))
    status = (F.when(F.col("filtered"), "RUNTIME-BLOCKED").when(F.col("diverges"), "RUNTIME-DIVERGENCE")
              .when(F.col("n_evidence") > 0, "RUNTIME-CONFIRMED").otherwise("RUNTIME-DENIED"))
    return static.join(seen, "chain_id", "left").select("chain_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), status.alias("status"))


def runtime_summary(f: DataFrame) -> DataFrame:
    """Totals and counts by status, severity and category from one grouping-sets pass."""
    out = f.groupingSets([[], ["status"], ["severity"], ["category"]], "status", "severity", "category").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("status").alias("gs"), F.grouping("severity").alias("gv"), F.grouping("category").alias("gc"))
    scope = (F.when(F.col("gs") == 0, "by_status").when(F.col("gv") == 0, "by_severity").when(F.col("gc") == 0, "by_category").otherwise("total_findings"))
    value = F.when(F.col("gs") == 0, F.col("status")).when(F.col("gv") == 0, F.col("severity")).when(F.col("gc") == 0, F.col("category"))
    return out.select(scope.alias("scope"), value.alias("value"), "n")


def runtime_totals(f: DataFrame) -> DataFrame:
    """Targets, share of findings linked to a static one, duration, and the token estimate."""
    linked = F.avg(F.col("static_reference").isNotNull().cast("int"))
    return f.agg(F.countDistinct("target").alias("unique_targets"), F.round(linked, 6).alias("static_linkage_rate"),
                 F.sum("duration_ms").alias("duration_ms"), (F.sum("duration_ms") * 200).alias("total_token_estimate"))


def chain_cardinality(f: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return f.agg(F.count(F.lit(1)).alias("n_findings"), count("chain_id").alias("n_chains"))


#: Base-2 logarithm of the registers of a stored sketch; the relative standard error is 1.04 / sqrt(2^SKETCH_BITS), 0.8 %.
SKETCH_BITS = 14


def chain_sketches(f: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each group, to be stored: its findings and a sketch of its chains, of a size that no number of chains changes."""
    return f.groupBy(*by).agg(F.count(F.lit(1)).alias("n_findings"), F.hll_sketch_agg(F.col("chain_id").cast("string"), F.lit(SKETCH_BITS)).alias("chains"))


def merged_cardinality(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Findings and about how many distinct chains the groups named by ``by`` have, of stored sketches alone.

    A chain of several merged groups counts once, which sums of their counts could not tell.
    """
    return sketches.groupBy(*by).agg(F.coalesce(F.sum("n_findings"), F.lit(0)).alias("n_findings"),
                                     F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("chains")), F.lit(0)).alias("about_chains"))


def number_ids(f: DataFrame, order: Sequence[str]) -> DataFrame:
    """``F-001`` over the whole table and ``E-001`` within a finding; one row per evidence item."""
    pad = lambda prefix, c: F.concat(F.lit(prefix), F.when(F.length(c.cast("string")) < 3, F.lpad(c.cast("string"), 3, "0")).otherwise(c.cast("string")))
    rows = number_rows(f, order, "no").withColumn("finding_id", pad("F-", F.col("no"))).drop("no")
    return rows.select("*", F.posexplode_outer("evidence").alias("at", "item")).withColumn(
        "evidence_id", F.when(F.col("item").isNotNull(), pad("E-", F.col("at") + 1))).drop("at", "evidence")


def dedupe_hits(hits: DataFrame, rank: Column, tie: Sequence[str]) -> DataFrame:
    """One hit per line, the best-ranked rule."""
    row = F.struct(*[F.col(c) for c in hits.columns])
    return hits.groupBy("file", "line").agg(F.min_by(row, F.struct(rank, *[F.col(c) for c in tie])).alias("h")).select("h.*")


def top_bottom(df: DataFrame, score: str, key: str, n: int = 5) -> DataFrame:
    """Best and worst ``n`` rows; both ends are cut per task before they meet."""
    best = df.orderBy(F.desc(score), key).limit(n).withColumn("end", F.lit("top"))
    worst = df.orderBy(F.asc(score), key).limit(n).withColumn("end", F.lit("bottom"))
    return best.unionByName(worst)


def sample_rows(df: DataFrame, key: Column, rate: float) -> DataFrame:
    """Reproducible sample: a row is in when the hash of its key falls below ``rate``."""
    point = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 10_000
    return df.filter(point < int(rate * 10_000))


def join_verdicts(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Classifier answers against walk nodes, with what fails to match on either side."""
    n = nodes.select("key", F.lit(True).alias("in_walk"))
    out = n.join(verdicts.select("key", "verdict"), "key", "full")
    side = F.when(F.col("in_walk").isNull(), "only_verdict").when(F.col("verdict").isNull(), "only_node").otherwise("matched")
    return out.select("key", "verdict", side.alias("side"))


def verdict_matrix(t: DataFrame) -> DataFrame:
    """Cases by expected and actual verdict."""
    return t.groupBy("expected").agg(
        *[F.count_if(F.col("actual") == v).alias(f"actual_{v}") for v in ("y", "n", "o")],
        F.count_if(F.col("actual").isNull()).alias("unmatched"), F.count(F.lit(1)).alias("n"))


def verdict_rates(t: DataFrame) -> DataFrame:
    out = t.agg(F.count(F.lit(1)).alias("n"), F.count("actual").alias("matched"), F.count_if(F.col("actual") == F.col("expected")).alias("right"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return out.withColumn("matched_rate", ratio("matched", "n")).withColumn("accuracy", ratio("right", "matched"))


def compare_versions(t: DataFrame, old: str, new: str) -> DataFrame:
    """Totals per verdict of two versions side by side, with the change."""
    both = t.filter(F.col("version").isin(old, new)).groupBy("verdict").agg(
        F.count_if(F.col("version") == old).alias("n_old"), F.count_if(F.col("version") == new).alias("n_new"))
    return both.withColumn("change", F.col("n_new") - F.col("n_old"))


def env_asof(requests: DataFrame, env: DataFrame, ttl_s: int = 3600) -> DataFrame:
    """Latest reachability record at or before each request and not older than the TTL.

    Requests and records are merged and the last record is carried forward day by day, so a busy
    environment is spread over its days and no request-record pair is built.
    """
    a = requests.select("group_id", "ts", "req_id", F.lit(1).alias("side"), F.lit(None).cast("string").alias("state"))
    b = env.select("group_id", "ts", F.col("rec_id").alias("req_id"), F.lit(0).alias("side"), "state")
    merged = carry_last(a.unionByName(b), ["group_id"], ["ts", "side", "req_id"], F.to_date("ts"),
                        F.when(F.col("side") == 0, F.struct(F.col("ts").alias("at"), "state")), "last")
    fresh = micros("ts") - micros(F.col("last.at")) <= ttl_s * 1_000_000
    gate = F.when(fresh, F.col("last.state")).otherwise("unknown")
    return merged.filter("side = 1").select("req_id", "group_id", "ts", F.when(fresh, F.col("last.at")).alias("checked_at"), gate.alias("state"))
