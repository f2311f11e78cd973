"""Coverage, reconciliation, round verdicts and cache checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.constants import ATTACK_PAYLOADS, FAKE_SHARE, PROMOTION_THRESHOLD, TEMPLATE_SENTENCE, VERIFICATION_RATE
from callgrove.functions.text import impact_evidence, md_field, parse_report_name
from callgrove.functions.times import micros
from callgrove.plans.chunked import neighbour

HIGH_LEVELS = ["致命", "严重", "CRITICAL"]


def _long(df: DataFrame) -> DataFrame:
    """A one-row aggregate as (metric, value) rows."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])))


def _wide(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Several one-row aggregates as one row; empty inputs still give their zero."""
    rows = reduce(lambda a, b: a.unionAll(b), [_long(p) for p in parts])
    return rows.agg(*[F.coalesce(F.max(F.when(F.col("metric") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names])


def coverage_issues(endpoints: DataFrame, reports: DataFrame, include_unconfirmed: bool = True) -> DataFrame:
    """Endpoints without report, reports without endpoint, duplicate and unparsable names.

    ``endpoints(key)``; ``reports(name)``.  Both sides are reduced to one row per key first.
    """
    r = reports.withColumn("p", parse_report_name(F.col("name")))
    if not include_unconfirmed:
        r = r.filter(F.col("p.state").isNull() | (F.col("p.state") != "暂时无法确认"))
    named = r.filter(F.col("p").isNotNull()).groupBy(F.concat("p.class", F.lit("#"), "p.method").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    both = endpoints.select("key").distinct().withColumn("listed", F.lit(True)).join(named, "key", "full")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    out = both.select(issue.alias("issue"), F.col("key").alias("name"), F.coalesce("n", F.lit(0)).alias("n")).filter("issue is not null")
    odd = r.filter(F.col("p").isNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(odd.select(F.lit("unparsable").alias("issue"), "name", "n"))


def coverage(endpoints: DataFrame, reports: DataFrame) -> DataFrame:
    """Report counts by risk class against the endpoint list, and the invariant between them."""
    p = parse_report_name(F.col("name"))
    r = reports.withColumn("p", p).agg(
        F.count_if(F.col("p.level").isin(HIGH_LEVELS)).alias("n_hi"),
        F.count_if(F.col("p").isNotNull() & ~F.col("p.level").isin(HIGH_LEVELS)).alias("n_lo"),
        F.count_if(F.col("p").isNull()).alias("n_unparsable"))
    e = endpoints.agg(F.countDistinct("key").alias("n_endpoints"))
    names = ["n_endpoints", "n_hi", "n_lo", "n_unparsable"]
    out = _wide([e, r], names).select(*[F.col(n).cast("long").alias(n) for n in names])
    return out.withColumn("invariant_ok", F.col("n_hi") + F.col("n_lo") == F.col("n_endpoints"))


_METRICS = ["n_findings", "n_finding_endpoints", "n_unlisted", "n_listed", "n_high", "n_verified", "n_scored", "n_above", "n_final", "n_chains", "n_chain_ids",
            "n_endpoints", "kv_final", "kv_chain", "n_failures", "n_stuck", "n_reports", "n_covered"]


def reconcile(f: DataFrame, endpoints: DataFrame, kv: DataFrame, failures: DataFrame, reports: DataFrame, score_share: float = 1.0) -> DataFrame:
    """The nine reconciliation items: ``item, declared, actual, ok``.

    Findings must add up over the listed endpoints, all be scored with at least ``score_share`` of them at
    the threshold or above, and name each chain once.  Each input is reduced to one row of counts, so only
    counts meet.
    """
    col, count = F.col, F.count_if
    high = col("severity").isin("CRITICAL", "HIGH")
    done = col("poc_status").isin("confirmed_vuln", "confirmed_safe")
    a = f.agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("endpoint_fqn").alias("n_finding_endpoints"),
              count(high).alias("n_high"), count(high & done).alias("n_verified"), F.count("score").alias("n_scored"),
              count(col("score") >= PROMOTION_THRESHOLD).alias("n_above"), count(col("status") == "final").alias("n_final"),
              F.count("chain_id").alias("n_chains"), F.countDistinct("chain_id").alias("n_chain_ids"))
    listed = endpoints.select("endpoint_fqn").distinct()
    b = listed.agg(F.count(F.lit(1)).alias("n_endpoints"))
    lost = f.select("endpoint_fqn").distinct().join(listed, "endpoint_fqn", "left_anti").agg(F.count(F.lit(1)).alias("n_unlisted"))
    known = f.select("endpoint_fqn").join(listed, "endpoint_fqn", "left_semi").agg(F.count(F.lit(1)).alias("n_listed"))
    c = kv.agg(count(col("kind") == "final").alias("kv_final"), count(col("kind") == "chain").alias("kv_chain"))
    d = failures.agg(F.count(F.lit(1)).alias("n_failures"), count(col("failure_type") == "stuck").alias("n_stuck"))
    r = reports.select("endpoint_fqn").agg(F.count(F.lit(1)).alias("n_reports"))
    cov = listed.join(reports.select("endpoint_fqn"), "endpoint_fqn", "left_semi").agg(F.count(F.lit(1)).alias("n_covered"))
    m = _wide([a, b, lost, known, c, d, r, cov], _METRICS)
    item = lambda name, declared, actual, ok: F.struct(F.lit(name).alias("item"), declared.cast("long").alias("declared"), actual.cast("long").alias("actual"), ok.alias("ok"))
    rate_ok = (col("n_high") == 0) | (col("n_verified") >= VERIFICATION_RATE * col("n_high"))
    return m.select(F.inline(F.array(
        item("1_endpoints", col("n_finding_endpoints"), col("n_endpoints"), col("n_unlisted") == 0),
        item("2_findings", col("n_findings"), col("n_listed"), col("n_findings") == col("n_listed")),
        item("3_verification", col("n_high"), col("n_verified"), rate_ok),
        item("4_scores", col("n_scored"), col("n_above"), (col("n_scored") == col("n_findings")) & (col("n_above") >= score_share * col("n_scored"))),
        item("5_finals", col("n_final"), col("kv_final"), col("n_final") == col("kv_final")),
        item("6_chains", col("n_chains"), col("n_chain_ids"), col("n_chain_ids") == col("n_chains")),
        item("7_failures", col("n_failures"), col("n_stuck"), col("n_stuck") == 0),
        item("8_report_coverage", col("n_endpoints"), col("n_covered"), (col("n_covered") == col("n_endpoints")) & (col("n_reports") == col("n_endpoints"))),
        item("9_cache_chains", col("n_chain_ids"), col("kv_chain"), col("n_chain_ids") == col("kv_chain")))))


def reconcile_verdict(items: DataFrame) -> DataFrame:
    """All good, number of warnings, and whether the loop may end (one warning at most)."""
    out = items.agg(F.bool_and("ok").alias("all_ok"), F.count_if(~F.col("ok")).alias("warn_count"))
    return out.withColumn("may_end", F.col("warn_count") <= 1)


def five_dims(reports: DataFrame, artifacts: DataFrame, rounds: DataFrame, poc: DataFrame, sessions: DataFrame) -> DataFrame:
    """Round verdict: completion, source coverage, round status, truthfulness, process quality."""
    parts = [
        reports.agg(F.avg(F.col("finished").cast("double")).alias("completion")),
        artifacts.agg(F.avg(F.col("present").cast("double")).alias("source_coverage")),
        rounds.agg(F.min((F.col("p54_pass") & (F.col("total_reports") >= F.col("ep_lines"))).cast("double")).alias("rounds_pass")),
        poc.agg(F.avg((F.col("verdict") != "OK").cast("double")).alias("fake_share")),
        sessions.agg(F.avg((F.col("quality") == "REAL_WORK").cast("double")).alias("real_work")),
    ]
    w = _wide(parts, ["completion", "source_coverage", "rounds_pass", "fake_share", "real_work"])
    dim = lambda n, name, ok: F.struct(F.lit(n).alias("no"), F.lit(name).alias("dimension"), F.round(F.col(name), 6).alias("value"), ok.alias("ok"))
    return w.select(F.inline(F.array(
        dim(1, "completion", F.col("completion") >= 1.0), dim(2, "source_coverage", F.col("source_coverage") >= 0.95),
        dim(3, "rounds_pass", F.col("rounds_pass") >= 1.0), dim(4, "fake_share", F.col("fake_share") <= FAKE_SHARE),
        dim(5, "real_work", F.col("real_work") >= 0.95))))


def end_conditions(reports: DataFrame, f: DataFrame, chain_scores: DataFrame, round_scores: DataFrame, items: DataFrame) -> DataFrame:
    """The five conditions under which the rounds may stop, and whether all hold."""
    from callgrove.operators.findings import promote, verification_rate

    flag = lambda df, c: df.select(F.col(c).cast("double").alias(c))
    a = reports.agg(F.bool_and("finished").cast("double").alias("reports_finished"))
    b = flag(verification_rate(f).withColumnRenamed("ok", "verified_enough"), "verified_enough")
    c = promote(chain_scores).agg(F.bool_and("promoted").cast("double").alias("chains_scored"))
    worst = round_scores.groupBy("round").agg(F.min("score").alias("score")).withColumn("chain_id", F.lit("rounds"))
    d = flag(promote(worst).withColumnRenamed("promoted", "rounds_scored"), "rounds_scored")
    e = flag(reconcile_verdict(items).withColumnRenamed("may_end", "reconciled"), "reconciled")
    names = ["reports_finished", "verified_enough", "chains_scored", "rounds_scored", "reconciled"]
    w = _wide([a, b, c, d, e], names)
    met = w.select(*[(F.col(n) > 0).alias(n) for n in names])
    return met.withColumn("may_end", reduce(lambda x, y: x & y, [F.col(n) for n in names]))


def round_trend(rounds: DataFrame, window: int = 3) -> DataFrame:
    """Reports and verified cases per round, change against the round before, and steadiness.

    The round before is the last one that took place, numbers may be left out.  A round is steady if it and
    the ``window`` - 1 before it changed by at most a tenth.
    """
    per = rounds.groupBy("round").agg(F.sum("total_reports").alias("reports"), F.sum("n_poc").alias("poc"), F.bool_and("p54_pass").alias("passed"))
    near = lambda df, value, name: neighbour(df, ["__all"], ["round"], F.floor(F.col("round") / 1000), value, name)
    out = near(per.withColumn("__all", F.lit(0)), F.col("reports"), "__prev")
    out = out.withColumn("change", F.col("reports") - F.col("__prev"))
    out = out.withColumn("__run", F.coalesce(F.abs("change") <= F.col("__prev") * 0.1, F.lit(False))).withColumn("steady", F.col("__run"))
    for _ in range(window - 1):
        out = near(out, F.col("__run"), "__before").withColumn("__run", F.coalesce("__before", F.lit(False))).drop("__before")
        out = out.withColumn("steady", F.col("steady") & F.col("__run"))
    return out.select("round", "reports", "poc", "passed", "change", "steady")


def delta(df: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """``prev``, the value of the version before (numbers may be left out), and ``delta``, the change since, per key."""
    out = neighbour(df, [key], [version], F.floor(F.col(version) / 1000), F.col(value), "prev")
    return out.withColumn("delta", F.col(value) - F.col("prev"))


def resume_round(rounds: DataFrame) -> DataFrame:
    """Round to continue with: the one after the last that passed."""
    return rounds.agg((F.coalesce(F.max(F.when(F.col("p54_pass"), F.col("round"))), F.lit(0)) + 1).alias("next_round"))


def report_quality(reports: DataFrame) -> DataFrame:
    """Verdict per report from its name and body: OK, FAKE or CONTRADICTION.

    A report is fake without an attack payload (a request that only shows that the endpoint answers is
    none), without a response, without a cited line, with the template sentence, or when a success response
    shows no impact.
    """
    named = F.coalesce(parse_report_name(F.col("name"))["state"], F.regexp_extract("name", "^(是问题|非问题|暂时无法确认|failed)", 1))
    body = F.col("text")
    out = reports.withColumns({
        "name_state": named, "body_state": md_field(body, "验证状态"),
        "has_payload": body.rlike("|".join(ATTACK_PAYLOADS)), "has_response": body.rlike(r"HTTP/\d|\b(?:200|30\d|40\d|50\d)\b"),
        "cites_lines": body.rlike(r"\w+\.\w+:\d+"), "template": body.contains(TEMPLATE_SENTENCE),
        "n_impact": F.lit(3) - impact_evidence(body)["n_empty"]})
    bare = body.rlike(r"HTTP/\S+ 20\d|\b200\b") & (F.col("n_impact") == 0)
    verdict = (F.when(F.col("name_state") != F.coalesce("body_state", F.lit("")), "CONTRADICTION")
               .when(F.col("template") | ~F.col("has_payload") | ~F.col("has_response") | ~F.col("cites_lines") | bare, "FAKE").otherwise("OK"))
    return out.withColumn("verdict", verdict).drop("text")


def quality_round(judged: DataFrame) -> DataFrame:
    """Share of fake or contradictory reports; above the limit the round fails."""
    out = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") != "OK").alias("n_fake"))
    share = F.when(F.col("n") > 0, F.col("n_fake") / F.col("n")).otherwise(0.0)
    return out.withColumn("fake_share", F.round(share, 6)).withColumn("failed", share > FAKE_SHARE)


def process_quality(parts: DataFrame, hung_after_s: int = 600) -> DataFrame:
    """Per session: real work reads or searches, template work only writes, a hung one stays silent."""
    per = parts.groupBy("session_id").agg(
        F.count_if(F.col("tool").isin("read", "grep", "sql", "ast")).alias("n_look"), F.count_if(F.col("tool") == "write").alias("n_write"),
        F.count_if(F.length("output") > 0).alias("n_output"),
        ((F.max(micros("ts")) - F.min(micros("ts"))) / 1_000_000).alias("span_s"))
    quality = (F.when((F.col("n_output") == 0) & (F.col("span_s") >= hung_after_s), "HUNG").when(F.col("n_look") > 0, "REAL_WORK").otherwise("TEMPLATE"))
    return per.select("session_id", "n_look", "n_write", "n_output", quality.alias("quality"))


def self_check(kv: DataFrame, truth: DataFrame, n: int = 50) -> DataFrame:
    """Compare ``n`` cached bodies, picked by the hash of their key, with the truth; mismatches carry a reason."""
    picked = kv.orderBy(F.md5("key"), "key").limit(n)
    out = picked.join(truth.select(F.col("key"), F.col("body").alias("true_body"), F.lit(True).alias("known")), "key", "left")
    reason = F.when(F.col("known").isNull(), "not_in_graph").when(~F.col("body").eqNullSafe(F.col("true_body")), "body_mismatch")
    return out.select("key", reason.alias("reason"), reason.isNotNull().alias("to_delete"))


def self_check_summary(checked: DataFrame) -> DataFrame:
    out = checked.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if("to_delete").alias("n_mismatch"))
    return out.withColumn("warning", F.when(F.col("n_checked") == 0, "no keys found"))


def key_overlap(kv: DataFrame, truth: DataFrame) -> DataFrame:
    """Keys that both the cache and the graph hold."""
    return kv.select("key").intersect(truth.select("key"))


def kv_stats(kv: DataFrame) -> DataFrame:
    kinds = ["method", "chain", "prefetch", "draft", "final"]
    return kv.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def sync_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, modified or removed between two snapshots, by content hash."""
    a = old.select("path", F.col("content_hash").alias("was"))
    b = new.select("path", F.col("content_hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")
