"""Pruning decisions, dispatch of modes, and statistics of the pruning rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.constants import FALSE_KILL_LIMIT, LOW_VALUE_SHARE, MODES, PRUNE_SAMPLE
from callgrove.functions.keys import kv_key, short_hash


def _modes(*names: str) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def l1_prune(endpoints: DataFrame, known_annotations: Sequence[str] = (), internal: Sequence[str] = ("@Inner",)) -> DataFrame:
    """Endpoint rules, first match wins.

    ``endpoints(.., path, params array<struct<name,type>>, annotations, permit_all, filter_covered, internal_network)``.
    """
    p = F.col("params")
    numeric = F.forall(p, lambda x: x["type"].isin("int", "long", "double", "boolean", "enum"))
    inner = F.exists("annotations", lambda a: a.isin(*internal))
    unknown = F.exists("annotations", lambda a: ~a.isin(*known_annotations, *internal))
    rules = [
        (F.size(p) == 0, "P-L1-001", "no_params", MODES, True),
        (numeric, "P-L1-002", "numeric_only", ["A", "B", "INFO"], True),
        (~F.col("permit_all") & F.col("filter_covered"), "P-L1-003", "filter_coverage", ["B"], True),
        (inner & F.col("internal_network"), "P-L1-004", "internal_network", ["A"], True),
        (F.col("path").rlike(r"/health|/actuator/"), "P-L1-005", "health_check", MODES, False),
        (F.col("path").rlike(r"/swagger|/v3/api-docs"), "P-L1-006", "api_doc", MODES, False),
        (unknown, "P-L1-007", "needs_human", [], True),
    ]
    make = lambda rule, reason, skipped, back: F.struct(
        F.lit(rule).alias("rule_id"), F.lit(reason).alias("reason"), _modes(*skipped).alias("modes_skipped"),
        _modes(*[m for m in MODES if m not in skipped]).alias("modes_kept"), F.lit(back).alias("reversible"))
    decision = F
    for condition, *action in rules:
        decision = decision.when(condition, make(*action))
    none = F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("reason"),
                    _modes().alias("modes_skipped"), _modes(*MODES).alias("modes_kept"), F.lit(None).cast("boolean").alias("reversible"))
    return endpoints.withColumn("d", decision.otherwise(none)).select("*", "d.*").drop("d")


def dispatch(endpoints: DataFrame) -> DataFrame:
    """One row per endpoint and mode to run, by priority, minus the pruned modes."""
    by_priority = (F.when(F.col("priority") == "P0", _modes(*MODES)).when(F.col("priority") == "P1", _modes("A", "B"))
                   .when(F.col("priority") == "P2", _modes("A")).otherwise(_modes()))
    modes = F.array_except(by_priority, F.coalesce("modes_skipped", _modes()))
    return endpoints.select("endpoint_fqn", "priority", F.explode(modes).alias("mode"))


def bucket(endpoints: DataFrame) -> DataFrame:
    """Work order: P0, P1, P2, then what all modes skip."""
    pruned = F.size("modes_skipped") == len(MODES)
    label = F.when(pruned, "pruned").otherwise(F.col("priority"))
    rank = F.when(pruned, 9).otherwise(F.regexp_extract("priority", r"(\d+)", 1).cast("int"))
    return endpoints.withColumn("bucket", label).withColumn("bucket_rank", rank)


def force_rescan(requests: DataFrame, group: str, commit: str) -> DataFrame:
    """Rescan requests: only C and D may be asked for; anything else is an error row."""
    wrong = F.array_except("modes", _modes("C", "D"))
    ok = (F.size("modes") > 0) & (F.size(wrong) == 0)
    chain = short_hash(F.col("endpoint_fqn"))
    key = kv_key(F.lit(group), F.lit(commit), F.lit("force-rescan"), chain, F.lit(""))
    return requests.select(
        "*", F.when(ok, "queued").otherwise("error").alias("status"), F.when(ok, key).alias("key"),
        F.when(~ok, F.concat(F.lit("modes not allowed: "), F.array_join(wrong, ","))).alias("error"))


def l3_route(chains: DataFrame, findings: DataFrame) -> DataFrame:
    """Across rounds: a final finding skips the chain, a draft continues it, none starts anew."""
    state = findings.groupBy("chain_id").agg(
        F.bool_or(F.col("status") == "final").alias("f"), F.bool_or(F.col("status") == "draft").alias("dr"))
    route = F.when(F.col("f"), "skip").when(F.col("dr"), "continue").otherwise("new")
    return chains.join(state, "chain_id", "left").withColumn("route", route).drop("f", "dr")


def pending_chains(chains: DataFrame, findings: DataFrame) -> DataFrame:
    return chains.join(findings.filter("status = 'final'").select("chain_id"), "chain_id", "left_anti")


def list_pruned(log: DataFrame) -> DataFrame:
    """Counts by level and rule with totals of each level and of all."""
    return log.rollup("level", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")).select(
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "level").otherwise("rule").alias("scope"), "level", "rule_id", "n")


def rule_stats(log: DataFrame, truth: DataFrame, sample: int = PRUNE_SAMPLE) -> DataFrame:
    """Hits, hit share and false kills of the latest ``sample`` prunings per rule, and what to do with the rule.

    ``log(rule_id, target_id, ts)``; ``truth(target_id, vulnerable)``.  The latest rows are cut per
    task before the shuffle, so a rule with most of the log costs no more than any other.
    """
    hits = log.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    total = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    recent = Window.partitionBy("rule_id").orderBy(F.desc("ts"), "target_id")
    last = log.withColumn("r", F.row_number().over(recent)).filter(F.col("r") <= sample)
    killed = last.join(truth, "target_id", "left").groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(F.coalesce("vulnerable", F.lit(False))).alias("false_kills"))
    share = F.col("hits") / total
    rate = F.col("false_kills") / F.col("sampled")
    action = F.when(rate > FALSE_KILL_LIMIT, "disabled").when(share < LOW_VALUE_SHARE, "low_value").otherwise("active")
    return hits.join(killed, "rule_id").select("rule_id", "hits", F.round(share, 6).alias("hit_share"), "sampled", "false_kills",
                                               F.round(rate, 6).alias("false_kill_rate"), action.alias("action"))


def filter_coverage(endpoints: DataFrame, filters: DataFrame) -> DataFrame:
    """Number of URL filters (``/api/**`` patterns) over each endpoint.

    A pattern is filed under what a path must have to fit: its fixed folder; with a wildcard at the root a whole segment
    without wildcards, else the ending of its last one, else the character that a segment begins with.  Paths
    offer all of these, so candidates come from an equi join and only they are tested against the pattern.
    Patterns of wildcards alone meet all paths, by salted keys.
    """
    salts = 64
    parts = F.split("path", "/")
    key = lambda kind, value: F.concat(F.lit(f"{kind}:"), value)
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: key("f", F.array_join(F.slice(parts, 1, n), "/")))
    named = F.filter(parts, lambda s: s != "")
    ending = key("e", F.regexp_extract("path", r"\.[^./]*$", 0))
    salt = key("a", F.pmod(F.xxhash64("endpoint_id", "path"), F.lit(salts)).cast("string"))
    offers = F.concat(ups, F.transform(named, lambda s: key("s", s)), F.transform(named, lambda s: key("b", F.left(s, F.lit(1)))), F.array(ending, salt))
    offered = endpoints.select("endpoint_id", "path", F.explode(F.array_distinct(offers)).alias("key"))

    regex = F.regexp_replace("pattern", r"([.+()\[\]{}^$|\\])", r"\\$1")
    # "/**" at the end and "**/" stand for no folder as well
    for token, mark in ((r"/\*\*$", "\u0001"), (r"\*\*/", "\u0003"), (r"\*\*", "\u0002")):
        regex = F.regexp_replace(regex, token, mark)
    regex = F.regexp_replace(F.regexp_replace(regex, r"\*", "[^/]*"), r"\?", "[^/]")
    for mark, meaning in (("\u0001", "(?:/.*)?"), ("\u0003", "(?:.*/)?"), ("\u0002", ".*")):
        regex = F.regexp_replace(regex, mark, meaning)
    found = lambda p, i: F.nullif(F.regexp_extract("pattern", p, i), F.lit(""))
    whole = F.array_max(F.transform(F.filter(F.split("pattern", "/"), lambda s: (s != "") & ~s.rlike("[*?]")), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    options = [found(r"^([^*?]*)/", 1), whole, found(r"(\.[^*?./]+)$", 1), found(r"(?:^|/)([^*?/])", 1)]
    every = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda n: key("a", n.cast("string")))
    place = every
    for kind, value in reversed(list(zip("fseb", options, strict=True))):
        place = F.when(value.isNotNull(), F.array(key(kind, value))).otherwise(place)
    rules = filters.select(F.concat(F.lit("^"), regex, F.lit("$")).alias("regex"), F.explode(place).alias("key")).distinct()
    hits = offered.join(rules, "key").filter(F.rlike("path", F.col("regex"))).groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("n"))
    return endpoints.join(hits, "endpoint_id", "left").withColumn("n_filters", F.coalesce("n", F.lit(0))).drop("n").withColumn(
        "covered", F.col("n_filters") > 0)


def applicable_types(types: DataFrame, preset: DataFrame) -> DataFrame:
    """Vulnerability types that the preset lists for its primary framework."""
    listed = preset.select(F.explode(F.try_element_at("tech_stack_vuln_whitelist", F.col("framework.primary"))).alias("vuln_type"))
    return types.join(listed, "vuln_type", "left_semi")
