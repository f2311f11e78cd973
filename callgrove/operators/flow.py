"""Parameter propagation, sanitizers along a chain, and the risk that follows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrove.constants import SANITIZERS
from callgrove.plans.chunked import running
from callgrove.plans.scratch import materialize_measured


def _any(text: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def sanitizers(text: Column, kind: Column, table: Mapping[str, Sequence[str]] = SANITIZERS) -> Column:
    """Whether ``text`` holds a sanitizer that is effective for the sink ``kind``."""
    hit = F.lit(False)
    for k, patterns in table.items():
        hit = hit | ((kind == k) & _any(text, patterns))
    return F.coalesce(hit, F.lit(False))


def trace_params(params: DataFrame, functions: DataFrame, sinks: Mapping[str, Sequence[str]],
                 cleaners: Mapping[str, Sequence[str]] = SANITIZERS) -> DataFrame:
    """Uses of each parameter in the functions of its chain, line by line, in chain order.

    A line gives a use for every kind of sink and of sanitizer it holds, or else one for a concatenation
    and one for a call.

    ``params(chain_id, param)``, ``functions(chain_id, depth, body)``.  A line is classified where it
    is read and lines without a use end there; the rest meet the parameters by an equi join on
    (chain, word), which spreads a chain that holds most of the code over its words.
    """
    lines = functions.select("chain_id", "depth", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    text = F.col("text")
    named = lambda use, kind: F.struct(F.lit(use).alias("use"), F.lit(kind).cast("string").alias("kind"))
    strong = [F.when(_any(text, p), named("sink_call", k)) for k, p in sinks.items()] + [F.when(_any(text, p), named("sanitizer", k)) for k, p in cleaners.items()]
    weak = [F.when(text.rlike(r'"\s*\+|\+\s*"'), named("concat", None)), F.when(text.rlike(r"\w\s*\("), named("function_call", None))]
    found = F.array_compact(F.array(*strong))
    used = lines.withColumn("__uses", F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(*weak))))
    used = used.select("chain_id", "depth", "line", "text", F.inline("__uses"))
    words = F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}_]+")))
    return (used.select("chain_id", words.alias("param"), "depth", "line", "use", "kind")
            .join(params.select("chain_id", "param").distinct(), ["chain_id", "param"], "left_semi"))


def evaluate_risk(uses: DataFrame) -> DataFrame:
    """Verdict per parameter: a sink is safe only when an effective sanitizer of its kind comes first.

    Comparing the first sink and first sanitizer of each kind needs two minima, not a sort.
    """
    at = F.struct("depth", "line")
    per_kind = uses.groupBy("chain_id", "param", "kind").agg(
        F.min(F.when(F.col("use") == "sink_call", at)).alias("sink"),
        F.min(F.when(F.col("use") == "sanitizer", at)).alias("clean"),
        F.count(F.lit(1)).alias("n"))
    exposed = F.col("sink").isNotNull() & (F.col("clean").isNull() | (F.col("sink") < F.col("clean")))
    out = per_kind.groupBy("chain_id", "param").agg(
        F.bool_or(exposed).alias("exposed"), F.bool_or(F.col("sink").isNotNull()).alias("reached"), F.sum("n").alias("n_uses"))
    risk = F.when(F.col("exposed"), "VULNERABLE").when(F.col("reached"), "SANITIZED").otherwise("NO_SINK")
    return out.select("chain_id", "param", "n_uses", risk.alias("risk"))


def l2_prune(chain: DataFrame, unsure: Sequence[str] = (r"(?i)\b(?:clean|escape|encode|filter)\w*\(",),
             table: Mapping[str, Sequence[str]] = SANITIZERS) -> DataFrame:
    """Decision per chain node; what lies behind the first pruned node of a chain is dropped.

    ``chain(chain_id, depth, sink_kind, body, ..)``.
    """
    effective = sanitizers(F.col("body"), F.col("sink_kind"), table)
    decision = F.when(effective, "pruned").when(_any(F.col("body"), unsure), "maybe_sanitized").otherwise("active")
    rows = chain.withColumn("decision", decision)
    first = rows.filter(F.col("decision") == "pruned").groupBy("chain_id").agg(F.min("depth").alias("cut"))
    kept = rows.join(first, "chain_id", "left").filter(F.col("cut").isNull() | (F.col("depth") <= F.col("cut")))
    return kept.drop("cut")


def node_prune(df: DataFrame, frameworks: Sequence[str]) -> DataFrame:
    """Tags nodes that cannot carry taint (framework code, accessors, constant arguments) in ``pruned_by``; all rows stay."""
    framework = _any(F.col("qualified_name"), [f"^{p.replace('.', chr(92) + '.')}" for p in frameworks])
    accessor = F.col("name").rlike(r"^(?:(?:get|set|is)[A-Z]\w*|equals|hashCode)$")
    reason = F.when(framework, "framework").when(accessor, "accessor").when(
        F.col("argument").isNull() | F.col("argument").isin("constant", "null", "unpropagated"), "argument")
    return df.withColumn("pruned_by", reason)


def sanitizer_state(chain: DataFrame, order: Sequence[str]) -> DataFrame:
    """Whether an effective sanitizer stands at or before each node of its chain."""
    rows = chain.withColumn("effective", sanitizers(F.col("body"), F.col("sink_kind")))
    out = running(rows, ["chain_id"], order, F.floor(F.col(order[0]) / 1000), F.col("effective").cast("int"), "seen", "max")
    return out.withColumn("clean", F.col("seen") == 1).drop("seen")


GRAM = 4
_GAP = "\x00"


def required_literal(pattern: Column) -> Column:
    """The longest text, lower-cased, that every match of a pattern holds; null where none of ``GRAM`` characters can be told.

    Everything that may be absent or stand for several characters becomes a gap: escapes, classes, groups with what they
    hold, characters that are optional, and those beyond ASCII, whose lower case depends on what stands beside them.
    """
    left = F.regexp_replace(pattern, r"\\[pP]\{[^}]*\}|\\.", _GAP)
    left = F.regexp_replace(left, r"\[[^\]]*\]", _GAP)
    for _ in range(4):
        left = F.regexp_replace(left, r"\([^()]*\)", _GAP)
    told = ~pattern.rlike(r"\\[QEux0c]|\(\?[a-zA-Z]*x|\[\^?\]|\[[^\]]*\[|&&") & ~left.rlike(r"[()|\[\]]")
    left = F.regexp_replace(left, r"[^\x00](?:[*?]|\{[^}]*\})[?+]?", _GAP)
    left = F.regexp_replace(left, r"([^\x00])\+[?+]?", f"$1{_GAP}")
    parts = F.split(F.regexp_replace(left, r"[*?+.^$]|\{[^}]*\}|[^\x20-\x7E]", _GAP), _GAP)
    longest = F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), F.lower(x).alias("x"))))
    return F.when(told & (longest["n"] >= GRAM), longest["x"])


def _grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), 1))


#: Rule tables that take less memory are sent to all tasks.
SMALL_RULES = 64 << 20


def match_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """User rules ``(kind, pattern, label)`` against rows of the same kind; one output row per hit.

    A rule is filed under one run of ``GRAM`` characters of a text that its matches must hold, the one that fewest
    rules hold.  Texts meet rules by an equi join of the runs in them, and only these candidates are tested by
    pattern.  The rule table is measured while it is written: a small one is broadcast and no text moves; for a large
    one runs travel with a digest of their text.  Rules without such a run meet all rows of their kind.
    """
    names = rules.columns
    rules = rules.groupBy(*names).agg(F.count(F.lit(1)).cast("string").alias("__n"))
    rules = rules.withColumn("__rule", F.struct(*names, "__n")).withColumn("__literal", required_literal(F.col("pattern")))
    filed = rules.where("__literal IS NOT NULL").select("__rule", F.explode(_grams(F.col("__literal"))).alias("__gram"))
    shared = filed.groupBy("__gram").agg(F.count(F.lit(1)).alias("__shared"))
    filed = filed.join(shared, "__gram").groupBy("__rule").agg(F.min_by("__gram", F.struct("__shared", "__gram")).alias("__gram")).select("__rule.*", "__gram")
    filed, size = materialize_measured(filed, "rules")
    grams = F.explode(_grams(F.lower("text"))).alias("__gram")
    if size < SMALL_RULES:
        named = df.select("*", grams).join(F.broadcast(filed), ["kind", "__gram"])
    else:
        keyed = df.withColumn("__key", F.md5(F.concat("kind", F.lit("\x00"), "text").cast("binary")))
        met = keyed.select("__key", "kind", grams).distinct().join(filed, ["kind", "__gram"]).drop("kind", "__gram")
        named = keyed.join(met, "__key")
    bare = df.join(rules.where("__literal IS NULL").drop("__rule", "__literal"), "kind")
    hits = named.select(*bare.columns).unionAll(bare).filter(F.rlike("text", F.col("pattern")))
    return hits.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("pattern", "__n")
