"""URL filters: stated rules, and a tree of path templates learned for each host.

Rules name a host and the beginning of a path; the longest that fits decides.  Other URLs are judged by
templates.  The paths of a host form a tree with a level for each segment (the last of ``levels`` holds what
follows).  At each level segments of digits become wildcards, the children of a node that are nearly all
different become one wildcard, and branches are merged with the largest one of the node that has mostly the
same kind of children, if both have enough URLs and their shares of children do not differ beyond what chance
allows (Hoeffding bound).  Verdicts take no part in that, so a template may hold URLs with a rule and
others.  A template is rejected when the smoothed share of blocked URLs among its URLs with a rule is high; it
carries that verdict to its URLs without one.  Templates without a ruled URL are allowed.

Counts are aggregated before each level, so a host with most of the URLs is a few rows per branch; what a node's
branches have in common is aggregated and joined, so no node is gathered in one task; only rejected templates
are joined back.

Defined results: a null URL and one without ``://`` have an empty host and path, and are judged like all
others; URLs of any length are read whole; rules of equal length are taken in name order; of branches
equally large the first by name leads; repeated rows are judged alike and each counts; an empty table gives
an empty table.  Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.plans.scratch import materialize

BLOCK, ALLOW = "block", "allow"
#: Rules as (host and path, verdict).
RULES = [("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPES = ("none", "digits", "page", "word", "mixed")


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        h, _, p = name.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    return (F.when(segment == "", "none").when(segment.rlike(r"^[0-9]+/?$"), "digits").when(segment.rlike(r"^[0-9]+\.[a-z]+$"), "page")
            .when(segment.rlike(r"^[A-Za-z_-]+/?$"), "word").otherwise("mixed"))


def _wild(segment: Column) -> Column:
    """Digits stand for any number."""
    return F.when(segment.rlike(r"^[0-9]+/?$"), "*").when(segment.rlike(r"^[0-9]+\.[a-z]+$"), "*.*").otherwise(segment)


def _level(counts: DataFrame, above: list[str], at: str, below: str, to: str, variety: float, many: int, few: int, risk: float) -> DataFrame:
    """Adds ``to``, the generalised segment, to counts keyed by ``above``, ``at`` and what is below; ``below`` is a shape."""
    features = [F.sum(F.when(F.col(below) == s, F.col("n")).otherwise(0)).alias(f"f_{s}") for s in SHAPES]
    branch = counts.groupBy(*above, at).agg(F.sum("n").alias("n"), *features)
    most = F.greatest(*[F.col(f"f_{s}") for s in SHAPES])
    branch = branch.withColumn("alike", F.coalesce(*[F.when(F.col(f"f_{s}") == most, s) for s in SHAPES]))
    branch = materialize(branch, "branches")
    node = branch.groupBy(*above).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
    stats = ["n", *[f"f_{s}" for s in SHAPES]]
    lead = branch.groupBy(*above, "alike").agg(F.min_by(F.struct(F.col(at).alias("name"), *stats), F.struct(-F.col("n"), F.col(at))).alias("lead"))
    branch = branch.join(node, above).join(lead, [*above, "alike"])
    bound = F.lit(math.sqrt(0.5 * math.log(2 / risk))) * (1 / F.sqrt("n") + 1 / F.sqrt("lead.n"))
    far = F.greatest(*[F.abs(F.col(s) / F.col("n") - F.col(f"lead.{s}") / F.col("lead.n")) for s in stats[1:]])
    name = (F.when((F.col("kinds") >= many) & (F.col("kinds") >= variety * F.col("all")), "*")
            .when((F.col("n") >= few) & (far < bound), F.col("lead.name")).otherwise(F.col(at)))
    return branch.select(*above, at, name.alias(to))


def judge_urls(df: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str]] = RULES, levels: int = 8,
               prior: float = 0.1, weight: float = 5.0, reject: float = 0.8, variety: float = 0.5, many: int = 16, few: int = 8, risk: float = 0.05) -> DataFrame:
    """host, path, rule, verdict, template and purity (both null where no rejected template holds the URL) for each row of ``df``.

    A template is rejected if (blocked + ``weight`` * ``prior``) / (URLs with a rule + ``weight``) reaches ``reject``.  A node's
    children are one wildcard if there are ``many`` and they are at least ``variety`` times its URLs; branches of less than
    ``few`` URLs stay alone.
    """
    host, path = split_url(url)
    rows = df.select(*keep, host.alias("host"), path.alias("path"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    parts = F.split("path", "/", levels + 1)
    rows = rows.withColumns({f"s{i}": _wild(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))) for i in range(1, levels + 1)})
    every = [f"s{i}" for i in range(1, levels + 1)]
    counts = rows.groupBy("host", *every).agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("ruled"), F.count_if(F.col("said") == BLOCK).alias("bad"))
    counts = materialize(counts.withColumns({f"k{i}": _shape(F.regexp_replace(f"s{i}", r"^\*", "0")) for i in range(2, levels + 1)}).withColumn(f"k{levels + 1}", F.lit("none")), "paths")
    deepest = counts.agg(F.max(F.coalesce(*[F.when(F.col(s) != "", i) for i, s in reversed(list(enumerate(every, 1)))], F.lit(0)))).first()[0] or 0
    above = ["host"]
    for i in range(1, deepest + 1):
        found = materialize(_level(counts, above, f"s{i}", f"k{i + 1}", f"t{i}", variety, many, few, risk), f"level{i}")
        counts = materialize(counts.join(found, [*above, f"s{i}"]), f"paths{i}")
        above = [*above, f"t{i}"]
    purity = (F.col("bad") + weight * prior) / (F.col("ruled") + weight)
    judged = counts.groupBy(*above).agg(F.sum("ruled").alias("ruled"), F.sum("bad").alias("bad")).withColumn("purity", purity).where(F.col("purity") >= reject)
    rejected = counts.select("host", *every[:deepest], *above[1:]).join(judged.select(*above, "purity"), above)
    template = F.rtrim(F.concat_ws("/", *above), F.lit("/"))
    rejected = materialize(rejected.select("host", *every[:deepest], template.alias("template"), "purity"), "rejected")
    rows = rows.join(rejected, ["host", *every[:deepest]], "left")
    verdict = F.coalesce("said", F.when(F.col("purity").isNotNull(), BLOCK).otherwise(ALLOW))
    return rows.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
