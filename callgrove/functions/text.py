"""Column expressions over report and log texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrove.constants import IMPACT_PATTERNS, LEAK_PATTERNS, REDACTIONS

_LEVELS = "致命|严重|高危|中危|低危|无|CRITICAL|HIGH|MEDIUM|LOW|INFO"
_STATES = "是问题|非问题|暂时无法确认|failed"
REPORT_NAME = rf"^(?:({_STATES})_)?({_LEVELS})_(?:(\d+(?:\.\d+)?)_([^_]+)_)?(.+)_([A-Za-z0-9$-]+)_([0-9a-f]{{6,64}})\.md$"


def parse_report_name(name: Column) -> Column:
    """State, level, score, type, class, method and hash of a report file name; null when it does not parse."""
    part = lambda i: F.nullif(F.regexp_extract(name, REPORT_NAME, i), F.lit(""))
    fields = F.struct(part(1).alias("state"), part(2).alias("level"), part(3).cast("double").alias("score"), part(4).alias("vuln_type"),
                      F.replace(part(5), F.lit("__"), F.lit(".")).alias("class"), part(6).alias("method"), part(7).alias("sig"))
    return F.when(name.rlike(REPORT_NAME), fields)


def report_name(level: Column, cls: Column, method: Column, sig: Column) -> Column:
    return F.concat(level, F.lit("_"), F.replace(cls, F.lit("."), F.lit("__")), F.lit("_"), method, F.lit("_"), sig, F.lit(".md"))


def md_field(text: Column, key: str) -> Column:
    """Value of a ``**key**: value`` line; the colon may be full-width."""
    found = F.regexp_extract(text, rf"(?m)\*\*{key}\*\*[:：][ \t]*(.+?)[ \t]*$", 1)
    return F.nullif(found, F.lit(""))


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def pattern_hits(text: Column, patterns: Mapping[str, list[str]]) -> dict[str, Column]:
    """Number of matches per class; most texts match nothing and pay for one scan per class only."""
    out = {}
    for label, regexes in patterns.items():
        total = F.lit(0)
        for r in regexes:
            total = total + F.regexp_count(text, F.lit(r))
        out[label] = F.when(text.rlike(any_of(regexes)), total).otherwise(F.lit(0))
    return out


def impact_evidence(text: Column) -> Column:
    """Matches and first example per impact class, and how many classes have none."""
    hits = F.array(F.struct(*[h.alias(k) for k, h in pattern_hits(text, IMPACT_PATTERNS).items()]))
    first = lambda label: F.coalesce(*[F.nullif(F.regexp_extract(text, f"({r})", 1), F.lit("")) for r in IMPACT_PATTERNS[label]])

    def told(h: Column) -> Column:  # the counts are bound here, so they are made once however often they are used
        empty = sum((F.when(h[k] > 0, 0).otherwise(1) for k in IMPACT_PATTERNS), F.lit(0))
        return F.struct(*[h[k].alias(f"n_{k}") for k in IMPACT_PATTERNS], *[F.when(h[k] > 0, first(k)).alias(f"eg_{k}") for k in IMPACT_PATTERNS], empty.alias("n_empty"))

    return F.get(F.transform(hits, told), F.lit(0))


def leaks(text: Column) -> Column:
    """Names of the leak kinds found in ``text``."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), k) for k, p in LEAK_PATTERNS.items()]))


def redact(text: Column) -> Column:
    """Text with sensitive values replaced, the number of replacements, and their kinds."""
    out, count, kinds = text, F.lit(0), []
    for kind, pattern in REDACTIONS.items():
        n = F.regexp_count(out, F.lit(pattern))
        count, kinds = count + n, [*kinds, F.when(n > 0, kind)]
        out = F.regexp_replace(out, pattern, "[REDACTED]")
    return F.struct(out.alias("text"), count.alias("redaction_count"), F.array_compact(F.array(*kinds)).alias("redaction_types"))


def excerpt(text: Column, length: int = 500) -> Column:
    """What a record shows of an output: its head, the hash of all of it, and whether it must go to a file."""
    return F.struct(F.left(text, F.lit(length)).alias("output_excerpt"), F.sha2(text, 256).alias("output_sha256"),
                    (F.length(text) > length).alias("external"))


def parse_evidence(text: Column) -> Column:
    pattern = r"([\w$./-]+\.\w+):(\d+)(?:\s*\((.*)\))?"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).alias("note"))
