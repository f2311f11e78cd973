"""Column expressions that judge, grade and classify records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrove.constants import ERROR_OUTPUTS, EXIT_CODES, NEVER_RETRY, SEVERITIES, SEVERITY_NAMES


def level_rank(level: Column) -> Column:
    """1 for the gravest level; both name systems are known."""
    names = [(s, i) for i, s in enumerate(SEVERITIES, 1)] + [(z, SEVERITIES.index(s) + 1) for z, s in SEVERITY_NAMES.items()]
    return F.try_element_at(F.create_map(*[F.lit(x) for p in names for x in p]), level)


def level_name(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SEVERITY_NAMES.items() for x in p]), level), level)


def judge_response(code: Column, has_evidence: Column) -> Column:
    """Only a success with evidence of impact passes; a missing page must be looked at again."""
    return (F.when((code >= 200) & (code < 300) & has_evidence, "PASS").when((code >= 200) & (code < 300), "FAIL")
            .when(code == 404, "RECHECK").otherwise("FAIL"))


def classify_output(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when((low == "") | low.rlike("|".join(f"(?:{p})" for p in ERROR_OUTPUTS)), "ARTHAS_ERROR").otherwise("OK")


def classify_result(http_code: Column, state: Column, output: Column, error_kind: Column | None = None) -> Column:
    """Outcome of one remote call from its HTTP code, job state and text.

    ``error_kind`` is what kept a call from an answer; ``timeout`` tells a slow one from a lost connection.
    """
    late = F.lit(False) if error_kind is None else F.coalesce(error_kind == "timeout", F.lit(False))
    return (F.when(http_code.isNull() & late, "TIMEOUT").when(http_code.isNull(), "CONNECTION_ERROR").when(http_code.isin(401, 403), "AUTH_FAILURE")
            .when(http_code == 404, "AGENT_OFFLINE").when(http_code >= 500, "CONNECTION_ERROR")
            .when(state == "SUCCEEDED", classify_output(output)).when(state.isin("SCHEDULED", "PROCESSING"), "TIMEOUT")
            .otherwise("ARTHAS_ERROR"))


def exit_code(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in EXIT_CODES.items() for x in p]), status)


def is_retryable(command: Column) -> Column:
    low, hit = F.lower(F.trim(command)), F.lit(False)
    for prefix in NEVER_RETRY:
        hit = hit | low.startswith(prefix)
    return ~hit


def extract_output(results: Column) -> Column:
    """Text of a JSON result list: per entry the field its type calls for, status entries left out."""
    entries = F.from_json(results, "array<string>")
    get = lambda e, name: F.get_json_object(e, f"$.{name}")
    text = lambda e: (F.when(get(e, "type") == "version", F.coalesce(get(e, "version"), F.lit("")))
                      .when(get(e, "type") == "jad", F.coalesce(get(e, "source"), F.lit("")))
                      .when(get(e, "source").isNotNull(), get(e, "source")).when(get(e, "command").isNotNull(), get(e, "command"))
                      .when(get(e, "type") == "row_affect", F.concat(F.lit("rowCount: "), F.coalesce(get(e, "rowCount"), F.lit("0"))))
                      .when(get(e, "message").isNotNull(), get(e, "message")).otherwise(e))
    shown = F.filter(entries, lambda e: F.coalesce(get(e, "type"), F.lit("")) != "status")
    return F.array_join(F.transform(shown, text), "\n")


def parse_verdict(answer: Column) -> Column:
    """Letter and note of a two-line answer, with code fences and markdown noise removed."""
    bare = F.regexp_replace(answer, r"```\w*", "")
    letter = F.lower(F.regexp_extract(bare, r"(?mi)^[\s*#>-]*([yno])[\s*.:]*$", 1))
    note = F.trim(F.regexp_extract(bare, r"(?mi)^[\s*#>-]*[yno][\s*.:]*\n+\s*(.+)$", 1))
    return F.struct(F.nullif(letter, F.lit("")).alias("verdict"), F.nullif(note, F.lit("")).alias("note"))


def parse_verdict_array(answer: Column) -> Column:
    """The JSON array of ``{key, verdict, reason}`` inside a fenced answer; null when there is none."""
    body = F.regexp_extract(F.regexp_replace(answer, r"```\w*", ""), r"(?s)(\[.*\])", 1)
    return F.from_json(F.nullif(body, F.lit("")), "array<struct<key:string,verdict:string,reason:string>>")


def strip_frames(stack: Column) -> Column:
    return F.filter(stack, lambda f: ~f.rlike(r"^(?:java\.lang\.reflect|sun\.reflect|jdk\.internal\.reflect)"))


def confidence(n_evidence: Column, has_stack: Column, verified: Column) -> Column:
    return F.when((n_evidence > 1) & has_stack & verified, "HIGH").when(n_evidence >= 2, "MEDIUM").otherwise("LOW")


def owasp(category: Column) -> Column:
    return category.rlike(r"^A(?:0[1-9]|10):2021\b|^Custom-\S")


# --- fixed values: severity conditions by mode, gravest first -------------------------------
GRADES = {
    "A": ["unauthenticated_sink", "login_sink", "conditional_sink", "hard_sink", "sanitized"],
    "B": ["admin_or_escalation", "no_auth_or_bypass", "conditional_bypass", "weak_auth", "improvable"],
    "C": ["critical_data", "personal_data", "semi_sensitive", "metadata", "partial_check"],
    "D": ["repeatable_or_free", "limited_bypass", "state_specific", "incomplete_check", "improvable"],
    "INFO": ["plain_secret", "hash_or_token", "stack_or_config", "debug_info", "improvable"],
}


def grade(mode: Column, condition: Column) -> Column:
    """Severity of a finding from its mode and the gravest condition that holds."""
    table = F.create_map(*[F.lit(x) for m, conds in GRADES.items() for c, s in zip(conds, SEVERITIES) for x in (f"{m}:{c}", s)])
    return F.try_element_at(table, F.concat(mode, F.lit(":"), condition))
