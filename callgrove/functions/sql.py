"""SQL functions of a session: inlined expressions, and a table function for endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callgrove.constants import HIGH_RISK_WORDS, JAVA_TYPES, SEVERITIES, SEVERITY_NAMES, SINK_NAMES
from callgrove.functions import java


def _case(arg: str, pairs, otherwise: str) -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {v!r}' for c, v in pairs)} ELSE {otherwise} END"


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions and return their names; Catalyst inlines each body."""
    ranks = [(s, i) for i, s in enumerate(SEVERITIES, 1)] + [(z, SEVERITIES.index(s) + 1) for z, s in SEVERITY_NAMES.items()]
    words = "|".join(HIGH_RISK_WORDS)
    bodies = {
        "sink_type(name STRING) RETURNS STRING": _case("name", [(f"name ILIKE '%{w}%'", t) for w, t in SINK_NAMES], "NULL"),
        "java_schema_type(name STRING) RETURNS STRING": _case("name", [(f"name = '{n}'", t) for n, (t, _) in JAVA_TYPES.items()], "'string'"),
        "path_risk(path STRING) RETURNS STRING":
            f"CASE WHEN lower(path) RLIKE '{words}' THEN 'HIGH' WHEN contains(lower(path), 'xss') THEN 'MEDIUM' ELSE 'LOW' END",
        "short_hash(text STRING) RETURNS STRING": "left(sha2(text, 256), 16)",
        "level_rank(level STRING) RETURNS INT": _case("level", [(f"level = '{n}'", r) for n, r in ranks], "NULL"),
        "bare_text(text STRING) RETURNS STRING": r"""regexp_replace(trim(text), '^["\']+|["\']+$', '')""",
        "join_path(prefix STRING, path STRING) RETURNS STRING": """
            CASE WHEN bare_text(prefix) = '' AND bare_text(path) = '' THEN '/'
              ELSE regexp_replace(CASE WHEN bare_text(path) = '' THEN bare_text(prefix) WHEN bare_text(prefix) = '' THEN bare_text(path)
                WHEN NOT startswith(bare_text(path), '/') AND NOT endswith(bare_text(prefix), '/') THEN concat(bare_text(prefix), '/', bare_text(path))
                ELSE concat(bare_text(prefix), bare_text(path)) END, '^(?!/)', '/') END""",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]


_MAPPED = r"'@(Post|Get|Put|Delete|Patch|Request)Mapping\\s*\\(((?:[^()\"]|\"[^\"]*\"|\\([^()]*\\))*)\\)'"
_PATHS = r"""'(?:^|[,\\s])(?:path|value)\\s*=\\s*(\\{[^=]*\\}|\"[^\"]*\")|^(\\{[^=]*\\}|\"[^\"]*\")'"""


def register_endpoint_function(spark: SparkSession) -> str:
    """Create the table function ``mapped_endpoints(text)``: a row per mapping annotation and path (kind, args, path)."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION mapped_endpoints(text STRING) RETURNS TABLE (kind STRING, args STRING, path STRING) RETURN
        SELECT kind, args, p.path FROM (
          SELECT m.kind, trim(m.args) AS args FROM (SELECT inline(zip_with(regexp_extract_all(text, {_MAPPED}, 1), regexp_extract_all(text, {_MAPPED}, 2),
            (k, a) -> struct(k AS kind, a AS args)))) AS m) q,
        LATERAL (SELECT explode(CASE WHEN args RLIKE {_PATHS} THEN regexp_extract_all(regexp_extract(args, {_PATHS}, 0), '\"([^\"]*)\"', 1) ELSE array('') END) AS path) AS p""")
    return "mapped_endpoints"


def _raw(pattern: str) -> str:
    """A pattern as a raw SQL text."""
    if "'" in pattern:
        raise ValueError("a raw text holds no single quote")
    return f"r'{pattern}'"


def register_extract_endpoints(spark: SparkSession) -> str:
    """Create ``extract_endpoints(text)``, a table function that gives the endpoints of a Java source for use in a LATERAL join:
    seq, http_method, path, annotation, args, params, body, has_input and risk, as ``java.extract_endpoints`` does.

    Its body is SQL over helper functions, which Catalyst inlines; nothing leaves the JVM.
    """
    register_functions(spark)
    args, texts = _raw(java._ARGS), java._TEXTS
    bound = _raw(rf"@(PathVariable|RequestParam|RequestHeader|RequestBody)\b(?:\s*\({java._IN_PARENS}\))?")
    formats = "CASE " + " ".join(f"WHEN p.type = '{n}' THEN '{f}'" for n, (_, f) in JAVA_TYPES.items() if f) + " END"

    def param(where: str, by: str) -> str:
        given = ", ".join(f"nullif(regexp_extract(p.args, {_raw(r)}, 1), '')" for r in (r'(?:^|[,\s])(?:value|name)\s*=\s*"([^"]*)"', r'^\s*"([^"]*)"'))
        required = "true" if where == "path" else f"NOT p.args RLIKE {_raw(r'required\s*=\s*false')}"
        kind = "CASE " + " ".join(f"WHEN p.type = '{n}' THEN '{t}'" for n, (t, _) in JAVA_TYPES.items()) + " ELSE 'string' END"
        return (f"transform(filter(parts, p -> p.by = '{by}'), p -> named_struct('name', coalesce({given}, p.var), 'in', '{where}', 'required', {required}, "
                f"'type', {kind}, 'format', CAST({formats} AS STRING)))")

    named, implied = param("path", "PathVariable"), _raw(r"\{(\w+)[^{}]*\}")
    helpers = {
        "mapping_paths(args STRING) RETURNS ARRAY<STRING>": f"""CASE WHEN contains(mapping_text(args), '"') THEN regexp_extract_all(mapping_text(args), {_raw('"([^"]*)"')}, 1) ELSE array('') END""",
        "declared_parameters(block STRING) RETURNS ARRAY<STRUCT<by: STRING, args: STRING, type: STRING, var: STRING>>": f"""
          transform(transform(regexp_extract_all(block, {_raw(java._ITEM)}, 0), p -> named_struct('part', p, 'plain',
            trim(regexp_replace(regexp_replace(p, {_raw(java._ANNOTATION)}, ' '), {_raw(java._FINAL)}, ' ')))),
            x -> named_struct('by', regexp_extract(x.part, {bound}, 1), 'args', regexp_extract(x.part, {bound}, 2),
              'type', regexp_extract(x.plain, {_raw(java._TYPE)}, 1), 'var', regexp_extract(x.plain, {_raw(java._NAME)}, 1)))""",
    }
    stated = ", ".join(f"nullif(regexp_extract(args, {_raw(rf'(?:^|[,\s]){n}\s*=\s*({texts})')}, 1), '')" for n in ("path", "value"))
    helpers = {"mapping_text(args STRING) RETURNS STRING": f"coalesce({stated}, regexp_extract(args, {_raw(rf'^(?:{texts})')}, 0))"} | helpers
    for head, body in helpers.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION extract_endpoints(text STRING) RETURNS TABLE (seq INT, http_method STRING, path STRING, annotation STRING, args STRING,
        params ARRAY<STRUCT<name: STRING, `in`: STRING, required: BOOLEAN, type: STRING, format: STRING>>, body STRING, has_input BOOLEAN, risk STRING) RETURN
      SELECT at + 1, CASE WHEN kind <> 'Request' THEN lower(kind) ELSE coalesce(nullif(lower(regexp_extract(args, {_raw(java._METHOD)}, 1)), ''), 'get') END,
        path, concat('@', kind, 'Mapping'), args,
        concat({named}, transform(array_except(regexp_extract_all(path, {implied}, 1), transform({named}, n -> n.name)),
          n -> named_struct('name', n, 'in', 'path', 'required', true, 'type', 'string', 'format', CAST(NULL AS STRING))), {param("query", "RequestParam")}, {param("header", "RequestHeader")}),
        get(filter(parts, p -> p.by = 'RequestBody'), 0).type, block RLIKE {_raw(java._INPUT)}, path_risk(path)
      FROM (SELECT at, kind, args, block, parts, join_path(prefix, raw) AS path FROM (
        SELECT at, prefix, kind, args, block, parts, explode(raws) AS raw FROM (
          SELECT at, prefix, kind, args, block, raws, declared_parameters(block) AS parts FROM (
            SELECT at, prefix, s.kind AS kind, s.args AS args, regexp_extract(s.rest, {_raw(java._DECLARATION)}, 1) AS block, mapping_paths(s.args) AS raws FROM (
              SELECT prefix, posexplode(segs) AS (at, s) FROM (
                SELECT segs, coalesce(get(mapping_paths(coalesce(get(filter(segs, s -> s.class_level), 0).args, '')), 0), '') AS prefix FROM (
                  SELECT transform(segs, s -> named_struct('kind', s.kind, 'args', s.args, 'rest', s.rest,
                    'class_level', regexp_extract(s.rest, {_raw(java._FIRST_CODE)}, 1) RLIKE {_raw(java._TYPE_WORD)})) AS segs FROM (
                    SELECT transform(slice(split(text, {_raw(f'(?={java.MAPPING})')}), 2, 1000000000), s -> named_struct('kind', regexp_extract(s, {args}, 1),
                      'args', trim(regexp_extract(s, {args}, 2)), 'rest', substr(s, length(regexp_extract(s, {args}, 0)) + 1))) AS segs)))) WHERE NOT s.class_level))))""")
    return "extract_endpoints"


def run_sql(spark: SparkSession, sql: str, args: dict, **tables: DataFrame) -> DataFrame:
    """User SQL with ``:name`` placeholders over the given tables."""
    return spark.sql(sql, args=args, **tables)
