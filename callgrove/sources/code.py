"""Source trees, build files and API descriptions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.constants import FRAMEWORKS
from callgrove.functions.java import body_content_type, operation_id
from callgrove.schemas import schema


def read_texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Whole files below ``path`` as ``file, text``."""
    return (spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))


def controllers(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("text").contains("@RestController") | F.col("text").contains("@Controller"))


def read_sources(spark: SparkSession, path: str, glob: str = "*.java") -> DataFrame:
    return controllers(read_texts(spark, path, glob))


def pom_fields(text):
    tag = lambda name: F.regexp_extract(text, rf"<{name}>\s*([^<]*?)\s*</{name}>", 1)
    return [tag("groupId").alias("group_id"), tag("artifactId").alias("artifact_id")]


def read_pom(spark: SparkSession, path: str, glob: str = "pom.xml") -> DataFrame:
    """First groupId and artifactId of each build file; fragments are fine."""
    return read_texts(spark, path, glob).select("file", *pom_fields(F.col("text")))


def read_preset(spark: SparkSession, path: str) -> DataFrame | None:
    """The preset document, or None when there is no such file."""
    try:
        return spark.read.option("multiLine", True).schema(schema("preset")).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _pair(kind: str, value):
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def detect_preset(sources: DataFrame) -> DataFrame:
    """Imports, packages and annotations of a source tree, counted; one row per (kind, value)."""
    imports = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)"), 1), lambda i: _pair("import", i))
    package = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^\s*package\s+([\w.]+)"), 1), lambda i: _pair("package", i))
    notes = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(r"@([A-Z]\w*)"), 1)), lambda i: _pair("annotation", i))
    known = F
    for prefix, label in FRAMEWORKS.items():
        known = known.when(F.col("value").startswith(prefix), label)
    rows = sources.select(F.inline(F.concat(imports, package, notes)))
    counts = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("framework", F.when(F.col("kind") == "import", known))


def preset_draft(sources: DataFrame, poms: DataFrame, types: DataFrame, most_annotations: int = 50) -> DataFrame:
    """A preset document to be confirmed by hand, one row: ids of the build files, main framework and package, candidates.

    ``types(framework, vuln_type)`` gives the whitelist.  Annotations are a ranked suggestion of ``most_annotations``.
    """
    counts = detect_preset(sources)
    main = counts.where("kind = 'package'").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("base_package"))
    by_framework = counts.where("framework IS NOT NULL").groupBy("framework").agg(F.sum("n").alias("n"))
    primary = by_framework.agg(F.min_by("framework", F.struct(-F.col("n"), "framework")).alias("primary"))
    notes = counts.where("kind = 'annotation'").orderBy(F.desc("n"), "value").limit(most_annotations)
    notes = notes.agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "value"))), lambda s: s["value"]).alias("annotations"))
    listed = types.groupBy("framework").agg(F.array_sort(F.collect_set("vuln_type")).alias("whitelist"))
    build = poms.agg(F.min("group_id").alias("group_id"), F.min("artifact_id").alias("artifact_id"))
    one = lambda df: F.struct(*[F.col(c) for c in df.columns])
    parts = [df.select(one(df).alias("v")).scalar() for df in (build, primary, main, notes)]
    doc = sources.sparkSession.range(1).select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).select("p0.*", "p1.*", "p2.*", "p3.*")
    return doc.join(listed, doc["primary"] == listed["framework"], "left").drop("framework")


def api_operations(endpoints: DataFrame) -> DataFrame:
    """Path, verb and the operation object as JSON text; the last mapping of a (path, verb) wins."""
    last = endpoints.groupBy("path", "http_method").agg(
        F.max_by(F.struct("file", "annotation", "params", "body"), F.struct("file", "seq", "args")).alias("e"))
    body = body_content_type(F.col("e.body"), F.col("http_method"), F.col("e.params"))
    codes = {"200": "successful operation", "401": "unauthorized", "403": "forbidden", "404": "not found", "500": "internal server error"}
    responses = F.create_map(*[x for c, t in codes.items() for x in (F.lit(c), F.struct(F.lit(t).alias("description")))])
    operation = F.struct(
        operation_id(F.col("e.file"), F.col("http_method")).alias("operationId"),
        F.concat("e.annotation", F.lit(" "), "path").alias("summary"),
        F.concat(F.lit("Source: "), "e.file").alias("description"),
        F.when(F.size("e.params") > 0, F.col("e.params")).alias("parameters"),
        F.when(body.isNotNull(), F.create_map(body, F.lit("object"))).alias("requestBody"),
        responses.alias("responses"))
    return last.select("path", "http_method", F.to_json(operation).alias("operation"))


def api_paths(endpoints: DataFrame) -> DataFrame:
    """Per path a map of verb to operation (a path has at most a handful of verbs)."""
    return api_operations(endpoints).groupBy("path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("http_method", "operation")))).alias("operations"))


def export_api_spec(endpoints: DataFrame, path: str) -> None:
    api_paths(endpoints).write.mode("overwrite").json(f"{path}/paths")
    endpoints.write.mode("overwrite").json(f"{path}/manifest")
