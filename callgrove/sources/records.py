"""Findings, reports, structural matches, runtime records and the cache snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callgrove.functions.keys import kv_key, kv_parse
from callgrove.functions.text import parse_report_name
from callgrove.schemas import schema
from callgrove.sources.logs import read_jsonl


def read_findings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good and malformed findings; unknown_keys names what the schema does not allow."""
    return read_jsonl(spark, path, schema("finding"), closed=True)


def write_findings(df: DataFrame, path: str, folders: bool = False, buckets: int = 64) -> None:
    """Promoted chains as JSON lines in at most ``buckets`` folders; ``folders=True`` makes a ``chain_id=..`` folder for each."""
    if folders:
        df.repartition("chain_id").write.mode("append").partitionBy("chain_id").json(path)
    else:
        df.withColumn("bucket", F.pmod(F.xxhash64("chain_id"), F.lit(buckets))).repartition("bucket").write.mode("append").partitionBy("bucket").json(path)


def read_reports(spark: SparkSession, high: str, low: str) -> DataFrame:
    """Markdown reports of both folders with their parsed names."""
    def load(path: str, folder: str) -> DataFrame:
        raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
        # the hidden file name is URL-encoded for non-ASCII names
        return raw.select(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("name"), F.lit(folder).alias("folder"), F.col("value").alias("text"))
    return named_reports(load(high, "high").unionByName(load(low, "low")))


def named_reports(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p", parse_report_name(F.col("name"))).select("name", "folder", "text", "p.*")


def flatten_runtime(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finding rows and evidence rows of runtime documents."""
    f = docs.select(F.explode_outer("findings").alias("f")).filter("f is not null").select("f.*")
    findings = f.withColumn("n_evidence", F.coalesce(F.size("evidence"), F.lit(0))).drop("evidence")
    evidence = f.select(F.col("id").alias("finding_id"), F.explode_outer("evidence").alias("e")).filter("e is not null").select("finding_id", "e.*")
    return findings, evidence


def read_runtime_findings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return flatten_runtime(spark.read.option("multiLine", True).schema(schema("runtime_finding")).json(path))


def match_fields() -> StructType:
    """The part of a match record that ``flatten_matches`` reads; files are cut to it by Spark, ``from_json`` of a whole record is not."""
    return StructType([f for f in schema("matches") if f.name in ("file", "ruleId", "range", "metaVariables")])


def flatten_matches(m: DataFrame) -> DataFrame:
    """One row per captured variable of each structural match; list captures keep their position.

    The i-th single and the i-th list variable of a match are laid side by side, then the captures of both are laid out.
    """
    single, multi = F.col("metaVariables.single"), F.col("metaVariables.multi")
    many = F.flatten(F.map_values(multi))  # null when a list is
    listed = F.when(F.size(many) > 0, multi)
    text, lists = "array<struct<text:string>>", "array<array<struct<text:string>>>"
    known = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    pairs = m.select("file", "ruleId", F.col("range.byteOffset.start").alias("start"), F.col("range.byteOffset.end").alias("end"),
                     (F.size(known(F.map_keys(single), "array<string>")) + F.size(known(many, text))).alias("total"),
                     F.inline_outer(F.arrays_zip(
                         known(F.map_keys(single), "array<string>").alias("one"), known(F.map_values(single), text).alias("value"),
                         known(F.map_keys(listed), "array<string>").alias("list"), known(F.map_values(listed), lists).alias("values"))))
    lone = F.col("one").isNotNull().cast("int")
    captures = F.concat(F.when(lone == 1, F.array("value")).otherwise(F.array().cast(text)), known(F.col("values"), text))
    return (pairs.select("file", "ruleId", "start", "end", "total", "one", "list", F.posexplode_outer(captures).alias("pos", "x"))
            .filter("pos IS NOT NULL OR total = 0")
            .select("file", "ruleId", "start", "end", F.when(F.col("pos") < lone, F.col("one")).otherwise(F.col("list")).alias("var"),
                    F.when(F.col("pos") < lone, 0).otherwise(F.col("pos") - lone).alias("at"), F.col("x.text").alias("captured")))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return flatten_matches(spark.read.schema(schema("matches")).json(path))


def read_kv(raw: DataFrame) -> DataFrame:
    """``(key, value, written_at)`` with the key decoded into columns."""
    return raw.withColumn("k", kv_parse(F.col("key"))).select("k.*", *raw.columns)


def encode_kv(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumn("key", kv_key(c("group_id"), c("commit_hash"), c("kind"), c("entity"), F.coalesce("sub", F.lit(""))))


def write_kv(rows: DataFrame, path: str) -> None:
    """Snapshot as parquet, one folder per kind, so a reader of one kind skips the others."""
    encode_kv(rows).write.mode("append").partitionBy("kind").parquet(path)
