"""JSONL logs, chats, sessions and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrove.plans.scratch import materialize
from callgrove.schemas import schema


def read_jsonl(spark: SparkSession, path: str, shape: T.StructType, line_numbers: bool = False, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good and malformed lines of JSONL files; blank lines are skipped.  ``closed`` adds the keys that ``shape`` lacks as unknown_keys.

    Logs are read line by line in splittable blocks, and a warning names the file and shows the line.
    ``line_numbers=True`` also numbers the lines, at the price of reading the files twice.
    """
    if line_numbers:
        lines = numbered_lines(spark, path)
    else:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("int").alias("line_no"), F.col("value").alias("line"))
    return _parse_lines(lines.filter(F.trim("line") != ""), shape, closed)


#: Blocks of which the places are sent to all tasks: at most some 50 MB.
MOST_BLOCKS = 200_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and line of text files of any size.

    The lines of each block are counted first; a line's number is the lines of earlier blocks of its file plus its place
    in its own.  Both passes see the same blocks, and within a task lines come in the order of the block, so neither a
    file nor a block is gathered or sorted.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "\r$", "").alias("line"))
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")), "blocks")
    small = blocks.count() <= MOST_BLOCKS
    rows = raw.join(F.broadcast(blocks) if small else blocks, ["file", "block"])
    return rows.select("file", (F.col("at") + F.col("shift")).cast("int").alias("line_no"), "line")


def parse_jsonl(texts: DataFrame, shape: T.StructType) -> tuple[DataFrame, DataFrame]:
    lines = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).filter(F.trim("line") != "")
    return _parse_lines(lines.select("file", (F.col("n") + 1).alias("line_no"), "line"), shape)


def _parse_lines(lines: DataFrame, shape: T.StructType, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    wide = T.StructType([*shape.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    unknown = F.array_except(F.json_object_keys("line"), F.array(*map(F.lit, shape.names)))
    more = [unknown.alias("unknown_keys")] if closed else []
    good = parsed.filter(~bad).select("file", "line_no", *[F.col(f"r.{n}").alias(n) for n in shape.names], *more)
    where = F.when(F.col("line_no").isNotNull(), F.concat(F.lit(":"), F.col("line_no").cast("string"))).otherwise("")
    warn = F.concat(F.lit("malformed JSON at "), "file", where)
    return good, parsed.filter(bad).select("file", "line_no", "line", warn.alias("warning"))


def read_log(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Good records of a log by its schema, and the lines that are none."""
    good, bad = read_jsonl(spark, path, schema(name))
    return good.drop("file", "line_no"), bad


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add records as JSON lines; earlier files stay as they are and timestamps keep microseconds."""
    df.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def chat_fields(line):
    """Role and text of one chat record; content may be a string or a list of typed parts."""
    v = F.try_parse_json(line)
    text = lambda p: F.try_variant_get(v, p, "string")
    part = F.try_variant_get(v, "$.content", "array<struct<type:string,text:string>>")
    listed = F.coalesce(part, F.try_variant_get(v, "$.message", "array<struct<type:string,text:string>>"))
    first = F.get(F.filter(listed, lambda p: p["type"] == "text"), F.lit(0))["text"]
    plain = F.coalesce(text("$.content"), text("$.message"))
    return [F.coalesce(text("$.role"), text("$.type"), F.lit("unknown")).alias("role"),
            F.coalesce(first, F.when(~plain.startswith("["), plain), F.lit("")).alias("content"), v.isNotNull().alias("valid")]


def parse_chat(texts: DataFrame) -> DataFrame:
    lines = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    return lines.select("file", "line_no", *chat_fields(F.col("line"))).filter("valid").drop("valid")


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Chat transcripts, one file per conversation of any length; the line number (from 0) gives the order."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    return lines.select("file", (F.col("line_no") - 1).alias("line_no"), *chat_fields(F.col("line"))).filter("valid").drop("valid")


def typed_sessions(raw: DataFrame) -> DataFrame:
    return raw.withColumn("time_created", F.timestamp_millis("time_created"))


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Session and part tables with real timestamps; the part payload becomes a VARIANT."""
    s = typed_sessions(spark.read.schema(schema("sessions")).parquet(f"{path}/session"))
    p = typed_sessions(spark.read.schema(schema("parts")).parquet(f"{path}/part"))
    return s, p.withColumn("data", F.try_parse_json("data"))


def write_rounds(df: DataFrame, path: str) -> None:
    append_jsonl(df, path)
