"""Content-addressed web archive: payloads stored once, record headers kept exactly, records rebuilt by joins.

The archive is two tables below one folder.  ``payloads`` holds each distinct payload once under its
SHA-256; ``headers`` holds one exact WARC/1.1 header block per record with the digest it belongs to.  Copies
are recognised by that digest; while the payloads are gathered, each row's bytes are represented by it only.
When the archive is read, the stored bytes are digested again and measured: a payload that does not give its own
name, or a record whose header states another length or digest than its rebuilt body has, is an error, not a wrong
record.

Records of a payload of at least ``least`` bytes are revisits of the one with the largest id; smaller ones
are all responses.

Defined results: a null payload is an empty one; a null url gives an empty target; rows repeated with the
largest id are responses each; rows with a null id refer to the largest id if there is one and are
responses otherwise; payloads of any length are kept whole; an empty table gives an empty archive.  Only
the named columns are read, so further columns never clash.
"""

from __future__ import annotations

from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.plans.scratch import scratch_root

CRLF = "\r\n"


def record_id(key: Column, url: Column, digest: Column, nth: Column) -> Column:
    """A URN made from the row and the number of its copy, so that no two records share one and every run gives the same."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (key, digest, nth, url)]
    h = F.md5(F.concat(F.lit("record:"), F.concat_ws(":", *parts)).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def write_archive(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, date: str | None = None) -> None:
    """Write a record for each row of ``df`` below ``path``; ``date`` (UTC, by default now) is the WARC-Date of all."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
                     body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    stored = rows.groupBy("digest").agg(F.any_value("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")

    spark = df.sparkSession
    slim = rows.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes"))
    slim.write.option("compression", "zstd").parquet(f"{path}/rows")
    slim = spark.read.schema(slim.schema).parquet(f"{path}/rows")
    copies = slim.where(F.col("bytes") >= least).groupBy("digest").agg(F.max(F.struct("id", "url")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies.select("digest", F.col("top.id").alias("first"), F.col("top.url").alias("first_url")).write.parquet(f"{path}/copies")
    copies = spark.read.schema("digest string, first bigint, first_url string").parquet(f"{path}/copies")
    counted = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n"))  # equal rows are told apart by number
    slim = counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).join(copies, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    block = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id(F.col("id"), F.col("url"), F.col("digest"), F.col("nth"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", record_id(F.col("first"), F.col("first_url"), F.col("digest"), F.lit(1))))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))), F.lit(CRLF))
    refers = F.when(revisit, record_id(F.col("first"), F.col("first_url"), F.col("digest"), F.lit(1)))
    headers = slim.select("id", F.encode(block, "UTF-8").alias("header"), "digest", F.when(revisit, F.col("first")).alias("first"), refers.alias("refers"))
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """id, record_id, record_type, payload_digest, target, date, content_length and refers_to as the header blocks state them, and the content address."""
    rows = spark.read.schema("id bigint, header binary, digest string, first bigint, refers string").parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\n{name}: ?([^\r\n]*)\r", 1)
    return rows.select("id", "header", "digest", field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"),
                       F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), field("WARC-Target-URI").alias("target"),
                       field("WARC-Date").alias("date"), field("Content-Length").cast("bigint").alias("content_length"),
                       F.when(field("WARC-Refers-To") == F.col("refers"), F.col("first")).alias("refers_to"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest, payload, its length and SHA-1, computed from the stored bytes; raises where bytes and address differ."""
    rows = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(sound, F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
    return rows.select("digest", "payload", F.octet_length("payload").cast("bigint").alias("bytes"), checked.alias("sha1"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its full payload: the header's fields, ``bytes``, ``sha1`` and ``payload``; raises where header and body differ.

    What is not asked for does not travel: without ``payload`` only lengths and digests are joined, which tell what the
    rebuilt body is without moving it.
    """
    rows = read_headers(spark, path).join(read_payloads(spark, path), "digest")
    body = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("bytes"))
    sound = (F.col("content_length") == body) & (F.col("payload_digest") == F.col("sha1")) & ((F.col("record_type") == "response") | F.col("refers_to").isNotNull())
    return rows.withColumn("record_type", F.when(sound, F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id"))))


def rebuild(records: DataFrame) -> DataFrame:
    """The original record bytes: header, payload (none in a revisit) and the closing line ends."""
    body = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return records.select("id", F.concat("header", body, F.lit(CRLF * 2).cast("binary")).alias("record"))


def archive_path(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{scratch_root(spark)}/warc-{uuid4().hex}"
