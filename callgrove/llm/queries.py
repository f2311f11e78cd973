"""Registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.llm import (
    decontaminate,
    language_id,
    license_scan,
    minhash_dedup,
    mixture,
    neighbours,
    periodic_runs,
    secret_scan,
    sentence_pieces,
    token_counts,
    turn_repair,
    url_filter,
    warc,
)
from callgrove.llm.oracles import SQL
from callgrove.workload.registry import Registry

R = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@R.query("op1_mix_sources", SQL.get("op1_mix_sources"))
def op1_mix_sources(spark, sf_dir):
    docs = mixture.with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return mixture.mix_sources(docs).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken_tokens")


@R.query("op2_url_filter", SQL.get("op2_url_filter"))
def op2_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@R.query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


@R.query("op4_warc_archive", SQL.get("op4_warc_archive"))
def op4_warc_archive(spark, sf_dir):
    path = warc.archive_path(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


@R.query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.read_vocabulary())


@R.query("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@R.query("op7_language_id")
def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prototypes = language_id.learn(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    found = language_id.identify(docs, prototypes)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@R.query("op8_nearest_neighbours", SQL.get("op8_nearest_neighbours"))
def op8_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@R.query("op9_decontaminate")
def op9_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@R.query("op10_near_duplicates", SQL.get("op10_near_duplicates"))
def op10_near_duplicates(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def echoed(docs: DataFrame) -> DataFrame:
    """Documents whose id has a checksum that ends in 0 repeat their words from one place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.withColumn("__words", words).withColumn("__n", F.size("__words")).withColumn("__g", F.floor(h / 10))
    rows = rows.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    rows = rows.withColumn("__p", F.expr("CAST(1 + (__n - __a) DIV (3 + __g % 8) AS INT)"))
    again = "flatten(array_repeat(slice(__words, __a + 1, __p), CAST(ceil((__n - __a) / __p) AS INT)))"
    text = F.expr(f"array_join(concat(slice(__words, 1, __a), slice({again}, 1, __n - __a)), ' ')")
    return rows.withColumn("text", F.when(F.col("__n") > 0, text).otherwise(F.col("text"))).select(*docs.columns)


@R.query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    docs = periodic_runs.with_runs(echoed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    out = periodic_runs.collapse(docs, ["doc_id", "runs"])
    best = periodic_runs.longest("runs")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations of which some rows are lost, emptied, cut off, repeated or given the wrong role, by a checksum of id and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    kept = rows.select("conv_id", "turn", F.when(way == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), way.alias("__way")).where("__way <> 0")
    return kept.withColumn("__copy", F.explode(F.when(F.col("__way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__way", "__copy")


@R.query("op12_turn_repair")
def op12_turn_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = turn_repair.summarize(turn_repair.repair_conversations(damaged(rows)))
    ids = rows.select("conv_id").distinct()
    none = {"audit": F.lit(""), "sha256": F.sha2(F.lit("").cast("binary"), 256)}
    value = lambda c: F.coalesce(c, none.get(c, F.lit(0).cast("bigint")))
    return ids.join(found, ids.conv_id.eqNullSafe(found.conv), "left").select(
        "conv_id", *[value(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], value("sha256").alias("repaired_sha256"))


@R.query("op13_sentence_pieces")
def op13_sentence_pieces(spark, sf_dir):
    model = sentence_pieces.read_model()
    out = sentence_pieces.decode(sentence_pieces.encode(table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
