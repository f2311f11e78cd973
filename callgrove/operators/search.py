"""Ranked text search over symbols or documents."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.plans.scratch import materialize

SPLIT = r"[^\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def _occurrences(term: str) -> Column:
    """How often a term stands in the lower-cased text as a whole token."""
    found = F.regexp_count("__low", F.lit(rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"))
    return F.when(F.contains("__low", F.lit(term)), found).otherwise(0)


def search(df: DataFrame, query: str, columns: Sequence[str], key: str, k: int | None = 10, match: str = "all",
           kinds: Sequence[str] | None = None) -> DataFrame:
    """BM25 over the joined ``columns``, best first.

    Term counts are computed per row inside the scan and the corpus statistics are scalar
    subqueries over the same columns, so no token is ever shuffled.  ``kinds`` limits the hits, not the
    statistics.
    """
    terms = list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))
    if not terms:
        raise ValueError("the query holds no term")
    rows = df.withColumn("__low", F.lower(F.concat_ws(" ", *columns)))
    counts = {"__len": F.regexp_count("__low", F.lit(r"[\p{L}\p{N}]+"))} | {f"__tf{i}": _occurrences(t) for i, t in enumerate(terms)}
    counted = rows.withColumns(counts).drop("__low")
    stats = counted.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.avg("__len").alias("avg"),
        *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).alias("s")).scalar()
    hits = [F.col(f"__tf{i}") > 0 for i in range(len(terms))]
    keep = hits[0]
    for h in hits[1:]:
        keep = (keep & h) if match == "all" else (keep | h)
    if kinds:
        keep = keep & F.col("kind").isin(*kinds)
    found = counted.filter(keep).withColumn("__s", stats)
    score = F.lit(0.0)
    for i in range(len(terms)):
        n, d, tf = F.col("__s.n"), F.col(f"__s.df{i}"), F.col(f"__tf{i}").cast("double")
        idf = F.greatest(F.log((n - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__s.avg")))
    out = found.withColumn("score", F.round(score, 6)).drop("__s", "__len", *[f"__tf{i}" for i in range(len(terms))])
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def explore(df: DataFrame, query: str, columns: Sequence[str], key: str, file: str, max_files: int = 12) -> DataFrame:
    """All hits of the best ``max_files`` files, a row for each: file, its best score and number of hits, key and score.

    Files are ranked by counts and maxima, so no file is gathered.
    """
    hits = search(df, query, columns, key, None, match="any").select(F.col(file).alias("file"), F.col(key).alias("key"), "score")
    return _best_files(hits, max_files)


def _best_files(hits: DataFrame, max_files: int) -> DataFrame:
    hits = materialize(hits, "hits")
    best = hits.groupBy("file").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n_symbols")).orderBy(F.desc("best"), "file").limit(max_files)
    return hits.join(best, "file").select("file", "best", "n_symbols", "key", "score")


@dataclass(frozen=True)
class Index:
    """A written index in segments: postings by term bucket, document lengths, and statistics; later segments replace documents of earlier ones."""
    spark: SparkSession
    path: str
    key: str
    key_type: str
    buckets: int

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """(segment, term, key, tf) of the terms; only their buckets are read."""
        wanted = sorted({self.spark.range(1).select(_bucket(F.lit(t), self.buckets)).first()[0] for t in terms})
        rows = self.spark.read.schema(f"term string, key {self.key_type}, tf int, segment int, bucket int").parquet(f"{self.path}/postings")
        return rows.where(F.col("bucket").isin(wanted) & F.col("term").isin(*terms)).select("segment", "term", "key", "tf")

    def lengths(self) -> DataFrame:
        """(segment, key, len, file) of the documents that no later segment removed."""
        rows = self.spark.read.schema(f"key {self.key_type}, len int, file string, segment int").parquet(f"{self.path}/lengths")
        gone = self.spark.read.schema(f"key {self.key_type}, segment int").parquet(f"{self.path}/removed")
        gone = gone.groupBy("key").agg(F.max("segment").alias("until"))
        return rows.join(gone, "key", "left").where("until IS NULL OR segment >= until").drop("until")

    def statistics(self) -> DataFrame:
        return self.spark.read.schema("n bigint, total bigint, segment int").parquet(f"{self.path}/statistics")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(df: DataFrame, columns: Sequence[str], key: str, path: str, buckets: int = 64, file: str | None = None) -> Index:
    """Write the index of ``columns`` below ``path``; terms are counted inside each text before anything is shuffled."""
    index = Index(df.sparkSession, path, key, df.schema[key].dataType.simpleString(), buckets)
    df.select(F.col(key).alias("key")).limit(0).write.parquet(f"{path}/removed/segment=0")
    _write_segment(index, df, columns, file, 0)
    index.spark.read.parquet(f"{path}/lengths/segment=0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).write.parquet(f"{path}/statistics/segment=0")
    return index


def _write_segment(index: Index, df: DataFrame, columns: Sequence[str], file: str | None, segment: int) -> None:
    rows = df.select(F.col(index.key).alias("key"), tokens(F.concat_ws(" ", *columns)).alias("toks"), (F.col(file).cast("string") if file else F.lit(None).cast("string")).alias("file"))
    rows.select("key", F.size("toks").alias("len"), "file").write.parquet(f"{index.path}/lengths/segment={segment}")
    counted = rows.select("key", F.explode("toks").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    counted = counted.withColumn("bucket", _bucket(F.col("term"), index.buckets))
    salted = counted.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8)))  # a bucket with a frequent term is several files
    salted.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{index.path}/postings/segment={segment}")


def update_index(index: Index, df: DataFrame, columns: Sequence[str], gone: DataFrame | None = None, file: str | None = None) -> Index:
    """Add the documents of ``df`` as a segment; they replace documents of their keys, and those whose keys are in ``gone`` go.

    What is there is not written again: removed keys are kept beside the segment, and its statistics are the difference it makes.
    """
    spark = index.spark
    segment = index.statistics().agg(F.max("segment")).first()[0] + 1
    keys = df.select(F.col(index.key).alias("key"))
    keys = (keys if gone is None else keys.union(gone.select(F.col(index.key).alias("key")))).distinct()
    lost = index.lengths().join(keys, "key", "left_semi").agg((-F.count(F.lit(1))).alias("n"), F.coalesce(-F.sum("len"), F.lit(0)).alias("total"))
    lost = materialize(lost, "lost")  # before the segment is there
    _write_segment(index, df, columns, file, segment)
    made = spark.read.parquet(f"{index.path}/lengths/segment={segment}").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    keys.write.parquet(f"{index.path}/removed/segment={segment}")
    lost.union(made).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.parquet(f"{index.path}/statistics/segment={segment}")
    return index


def search_index(index: Index, query: str, k: int | None = 10, match: str = "all", with_file: bool = False) -> DataFrame:
    """BM25 over a written index: (key, score), best first.  Reads the postings of the query's terms."""
    terms = list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))
    if not terms:
        raise ValueError("the query holds no term")
    posts = materialize(index.postings(terms).join(index.lengths(), ["segment", "key"]), "postings")
    seen = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = index.statistics().agg(F.struct(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avg"))).scalar()
    rows = posts.join(F.broadcast(seen), "term").withColumn("s", stats)  # one row per term of the query
    n, d, tf = F.col("s.n"), F.col("df"), F.col("tf").cast("double")
    idf = F.greatest(F.log((n - d + 0.5) / (d + 0.5)), F.lit(1e-6))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("s.avg")))
    out = rows.groupBy("key").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("hits"), F.any_value("file").alias("file"))
    out = out.where(F.col("hits") == len(terms)) if match == "all" else out
    out = out.select(F.col("key").alias(index.key), "score", *["file"] * with_file)
    return out if k is None else out.orderBy(F.desc("score"), index.key).limit(k)


def explore_index(index: Index, query: str, max_files: int = 12) -> DataFrame:
    """``explore`` over a written index that was given a file for each document; no text is read."""
    return _best_files(search_index(index, query, None, "any", with_file=True).withColumnRenamed(index.key, "key"), max_files)
