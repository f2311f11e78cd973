"""A corpus from raw documents to a mixture: STAGES in order, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``.  ``run`` applies them to the table of documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrove.llm import decontaminate, language_id, minhash_dedup, mixture, secret_scan
from callgrove.plans.scratch import materialize, scratch_root

#: Share of the median cosine of learned texts of a size, below which a text of that size is no prose of any learned language.
LEAST_SHARE = 0.25
#: The least cosine where too few texts were learned to tell by size.
LEAST_COSINE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and texts near to no language; what is kept is unchanged.

    Rows without a language teach nothing, all others that are not held out do; repeated rows are judged alike.  Texts are
    judged once and written with what was measured, from which the bounds are taken.
    """
    known = ~language_id.held_out()
    if not (prototypes := language_id.learn(docs.where(known))):
        return language_id.keep_identified(docs, prototypes, LEAST_COSINE)
    measured = materialize(language_id.measure(docs, prototypes), "languages")
    return language_id.keep_measured(measured, LEAST_COSINE, language_id.learn_bounds(measured.where(known), LEAST_SHARE))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, on runs of five words.

    Null and empty texts are in no group; rows repeated with one id count once; rows without an id stay.
    """
    return minhash_dedup.drop_near_duplicates(docs, words=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; null and empty texts hold none."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and counts n_chars anew; no document goes, those without secrets are unchanged, null stays null."""
    out = secret_scan.redact_secrets(docs, "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per selected document and epoch, texts cut where a leaf's budget ends; texts without words are not selected."""
    return mixture.mix_sources(mixture.with_domain(docs))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("mixture", mix),
]

#: Language profiles and sketches are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
