"""Intermediate tables of iterative jobs.

Every level of a graph walk is written as parquet to the shared folder that the
cluster names in ``spark.checkpoint.dir``.  A lost executor then costs a re-read
of one level, never a replay of the whole walk, and the finished result is one
plain parquet scan over all levels.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CODEC = "zstd"  # of scratch files
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="callgrove-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files: nothing reads them once the table is there."""
    given = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if given is None else spark.conf.set(SHUFFLE_CLEANUP, given)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_measured(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The written table of text columns and the bytes its rows would take in memory, measured during the write."""
    seen = Observation()
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in df.columns), F.lit(32 * len(df.columns)))
    out = materialize(df.observe(seen, F.coalesce(F.sum(width), F.lit(0)).alias("bytes")), name)
    return out, seen.get["bytes"]


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize_by(df: DataFrame, name: str, keys: list[str], distinct: bool = False) -> DataFrame:
    """``materialize`` in as many buckets of ``keys`` as a shuffle has partitions, so that joins on them do not move the table again.

    ``distinct`` drops repeated rows where they lie in one bucket, without a shuffle of its own.
    """
    table = BucketTable(df.sparkSession, name, keys)
    table.append(df, distinct)
    return table.rows()


class BucketTable:
    """Rows that are added to and met again by their keys: a table in buckets of them, so what is there is read in place.

    The table is in the session's catalog, its files in a folder of their own.  With ``part``, each value of that column has its own files.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], part: str | None = None):
        self.spark, self.keys, self.part, tag = spark, keys, part, uuid4().hex
        self.name, self.path = f"{name}_{tag}", f"{scratch_root(spark)}/{name}-{tag}"

    def append(self, df: DataFrame, distinct: bool = False) -> int:
        """Write rows and return their number."""
        seen, n = Observation(), buckets(self.spark)
        df = df.repartition(n, *self.keys)
        df = (df.distinct() if distinct else df).observe(seen, F.count(F.lit(1)).alias("n"))
        out = df.write.mode("append").format("parquet").option("compression", CODEC).bucketBy(n, *self.keys).option("path", self.path)
        with shuffles_removed(self.spark):
            (out.partitionBy(self.part) if self.part else out).saveAsTable(self.name)
        return seen.get["n"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)


class LevelTable:
    """Rows of an iterative job, one ``<part>=k`` folder per step, with ``keys`` in buckets of them."""

    def __init__(self, spark: SparkSession, name: str, part: str = "depth", keys: list[str] | None = None):
        self.spark, self.part = spark, part
        self.path = f"{scratch_root(spark)}/{name}-{uuid4().hex}"
        self.schema: T.StructType | None = None
        self.table = BucketTable(spark, name, keys, part) if keys else None

    def append(self, df: DataFrame, step: int, counted: Column | None = None) -> int:
        """Write one step and return its number of rows (or, without ``keys``, of rows where ``counted`` holds)."""
        if self.table:
            return self.table.append(df.withColumn(self.part, F.lit(step)))
        seen = Observation()
        rule = F.count(F.lit(1)) if counted is None else F.count_if(counted)
        df = df.observe(seen, rule.alias("n"))
        with shuffles_removed(self.spark):
            df.write.parquet(f"{self.path}/{self.part}={step}", compression=CODEC)
        self.schema = df.schema
        return seen.get["n"]

    def step(self, k: int) -> DataFrame:
        if self.table:
            return self.table.rows().filter(F.col(self.part) == k)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.part}={k}")

    def rows(self) -> DataFrame:
        """All steps, with the step number as a partition column."""
        if self.table:
            return self.table.rows()
        schema = T.StructType([*self.schema.fields, T.StructField(self.part, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)
