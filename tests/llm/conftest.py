"""A small table of documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import random
import string

import pytest
from pyspark.sql import types as T

WORDS = ["".join(random.Random(i).choices(string.ascii_lowercase, k=3 + i % 6)) for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"changed{r.random()}" if r.random() < share else w for w in text.split())


DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("component_id", T.StringType()), T.StructField("epoch", T.StringType()), T.StructField("hashes", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("id", T.StringType())])


def documents(texts):
    """Rows of DOCUMENTS for (id, text) pairs."""
    return [(i, t, ["en", "de", None][k % 3], f"s{k % 2}" if k % 5 else None, None if t is None else len(t), "x", None, "h", "1", "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def messy(spark):
    base = prose(1, 120)
    texts = [(1, base), (2, base), (3, edited(base, 3, 0.02)), (4, edited(base, 4, 0.5)), (5, None), (6, ""), (7, "  \n\t "), (8, "one two"), (9, "one two"), (10, "One  Two"),
             (11, prose(2, 60_000)), (12, "x" * 300_000), (13, prose(5, 40)), (13, prose(5, 40)), (None, base), (None, None), (14, "ÄÖ ß é \x00 ퟿ 漢字 tEsT"), (15, "!!! 123 ???")]
    return spark.createDataFrame(documents(texts), DOCUMENTS)
