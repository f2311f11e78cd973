"""Chunked scans against plain windows, on random data with one heavy key and null keys."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from callgrove.operators import structure
from callgrove.plans.chunked import carry_last, left_join_nullable, neighbour, number_rows, running


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(200), i, rng.choice([None, *range(20)])) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t int, i int, v int").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("forward", [False, True])
def test_neighbour(data, forward):
    w = Window.partitionBy("k").orderBy("t", "i")
    got = neighbour(data, ["k"], ["t", "i"], F.floor(F.col("t") / 10), F.col("v"), "n", forward)
    same(got.select("i", "n"), data.select("i", (F.lead if forward else F.lag)("v").over(w).alias("n")))


@pytest.mark.parametrize("how", ["sum", "count", "max", "min"])
def test_running(data, how):
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    got = running(data, ["k"], ["t", "i"], F.floor(F.col("t") / 10), F.col("v"), "n", how)
    plain = {"sum": F.coalesce(F.sum("v").over(w), F.lit(0)), "count": F.count("v").over(w), "max": F.max("v").over(w), "min": F.min("v").over(w)}[how]
    same(got.select("i", "n"), data.select("i", plain.alias("n")))


def test_carry_last(data):
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    got = carry_last(data, ["k"], ["t", "i"], F.floor(F.col("t") / 10), F.col("v"), "n")
    same(got.select("i", "n"), data.select("i", F.last("v", ignorenulls=True).over(w).alias("n")))


def test_number_rows(data):
    got = number_rows(data.select("t", "i"), ["t", "i"], "n")
    same(got.select("i", "n"), data.select("i", F.row_number().over(Window.orderBy("t", "i")).alias("n")))


def test_null_keys_join_nothing_but_stay(data, spark):
    right = spark.createDataFrame([("a", 1), ("hot", 2)], "k string, x int")
    got = left_join_nullable(data.select("k", "i"), right, "k")
    same(got.select("i", "x"), data.join(right, "k", "left").select("i", "x"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["f", "g"]), st.integers(0, 1200), st.integers(0, 300), st.booleans()), min_size=1, max_size=40))
def test_containment_matches_brute_force(spark, spans):
    rows = [(i, f, s, s + n, m) for i, (f, s, n, m) in enumerate(spans)]
    df = spark.createDataFrame(rows, "id int, file string, start int, end int, m boolean")
    a, b = [r for r in rows if r[4]], [r for r in rows if not r[4]]
    within = lambda x, y: x[1] == y[1] and y[2] <= x[2] and y[3] >= x[3] and (y[2], y[3]) != (x[2], x[3])
    left, right = df.filter("m"), df.filter("NOT m")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(structure.rel_inside(left, right)) == [x[0] for x in a if any(within(x, y) for y in b)]
    assert ids(structure.rel_has(left, right)) == [x[0] for x in a if any(within(y, x) for y in b)]
    assert ids(structure.rel_follows(left, right)) == [x[0] for x in a if any(y[1] == x[1] and y[3] <= x[2] for y in b)]
