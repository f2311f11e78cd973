"""Near-duplicate groups by one-permutation MinHash.

Each text is the set of its distinct runs of ``words`` words.  One hash function deals the set into bins and
the smallest hash of each bin is its value; empty bins borrow from bins that a universal hash picks (optimal
densification).  Bands of bins are the keys of buckets.  Texts with equal sets are one node from the start.

Buckets give star-shaped edges: the smallest id of a bucket is its centre and is paired with each other
member, so a bucket of n makes n - 1 pairs.  Pairs are confirmed on the full sets.  A bucket whose members
still lie in different components may hide links that no centre took part in; its members are compared
across components in tiles of bounded size, inside tasks, and only confirmed links leave a tile.  The
components of all links are the groups.

The chance that two texts at the threshold share no bucket is (1 - 0.8^4)^24 = 3e-6; nothing else loses a
link, and there is no cap on buckets, partners or rounds.

Defined results: null and empty texts have an empty set, link with nothing and are kept; texts with fewer
words than a run are one run; texts of any length are read in full; the smallest id of a group is kept;
rows with a null id join the rows with an equal set and are kept only if none of those has an id; rows that
share an id count as one document; an empty table gives an empty table.  Only the named columns are read, so further columns
never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgrove.llm.marks import mark, without
from callgrove.llm.texts import SPACED, map_rows, mix, utf8, word_hashes
from callgrove.plans.scratch import materialize

BANDS, ROWS = 24, 4
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingles(value: pa.StringScalar, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words."""
    w = word_hashes(utf8(value), SPACED)
    width = min(words, len(w))
    if not width:
        return w
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mix(h * _STEP + w[i:n + i])
    return np.unique(h)


def _donors(bins: int, tries: int = 512) -> np.ndarray:
    """For each bin the bins it asks for a value, in order."""
    ask = mix(np.arange(bins, dtype=np.uint64)[:, None] * _U(tries) + np.arange(tries, dtype=np.uint64) + _U(1))
    return (ask % _U(bins)).astype(np.int64)


class Signer:
    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.donors = _donors(self.bins)

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """Value of each bin; ``hashes`` is sorted, so each bin's smallest comes first."""
        own = ((hashes >> _U(32)) * _U(self.bins) >> _U(32)).astype(np.int64)
        full, first = np.unique(own, return_index=True)
        out = np.zeros(self.bins, np.uint64)
        out[full] = hashes[first]
        filled = np.zeros(self.bins, bool)
        filled[full] = True
        empty = np.flatnonzero(~filled)
        for t in range(self.donors.shape[1]):
            if not len(empty):
                return out
            lent = self.donors[empty, t]
            found = filled[lent]
            out[empty[found]] = out[lent[found]]
            empty = empty[~found]
        if len(empty):  # then the next filled bin
            out[empty] = out[full[np.searchsorted(full, empty) % len(full)]]
        return out

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket key of each band."""
        parts = self.sketch(hashes).reshape(self.bands, self.rows)
        h = np.arange(self.bands, dtype=np.uint64) + _U(1)
        for i in range(self.rows):
            h = mix(h * _STEP + parts[:, i])
        return h.view(np.int64)


def similar(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _signatures(df: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """Size of the set, its digest and its bucket keys, a row per row of ``df``."""
    def start():
        signer = Signer()

        def sign(value):
            h = shingles(value, words)
            return (len(h), hashlib.md5(h.tobytes()).digest(), signer.keys(h).tolist()) if len(h) else (0, None, None)

        return sign

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, ["id"], "text", {"n": "bigint", "digest": "binary", "keys": "array<bigint>"}, start)


def _sets(df: DataFrame, text: str, key: str, ids: DataFrame, words: int) -> DataFrame:
    """Full sets of the rows with the given ids, and of a few more that share a mark with one; texts are not shuffled."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    rows = mark(rows, ids, "id").where("__marked")
    return map_rows(rows, ["id"], "text", {"hashes": "array<bigint>"}, lambda: lambda v: (np.sort(shingles(v, words).view(np.int64)),))


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """Smallest node reachable from each node of the links (a, b), as id and ``name``.

    Alternates between linking each node's larger neighbours, and then its smaller ones, to the smallest
    (large-star and small-star), which ends in stars after a number of rounds that grows with the logarithm
    of the longest path.  Each round is a written table.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")), "least")
        own = least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        small = large.withColumnRenamed("hi", "u").join(least, "u").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialize(own.union(small).distinct(), "small")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias(name))
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias(name)).union(roots)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar on their full sets; sets of the members travel once per centre."""
    members = pairs.join(sets.withColumnRenamed("id", "b"), "b")
    common = F.size(F.array_intersect("hashes", "own"))
    union = F.size("hashes") + F.size("own") - common
    own = sets.select(F.col("id").alias("a"), F.col("hashes").alias("own"))
    return members.join(own, "a").where(100 * common >= percent * union).select("a", "b")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _across(left: list[tuple], right: list[tuple], band: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links between nodes (id, component, keys, set) of different components in a tile; once two components are linked they count as one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if not left or not right:
        return
    keys = np.stack([r[2] for r in right])
    sizes = np.array([len(r[3]) for r in right])
    for id_, part, own_keys, own in left:
        shared = keys == own_keys
        fits = 100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own))
        for j in np.flatnonzero(shared[:, band] & (shared.argmax(axis=1) == band) & fits).tolist():
            a, b = root(part), root(right[j][1])
            if a != b and similar(_common(own, right[j][3]), len(own), len(right[j][3]), percent):
                parent[max(a, b)] = min(a, b)
                yield id_, right[j][0]


def _rest(members: DataFrame, parts: DataFrame, keys: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between components inside the buckets (key, band, id) whose members lie in more than one.

    ``members`` lacks the centres, which have met all others.  The members outside a bucket's largest
    component form rows, all members columns, of a matrix of tiles of ``block`` by ``block`` nodes; a pair
    that shares several bands is looked at in the first only.
    """
    placed = members.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).select("key", "band", "id", "part")
    placed = materialize(placed, "placed")
    tally = materialize(placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")), "tally")
    mixed = tally.groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"))
    mixed = materialize(mixed.where("all > most.n").select("key", F.col("most.part").alias("main"), "all"), "mixed")
    placed = placed.join(mixed, "key")
    cut = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.ceil(n / F.lit(block))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(n / F.lit(block)) - 1).cast("int")))
    columns = placed.select("key", "band", "id", "part", every(F.col("all")).alias("r"), cut(2, F.col("all")).alias("c"), F.lit(False).alias("row"))
    rows = placed.where("part <> main").select("key", "band", "id", "part", cut(1, F.col("all")).alias("r"), every(F.col("all")).alias("c"), F.lit(True).alias("row"))
    tiles = rows.union(columns)
    busy = materialize(rows.select("key", "r", "c").distinct(), "busy")
    tiles = materialize(tiles.join(busy, ["key", "r", "c"], "left_semi"), "tiles")
    tiles = tiles.join(keys, "id").join(sets, "id")

    def compare(table: pa.Table) -> pa.Table:
        sides: dict[bool, list[tuple]] = {True: [], False: []}
        band = 0
        for batch in table.select(["id", "part", "keys", "hashes", "row", "band"]).to_batches():
            for i, part, own_keys, hashes, row, at in zip(*(batch.column(j) for j in range(6)), strict=True):
                band = at.as_py()
                sides[row.as_py()].append((i.as_py(), part.as_py(), own_keys.values.to_numpy(), hashes.values.to_numpy()))
        found = sorted(_across(sorted(sides[True], key=lambda x: x[0]), sorted(sides[False], key=lambda x: x[0]), band, percent))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return tiles.groupBy("key", "r", "c").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, percent: int = 80, block: int = 1024) -> DataFrame:
    """``key``, n_shingles, component_id (smallest id reachable) and kept, a row per row of ``df``."""
    signed = materialize(_signatures(df, text, key, words), "signatures")
    nodes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    nodes = materialize(nodes, "nodes")
    named = nodes.where("id IS NOT NULL")
    buckets = named.select("id", "n", F.posexplode("keys").alias("band", "key"))
    centres = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("centre"), F.count(F.lit(1)).alias("many")).where("many > 1")
    centres = materialize(centres.select("key", F.col("centre.id").alias("a"), F.col("centre.n").alias("na"), "many"), "centres")
    members = materialize(buckets.join(centres, "key").where("id <> a"), "buckets")
    fits = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")  # else the sets cannot be similar
    pairs = materialize(members.where(fits).select("a", F.col("id").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(members.where(fits | (F.col("many") > 2)).select("id")).distinct()
    sets = materialize(_sets(df, text, key, ids, words), "sets")
    links = materialize(_confirm(pairs, sets, percent), "confirmed")
    parts = materialize(components(links), "parts")
    more = materialize(_rest(members.select("key", "band", "id"), parts, named.select("id", "keys"), sets, percent, block), "rest")
    groups = components(links.union(more), "group")
    classes = nodes.join(groups, "id", "left").select("digest", F.coalesce("group", "id").alias("component_id"))
    classes = materialize(classes, "classes")
    alone = signed.where("digest IS NULL").select("id", "n", F.col("id").alias("component_id"))
    out = signed.where("digest IS NOT NULL").join(classes, "digest", "left").select("id", "n", "component_id").union(alone)
    kind = df.schema[key].dataType
    return out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, percent: int = 80) -> DataFrame:
    """``df`` with one row of each group, all columns; rows repeated with one id count once."""
    found = materialize(near_duplicates(df, text, key, words, percent), "decisions")
    dropped = found.where(~F.col("kept") & F.col(key).isNotNull()).select(key).distinct()
    out = without(df, dropped, key)
    if found.groupBy(key).count().where(f"count > 1 AND `{key}` IS NOT NULL").limit(1).count():
        first = Window.partitionBy(key).orderBy(F.xxhash64(*[c for c in df.columns if c != key]))
        out = out.withColumn("__nth", F.row_number().over(first)).where(f"__nth = 1 OR `{key}` IS NULL").drop("__nth")
    return out.select(*df.columns)
