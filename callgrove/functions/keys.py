"""Cache keys and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrove.constants import TTL_SECONDS
from callgrove.functions.times import micros
from callgrove.plans.chunked import running

PAGE = 1000


def short_hash(text: Column, given: Column | None = None) -> Column:
    """First 16 hex digits of sha256, unless a hash is given."""
    own = F.left(F.sha2(text, 256), F.lit(16))
    return own if given is None else F.coalesce(given, own)


def kv_key(group: Column, commit: Column, kind: Column, entity: Column, sub: Column) -> Column:
    """The key text of one cache row; ``sub`` is a hash, state or round, by kind.

    ``file_<field>`` and ``round_<field>`` are fields of a file's or a round's state; ``global`` keys belong to no group.
    """
    head = F.when(kind == "global", F.lit("audit:")).otherwise(F.concat(F.lit("audit:"), group, F.lit(":commit:"), commit, F.lit(":")))
    field = F.regexp_extract(kind, r"^(?:file|round)_(\w+)$", 1)
    tail = (F.when(kind.isin("method", "judgment", "astmatch"), F.concat(kind, F.lit(":"), entity, F.lit("#"), sub))
            .when(kind.startswith("file_"), F.concat(F.lit("file:"), entity, F.lit("#"), sub, F.lit(":"), field))
            .when(kind.startswith("round_"), F.concat(F.lit("round:"), entity, F.lit(":"), field))
            .when(kind == "endpoint", F.concat(F.lit("endpoint:"), entity, F.lit("#meta")))
            .when(kind.isin("draft", "final"), F.concat(F.lit("finding:"), entity, F.lit(":"), kind))
            .when(kind == "score", F.concat(F.lit("score:"), entity, F.lit(":r"), sub))
            .when(kind == "env", F.lit("env:reachability"))
            .when(kind == "killed", F.concat(F.lit("subagent-killed:"), entity))
            .otherwise(F.concat(kind, F.lit(":"), entity)))
    return F.concat(head, tail)


def kv_parse(key: Column) -> Column:
    """Group, commit, kind, entity and sub of a key; entities may hold ``::``, so it is parsed by its anchors."""
    part = lambda pattern, i: F.nullif(F.regexp_extract(key, pattern, i), F.lit(""))
    head = r"^audit:([^:]+):commit:([^:]+):"
    word = part(head + r"([\w-]+):", 3)
    state = part(head + r"finding:.+:(draft|final)$", 3)
    shared, field = part(r"^audit:global:(.+)$", 1), part(r":(\w+)$", 1)
    kind = (F.when(shared.isNotNull(), "global").when(word == "finding", state).when(word == "subagent-killed", "killed")
            .when(word.isin("file", "round"), F.concat_ws("_", word, field)).otherwise(word))
    entity = (F.when(shared.isNotNull(), shared).when(word == "file", part(head + r"file:([^#]+)#", 3)).when(word == "round", part(head + r"round:(.+):\w+$", 3))
              .when(word == "finding", part(head + r"finding:(.+):(?:draft|final)$", 3))
              .when(word == "score", part(head + r"score:(.+):r\d+$", 3)).when(word == "env", None)
              .otherwise(part(head + r"[\w-]+:([^#]+)", 3)))
    sub = F.when(word == "score", part(head + r"score:.+:r(\d+)$", 3)).when(word == "file", part(r"#([^#:]+):\w+$", 1)).otherwise(part(r"#(.+)$", 1))
    return F.struct(part(head, 1).alias("group_id"), part(head, 2).alias("commit_hash"), kind.alias("kind"),
                    entity.alias("entity"), sub.alias("sub"))


def ttl_seconds(kind: Column) -> Column:
    pairs = [F.lit(x) for k, t in TTL_SECONDS.items() if t is not None for x in (k, t)]
    return F.try_element_at(F.create_map(*pairs), kind).cast("long")


def expire(kv: DataFrame, now: Column) -> DataFrame:
    """Rows still alive at ``now``; kinds without a lifetime never end."""
    ttl = F.coalesce(F.col("ttl_s"), ttl_seconds(F.col("kind"))) if "ttl_s" in kv.columns else ttl_seconds(F.col("kind"))
    return kv.filter(ttl.isNull() | (micros("written_at") + ttl * 1_000_000 > micros(now)))


def prefetch(chains: DataFrame, methods: DataFrame, group: str, commit: str) -> DataFrame:
    """Cache rows of all chains at once: one per method, and summary pages listing the methods.

    A page lists up to 1,000 methods in chain order, so a very long chain gives more pages instead
    of one huge row: the plain key is page 0 and ``#1``, ``#2``, .. follow; every page states their number
    as ``pages``.  A chain without methods gives one empty page.
    """
    g, c = F.lit(group), F.lit(commit)
    m = methods.withColumn("sig_hash", short_hash(F.col("body"), F.col("sig_hash")))
    m = m.withColumn("key", kv_key(g, c, F.lit("method"), F.col("fqn"), F.col("sig_hash")))
    rows = m.select("chain_id", "key", F.lit("method").alias("kind"),
                    F.to_json(F.struct("fqn", "sig_hash", "body", "file", "line")).alias("value"))
    m = m.select("chain_id", "pos", "fqn", "sig_hash", "key").withColumn("b", F.pmod(F.xxhash64("key"), F.lit(64)))
    m = running(m, ["chain_id"], ["pos", "b", "key"], F.floor(F.col("pos") / PAGE), F.lit(1), "nth", "count")
    pages = m.groupBy("chain_id", F.floor((F.col("nth") - 1) / PAGE).alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "fqn", "sig_hash", "key"))).alias("methods"))
    many = pages.groupBy("chain_id").agg(F.count(F.lit(1)).alias("pages"))
    pages = chains.select("chain_id").distinct().join(pages, "chain_id", "left").join(many, "chain_id", "left")
    page = F.coalesce("page", F.lit(0))
    key = kv_key(g, c, F.lit("prefetch"), F.col("chain_id"), F.lit(""))
    listed = F.coalesce(F.transform("methods", lambda x: F.struct(x["fqn"].alias("fqn"), x["sig_hash"].alias("sig_hash"), x["key"].alias("key"))),
                        F.array().cast("array<struct<fqn:string,sig_hash:string,key:string>>"))
    value = F.to_json(F.struct("chain_id", g.alias("group_id"), c.alias("commit"), F.coalesce("pages", F.lit(1)).alias("pages"), listed.alias("methods")))
    summary = pages.select("chain_id", F.when(page > 0, F.concat(key, F.lit("#"), page.cast("string"))).otherwise(key).alias("key"),
                           F.lit("prefetch").alias("kind"), value.alias("value"))
    return rows.unionByName(summary)
