"""Repair of the role structure of conversations by a shortest path over states, with square-root checkpoints.

A conversation is in order when its roles' initials are an optional s and then pairs of u and a.  Its rows are
kept (0), given the role user or assistant (3), deleted (4; blank rows and repeated ones must be) or get an
empty row of user or assistant put before or after them (3); a truncated row that stays costs 3 more.  The
state after some rows is nothing, s, u or a, so the cheapest way to the end from any row is a vector of four
costs.  These are computed backward and held only at every sqrt(n)-th row; while the rows are then walked
forward, the vectors of one stretch at a time are computed again, and among the edits that keep to the least
cost (the tight ones) the first by letter (D, I, K, R) is taken, which gives the ASCII-least edits.

Conversations may be of any size.  Equal rows are counted before anything is sorted; the counted rows are range
partitioned in order and packed into blocks of ``BLOCK`` rows.  A conversation that lies in one block is
solved there.  The blocks of others are solved independently: each gives the least costs from state to state,
a scan over these gives the vector at its end, each then gives the state it ends in for each state it may begin
in, a second scan gives the state it begins in, and the edits follow.  Only the scans see a conversation as a
whole, with a few numbers for each block.

Defined results: a null role or text counts as one space; null turns come first, rows of one turn are in order
of role and text, equal rows stand together and all but the first are duplicates; null conversation ids are
one conversation; a role without a first character fits nowhere; texts of any length are read whole; an empty
table gives an empty table.  Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrove.llm.texts import small_batches
from callgrove.plans.scratch import materialize

BLOCK, BLOCK_CHARS = 1024, 1 << 20
DELETE, RELABEL, INSERT, CUT_OFF = 4, 3, 3, 3
_FAR = 1 << 60
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that the next pair's role leads to, and that role.
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_ROLE = ("user", "user", "assistant", "user")
_KEEP = {(NOTHING, "s"): AFTER_S, (NOTHING, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: Costs from each state to the end when no row is left: nothing or whole pairs are in order.
END = (0, 2 * INSERT, INSERT, 0)
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_PART = re.compile(r"[^\x20\x09-\x0D]")


class Row(NamedTuple):
    """What the costs of a row depend on."""
    initial: str
    gone: bool  # must be deleted
    cut_off: bool
    copies: int


def faults(roles: list[str], texts: list[str], copies: list[int], earlier: set[int]) -> tuple[list[Row], list[int]]:
    """The rows, and how many are blank, duplicates and truncated; ``earlier`` has the places of rows seen in earlier blocks."""
    rows, count, seen = [], [0, 0, 0], set()
    for i, (role, text, n) in enumerate(zip(roles, texts, copies, strict=True)):
        end = text.rstrip(_SPACE)
        again = i in earlier or (role, text) in seen
        seen.add((role, text))
        cut_off = bool(end) and not again and end[-1] not in ".!?"
        rows.append(Row(role[:1], not end or again, cut_off, n))
        if not end:
            count[0] += n
        else:
            count[1] += n if again else n - 1
            count[2] += cut_off
    return rows, count


def _back(row: Row, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end from before a row, given those from behind it."""
    initial, gone, cut_off, n = row
    best = [DELETE * n + v for v in after]
    if not gone:
        stay = CUT_OFF * cut_off + DELETE * (n - 1)
        for s in range(4):
            best[s] = min(best[s], RELABEL + stay + after[_NEXT[s]])
            if (to := _KEEP.get((s, initial))) is not None:
                best[s] = min(best[s], stay + after[to])
    u, a = min(best[AFTER_U], INSERT + best[AFTER_A]), min(best[AFTER_A], INSERT + best[AFTER_U])
    return min(best[NOTHING], INSERT + u), min(best[AFTER_S], INSERT + u), u, a


def transfer(rows: list[Row]) -> list[int]:
    """Least cost from each state before the rows to each state behind them, row by row of a 4 x 4 matrix."""
    columns = []
    for t in range(4):
        after = tuple(0 if s == t else _FAR for s in range(4))
        for row in reversed(rows):
            after = _back(row, after)
        columns.append(after)
    return [min(columns[t][s], _FAR) for s in range(4) for t in range(4)]


def walk(rows: list[Row], end: tuple[int, ...], states: list[int], last: bool) -> Iterator[tuple[int, str, int, str]]:
    """The ASCII-least tight edits from ``states[0]`` on, as number of the row, letter, times and role; appends the state they end in.

    Of the backward vectors only every sqrt(n)-th is held; those between are computed again when the walk gets there.
    """
    step = isqrt(len(rows)) + 1
    held, after = {len(rows): end}, end
    for i in range(len(rows) - 1, -1, -1):
        after = _back(rows[i], after)
        if i % step == 0:
            held[i] = after
    state = states[0]
    for first in range(0, len(rows), step):
        beyond = min(first + step, len(rows))
        costs = [held[beyond]]
        for i in range(beyond - 1, first - 1, -1):
            costs.append(_back(rows[i], costs[-1]))
        costs.reverse()
        for i in range(first, beyond):
            (initial, gone, cut_off, n), here, after = rows[i], costs[i - first], costs[i - first + 1]
            stay = CUT_OFF * cut_off + DELETE * (n - 1)
            while True:
                if DELETE * n + after[state] == here[state]:
                    yield i, "D", n, ""
                    break
                if INSERT + here[_NEXT[state]] == here[state]:
                    yield i, "I", 1, _ROLE[state]
                    state = _NEXT[state]
                    continue
                to = _KEEP.get((state, initial))
                if not gone and to is not None and stay + after[to] == here[state]:
                    yield i, "K", 1, ""
                    state = to
                else:
                    yield i, "R", 1, _ROLE[state]
                    state = _NEXT[state]
                if n > 1:
                    yield i, "D", n - 1, ""
                break
    while last and state in (AFTER_S, AFTER_U):
        yield len(rows), "I", 1, _ROLE[state]
        state = _NEXT[state]
    states.append(state)


class Repair(NamedTuple):
    cost: int
    audit: str
    roles: list[str]
    texts: list[str]


def repair(roles: list[str], texts: list[str], rows: list[Row], state: int = NOTHING, end: tuple[int, ...] = END, last: bool = True) -> Repair:
    """The cheapest edits of some rows and what they leave."""
    cost, audit, out_roles, out_texts = 0, [], [], []
    for i, letter, n, role in walk(rows, end, [state], last):
        audit.append(letter * n)
        if letter == "D":
            cost += DELETE * n
            continue
        cost += {"K": 0, "R": RELABEL, "I": INSERT}[letter]
        if letter != "I":
            cost += CUT_OFF * rows[i].cut_off
        out_roles.append(role or roles[i])
        out_texts.append("" if letter == "I" else texts[i])
    return Repair(cost, "".join(audit), out_roles, out_texts)


def _illegal(rows: list[Row]) -> int:
    """Neighbours, copies among them, whose initials may not follow one another."""
    return sum(r.copies - 1 for r in rows) + sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in pairwise(rows))


def _pack(df: DataFrame, conv: T.StructField, turn: T.StructField) -> DataFrame:
    """Sorted rows as blocks; ``open`` where the conversation may have others."""
    kinds = {"number": pa.int64(), "open": pa.bool_(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "copies": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, first, conv_type, turn_type = 0, None, True, None, None

        def out(block, open_):
            values = {"conv": [block["conv"]], "number": [block["number"]], "open": [open_], "turns": [block["turns"]], **{c: [block[c]] for c in ("roles", "texts", "copies")}}
            types = {"conv": conv_type, "turns": pa.list_(turn_type), **kinds}
            return pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in values.items()], list(values))

        for batch in batches:
            conv_type, turn_type = batch.schema.field("conv").type, batch.schema.field("turn").type
            for c, t, role, text, n in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "n")), strict=True):
                same = held is not None and held["conv"] == c
                if not same or len(held["roles"]) >= BLOCK or held["chars"] >= BLOCK_CHARS:
                    if held is not None:  # the first conversation of a part, and the last, may go on in another
                        yield out(held, held["open"] or same)
                        first = first and same
                    held = {"conv": c, "number": number, "open": first or same, "chars": 0, "turns": [], "roles": [], "texts": [], "copies": []}
                    number += 1
                held["chars"] += len(text) + len(role)
                for name, value in (("turns", t), ("roles", role), ("texts", text), ("copies", n)):
                    held[name].append(value)
        if held is not None:
            yield out(held, True)

    schema = T.StructType([
        T.StructField("conv", conv.dataType), T.StructField("number", T.LongType()), T.StructField("open", T.BooleanType()), T.StructField("turns", T.ArrayType(turn.dataType)),
        T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("copies", T.ArrayType(T.LongType()))])
    return df.mapInArrow(run, schema)


def _each(df: DataFrame, keep: list[str], fields: str, judge) -> DataFrame:
    """Columns ``keep`` and what ``judge`` makes of each row, given as a dictionary of the other columns."""
    added = T._parse_datatype_string(fields)
    schema = T.StructType([*(df.schema[c] for c in keep), *added.fields])
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    types = [kinds[f.dataType.simpleString()] for f in added.fields]
    read = [c for c in df.columns if c not in ("conv", "key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(dict(zip(read, values, strict=True))) for values in zip(*(batch.column(c).to_pylist() for c in read), strict=True)]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], schema.names)

    return df.mapInArrow(run, schema)


_REPAIRED = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, new_roles array<string>, new_texts array<string>"


def _whole(x: dict) -> tuple:
    """A conversation of one block."""
    rows, count = faults(x["roles"], x["texts"], x["copies"], set())
    done = repair(x["roles"], x["texts"], rows)
    return *count, _illegal(rows), done.cost, done.audit, done.roles, done.texts


def _seen_before(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the places of rows that stand in earlier blocks of the conversation, too."""
    at = blocks.select("key", "part", "number", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row"))
    name = F.sha2(F.concat(F.length("row.roles").cast("string"), F.lit(":"), F.col("row.roles"), F.col("row.texts")).cast("binary"), 256)
    rows = at.select("key", "part", "number", "place", name.alias("name"))
    first = rows.groupBy("key", "name").agg(F.min(F.struct("part", "number")).alias("first"), F.max(F.struct("part", "number")).alias("last")).where("first < last")
    again = rows.join(first, ["key", "name"]).where(F.col("first") < F.struct("part", "number"))
    places = again.groupBy("key", "part", "number").agg(F.collect_list(F.col("place").cast("bigint")).alias("earlier"))
    return blocks.join(places, ["key", "part", "number"], "left").withColumn("earlier", F.coalesce("earlier", F.array().cast("array<bigint>")))


def _scan(df: DataFrame, fields: str, step) -> DataFrame:
    """For each conversation ``step`` of its blocks' rows in order, a few numbers each."""
    added = T._parse_datatype_string(fields)
    schema = T.StructType([*(df.schema[c] for c in ("key", "part", "number")), *added.fields])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("number", "ascending")])
        made = step(table.to_pylist())
        columns = [table.column(c) for c in ("key", "part", "number")]
        kinds = [pa.list_(pa.int64()) if f.dataType.simpleString().startswith("array") else pa.int64() for f in added.fields]
        return pa.Table.from_arrays([*columns, *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names=schema.names)

    return df.groupBy("key").applyInArrow(run, schema)


def _ends(blocks: list[dict]) -> list[tuple]:
    """The costs from each state at the end of each block, whether it is the last, and what counts between it and the one before."""
    out, after = [], END
    for k in range(len(blocks) - 1, -1, -1):
        out.append([after, int(k == len(blocks) - 1)])
        m = blocks[k]["costs"]
        after = tuple(min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4))
    out.reverse()
    for k, b in enumerate(blocks):
        pair = blocks[k - 1]["last_initial"] + b["first_initial"] if k else "su"
        out[k].append(int(pair not in ("su", "ua", "au")))
    return out


def _begins(blocks: list[dict]) -> list[tuple]:
    """The state in which each block begins."""
    out, state = [], NOTHING
    for b in blocks:
        out.append((state,))
        state = b["to"][state]
    return out


def _spread(blocks: DataFrame) -> DataFrame:
    """The blocks of conversations that may have several, solved."""
    blocks = materialize(_seen_before(blocks), "open")
    key = ["key", "part", "number"]

    def costs(x):
        rows, _ = faults(x["roles"], x["texts"], x["copies"], set(x["earlier"]))
        return transfer(rows), rows[0].initial, rows[-1].initial

    def to(x):
        rows, _ = faults(x["roles"], x["texts"], x["copies"], set(x["earlier"]))
        ends = []
        for s in range(4):
            states = [s]
            for _ in walk(rows, tuple(x["ends"]), states, bool(x["last"])):
                pass
            ends.append(states[-1])
        return (ends,)

    def edits(x):
        rows, count = faults(x["roles"], x["texts"], x["copies"], set(x["earlier"]))
        done = repair(x["roles"], x["texts"], rows, x["state"], tuple(x["ends"]), bool(x["last"]))
        return *count, _illegal(rows) + x["between"], done.cost, done.audit, done.roles, done.texts

    summary = _each(blocks.select(*key, "roles", "texts", "copies", "earlier"), key, "costs array<bigint>, first_initial string, last_initial string", costs)
    ends = materialize(_scan(summary, "ends array<bigint>, last bigint, between bigint", _ends), "ends")
    ways = _each(blocks.join(ends, key).select(*key, "roles", "texts", "copies", "earlier", "ends", "last"), key, "to array<bigint>", to)
    begins = _scan(ways, "state bigint", _begins)
    ready = blocks.join(ends.join(begins, key), key)
    return _each(ready, ["conv", "key", "part", "number", "turns"], _REPAIRED, edits)


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Blocks of repaired conversations: conv, part, number (their order), closed (the only one), turns (as given), the counts of
    faults, cost, audit (the edits' letters), new_roles and new_texts (what the edits leave)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    counted = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    order = ["conv", "turn", "role", "text"]  # nulls come first
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = small_batches(counted).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = _pack(placed, df.schema[conv], df.schema[turn]).withColumn("part", F.spark_partition_id())
    blocks = materialize(blocks, "blocks").withColumn("key", F.struct("conv"))
    closed = _each(blocks.where("NOT open"), ["conv", "key", "part", "number", "turns"], _REPAIRED, _whole)
    out = closed.withColumn("closed", F.lit(True)).unionByName(_spread(blocks.where("open")).withColumn("closed", F.lit(False)))
    return materialize(out.drop("key"), "repaired")


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """The rows that the edits leave: conv, part, number and place (in order), role and text."""
    rows = repaired.select("conv", "part", "number", F.posexplode(F.arrays_zip("new_roles", "new_texts")).alias("place", "row"))
    return rows.select("conv", "part", "number", "place", F.col("row.new_roles").alias("role"), F.col("row.new_texts").alias("text"))


def _chained_digest(chunks: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's chunks, joined by line ends; they stream by in order, none is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, fresh, schema = None, None, True, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], schema), pa.array([digest.hexdigest()])], ["key", "sha256"])
        for batch in batches:
            schema = batch.schema.field("key").type
            for key, chunk, n in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "n")), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        yield made()
                    now, digest, fresh = key, hashlib.sha256(), True
                if n:
                    digest.update(("" if fresh else "\n").encode() + chunk.encode())
                    fresh = False
        if digest is not None:
            yield made()

    placed = chunks.repartition("key").sortWithinPartitions("key", "part", "number").select("key", "chunk", "n")
    return placed.mapInArrow(run, T.StructType([chunks.schema["key"], T.StructField("sha256", T.StringType())]))


def summarize(repaired: DataFrame) -> DataFrame:
    """One row for each conversation that has rows: gaps, the counts of faults, cost, audit and sha256 of the repaired ``role:text`` lines."""
    lines = F.zip_with("new_roles", "new_texts", lambda r, t: F.concat(r, F.lit(":"), t))
    rows = repaired.select("*", F.struct("conv").alias("key"), F.array_join(lines, "\n").alias("chunk"), F.size("new_roles").alias("n"))
    given = F.array_distinct(F.filter("turns", lambda t: t.isNotNull()))
    rows = rows.withColumn("distinct", given).drop("turns", "new_roles", "new_texts")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    turns = lambda least, most, n: F.coalesce(most - least + 1 - n, F.lit(0)).cast("bigint")
    alone = rows.where("closed").select("conv", turns(F.array_min("distinct"), F.array_max("distinct"), F.size("distinct")).alias("gaps"), *counts, "audit",
                                        F.sha2(F.col("chunk").cast("binary"), 256).alias("sha256"))
    spread = rows.where("NOT closed")
    sums = spread.groupBy("key").agg(*[F.sum(c).alias(c) for c in counts],
                                     F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "number", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    each = spread.select("key", F.explode("distinct").alias("turn")).distinct()  # before counting: a turn may go on in many blocks
    span = each.groupBy("key").agg(turns(F.min("turn"), F.max("turn"), F.count(F.lit(1))).alias("gaps"))
    digests = _chained_digest(spread.select("key", "part", "number", "chunk", "n"))
    many = sums.join(span, "key", "left").join(digests, "key").select(
        F.col("key.conv").alias("conv"), F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), *counts, "audit", "sha256")
    return alone.unionByName(many)
