"""Runs of words that repeat with a period, found by octaves of periods in overlapping tiles.

A run is a stretch of words with smallest period q, at least ``repeats`` * q and ``shortest`` words long, that
no neighbouring word extends with the same period.  Periods are worked off by octaves, 2^k to 2^(k+1) - 1.
Boundaries stand every 2^k words, so each run of the octave holds several, and the words after one of them
recur one period later.  At a boundary the Z-functions (how far the words after it agree with the words q
later, and those before it with the words before those) are needed only for periods at which the first 2^k
words agree: equal hashes of blocks of 2^k words name them, and hashes of blocks of half the size, a quarter
and so on measure how far the agreement reaches, up to the next boundaries.  All boundaries and periods of an
octave are compared in one numpy pass.  A period whose own words are a power of a shorter stretch is dropped.

What agrees around one boundary is a fragment (period, first and last agreeing word).  Texts of at most
``tile`` words are one tile and are solved where they are read.  Longer texts are exploded into overlapping tiles per
octave, which are dealt out and solved independently.  All fragments are shuffled by document and period and
stitched where they touch; what is long enough is a run.  A document is named by the digest of its text, so
copies are stitched once.

Defined results: null and empty texts, and those of white space, have no words and no runs; texts of any
length are searched in full; words differ by case; runs are in order of start and period; repeated rows have
equal runs each; an empty table gives an empty table.  All columns of ``df`` stay as they are, whatever their
names; those added replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrove.llm.marks import mark
from callgrove.llm.texts import CASED, map_rows, mix, slices, small_batches, utf8, word_hashes
from callgrove.plans.scratch import materialize

TILE = 1 << 13
#: Words of short texts that are solved together.
TOGETHER = 1 << 18
#: Beyond so many words only every third size of blocks is held.
WIDE = 1 << 20
_U = np.uint64
_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_FOUND = "key string, octave int, period bigint, low bigint, high bigint, words binary"


class Blocks:
    """Hashes of all blocks of 1, 2, 4, ... words of an array."""

    def __init__(self, words: np.ndarray):
        self.top, self.level, self.sparse = 0, {0: mix(words)}, len(words) > WIDE

    def grow(self) -> bool:
        """Go on to blocks of twice the size; false if there are none."""
        last, half = self.level[self.top], 1 << self.top
        if len(last) <= half:
            return False
        first = last[:-half]
        if self.sparse and self.top % 3:
            del self.level[self.top]
        self.top += 1
        self.level[self.top] = mix(first * _U(0x9E3779B97F4A7C15) + (last[half:] ^ (last[half:] >> _U(29))))
        return True

    def cut(self, size: int) -> None:
        """Keep only the first ``size`` words."""
        self.level = {j: h[:max(0, size - (1 << j) + 1)] for j, h in self.level.items()}

    def agree(self, at: np.ndarray, shift: np.ndarray, whole: bool = False, back: bool = False) -> np.ndarray:
        """How many words from ``at`` on (or before it) agree with those ``shift`` later: at most 2^top - 1, with ``whole`` 2^(top + 1) - 1."""
        n, above = np.zeros(len(at), np.int64), self.top
        for j in sorted(self.level, reverse=True):
            h = self.level[j]
            for _ in range((1 << above - j) - 1 if j < self.top else int(whole)):
                x = at - n - (1 << j) if back else at + n
                y = x + shift
                ok = (x >= 0) & (y < len(h))
                if not len(h) or not ok.any():
                    break
                x, y = np.where(ok, x, 0), np.where(ok, y, 0)
                n += np.where(ok & (h[x] == h[y]), 1 << j, 0)
            above = j
        return n


def _is_power(blocks: Blocks, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the ``period`` words from ``at`` on are a repetition of fewer words."""
    power, rest = np.zeros(len(at), bool), period.copy()

    def test(rows: np.ndarray, prime: np.ndarray) -> None:
        root = period[rows] // prime
        power[rows] |= blocks.agree(at[rows], root, whole=True) >= period[rows] - root

    prime = 2
    while len(rest) and prime * prime <= rest[~power].max(initial=1):
        rows = np.flatnonzero((rest % prime == 0) & ~power)
        if len(rows):
            test(rows, np.full(len(rows), prime))
            while len(rows):
                rest[rows] //= prime
                rows = rows[rest[rows] % prime == 0]
        prime += 1
    rows = np.flatnonzero((rest > 1) & ~power)
    test(rows, rest[rows])
    return power


def _fragments(blocks: Blocks, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Period, first and end of the agreeing stretches of the octave at which ``blocks`` stands, those that touch as one.

    Stretches that are no run, told by ``least`` agreeing words for each word of the period, are left out."""
    step, h = 1 << blocks.top, blocks.level[blocks.top]
    empty = np.zeros(0, np.int64)
    if len(h) <= step:
        return empty, empty, empty
    hit = np.flatnonzero(h[step:] == np.repeat(h[:-step:step], step)[:len(h) - step])
    at = hit // step * step
    period = hit - at + step
    high = at + step + blocks.agree(at + step, period)
    low = at - blocks.agree(at, period, back=True)
    order = np.lexsort((low, period))
    period, low, high, at = period[order], low[order], high[order], at[order]
    new = np.append(True, (period[1:] != period[:-1]) | (low[1:] > high[:-1])) if len(low) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    period, low, at, high = period[first], low[first], at[first], high[np.append(first[1:], len(high)) - 1] if len(first) else high
    long = high - low >= least * period
    period, low, high, at = period[long], low[long], high[long], at[long]
    own = ~_is_power(blocks, at, period)
    return period[own], low[own], high[own]


def _octaves(words: np.ndarray, sizes: np.ndarray, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Agreeing stretches of texts that stand one after another in ``words``, the longest first, a word that recurs nowhere after each."""
    blocks, ends, most = Blocks(words), np.cumsum(sizes + 1), sizes.max(initial=0)
    while repeats << blocks.top <= most:
        blocks.cut(int(ends[np.count_nonzero(sizes >= repeats << blocks.top) - 1]))
        yield _fragments(blocks, repeats - 1)
        if not blocks.grow():
            return


def _solve_short(texts: list[tuple[int, np.ndarray]], repeats: int, shortest: int) -> list[tuple[int, int, int, int]]:
    """Number of the text, period, first and end of the agreeing stretch, for every run of texts that are one tile each."""
    texts = sorted((t for t in texts if len(t[1])), key=lambda t: -len(t[1]))
    sizes = np.array([len(w) for _, w in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    gaps = mix(np.arange(len(texts), dtype=np.uint64) + _U(0x5851F42D4C957F2D))
    words = np.concatenate([x for (_, w), g in zip(texts, gaps, strict=True) for x in (w, g[None])]) if texts else np.zeros(0, np.uint64)
    out = []
    for period, low, high in _octaves(words, sizes, repeats):
        long = high - low + period >= shortest
        own = np.searchsorted(begin, low[long], side="right") - 1
        for k, q, a, b in zip(own.tolist(), period[long].tolist(), (low[long] - begin[own]).tolist(), (high[long] - begin[own]).tolist(), strict=True):
            out.append((texts[k][0], q, a, b))
    return out


def _tiles(n: int, repeats: int, tile: int) -> Iterator[tuple[int, int, int]]:
    """Octave, first and end word of each tile of a text of n words; those of octave -1 are for all periods below an eighth of ``tile``."""
    octave, step = -1, tile // 8
    while octave < 0 or repeats << octave <= n:
        reach = step // 2 if octave < 0 else step  # the longest distance of boundaries in the tile
        for core in range(0, n, 8 * step):
            yield octave, max(0, core - reach), min(n, core + 8 * step + 4 * reach)
        octave = (tile // 8).bit_length() - 1 if octave < 0 else octave + 1
        step = 1 << octave


def _solve_tile(words: np.ndarray, octave: int, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Agreeing stretches of one tile, of any length."""
    blocks = Blocks(words)
    lowest, highest = (0, (tile // 8).bit_length() - 2) if octave < 0 else (octave, octave)
    while blocks.top <= highest:
        if blocks.top >= lowest:
            yield _fragments(blocks, 0)
        if not blocks.grow():
            return


def _read(rows: DataFrame, repeats: int, shortest: int, tile: int) -> DataFrame:
    """Fragments of texts of one tile, and the tiles of longer ones."""
    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[]] * 6
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", "octave", "period", "low", "high", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, waiting = batch.column("key").to_pylist(), [], 0
            for i, value in enumerate(batch.column("text")):
                words = word_hashes(utf8(value), CASED)
                if len(words) > tile:
                    for octave, low, high in _tiles(len(words), repeats, tile):
                        yield batch_of([(keys[i], octave, None, low, high, words[low:high].tobytes())])
                    continue
                held.append((i, words))
                waiting += len(words)
                if waiting >= TOGETHER:
                    yield batch_of([(keys[k], None, q, a, b, None) for k, q, a, b in _solve_short(held, repeats, shortest)])
                    held, waiting = [], 0
            yield batch_of([(keys[k], None, q, a, b, None) for k, q, a, b in _solve_short(held, repeats, shortest)])

    return small_batches(rows).mapInArrow(run, _FOUND)


def _solve(tiles: DataFrame, tile: int) -> DataFrame:
    """Fragments of tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, octave, base, words in zip(*(batch.column(c) for c in ("key", "octave", "low", "words")), strict=True):
                for period, low, high in _solve_tile(np.frombuffer(words.as_buffer(), np.uint64), octave.as_py(), tile):
                    columns = [pa.array([key.as_py()] * len(period), pa.string()), *(pa.array(x, pa.int64()) for x in (period, low + base.as_py(), high + base.as_py()))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "period", "low", "high"])

    return tiles.mapInArrow(run, "key string, period bigint, low bigint, high bigint")


def find_runs(df: DataFrame, text: str = "text", repeats: int = 4, shortest: int = 6, tile: int = TILE) -> DataFrame:
    """key (the digest of a text) and runs, an array of start, length and period, for every text that has a run."""
    rows = df.select(F.md5(F.col(text).cast("string").cast("binary")).alias("key"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    found = materialize(_read(rows, repeats, shortest, tile), "tiles")
    ready = found.where("words IS NULL").select("key", "period", "low", "high")
    tiles = found.where("words IS NOT NULL").groupBy("key", "octave", "low").agg(F.any_value("words").alias("words"))  # deals them out; copies go
    dealt = _solve(tiles, tile)
    pieces = ready.unionAll(dealt).distinct()
    line = Window.partitionBy("key", "period").orderBy("low", "high")
    before = F.max("high").over(line.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("low") <= F.col("before"), 0).otherwise(1)).over(line)
    stitched = pieces.withColumn("before", before).withColumn("island", island).groupBy("key", "period", "island").agg(
        F.min("low").alias("start"), (F.max("high") - F.min("low") + F.col("period")).alias("length"))
    long = stitched.where((F.col("length") >= shortest) & (F.col("length") >= repeats * F.col("period")))
    runs = long.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return runs.select("key", F.array_sort("runs", lambda a, b: F.when(a["start"] != b["start"], F.sign(a["start"] - b["start"])).otherwise(
        F.sign(a["period"] - b["period"])).cast("int")).alias("runs"))


def with_runs(df: DataFrame, text: str = "text", name: str = "runs", **settings) -> DataFrame:
    """``df`` with its runs; only rows that may have some are shuffled to their runs."""
    runs = materialize(find_runs(df, text, **settings), "runs")
    rows = mark(df.drop(name).withColumn("__key", F.md5(F.col(text).cast("string").cast("binary"))), runs.select(F.col("key").alias("__key")), "__key")
    none = rows.where("NOT __marked").withColumn(name, F.array().cast(_RUN))
    some = rows.where("__marked").join(runs.select(F.col("key").alias("__key"), F.col("runs").alias("__runs")), "__key", "left")
    some = some.withColumn(name, F.coalesce("__runs", F.array().cast(_RUN)))
    columns = [*(c for c in df.columns if c != name), name]
    return none.select(*columns).unionAll(some.select(*columns))


def longest(runs: str = "runs"):
    """The run with the greatest length for its period; of equal ones that with the smallest start, then period; null without one."""
    def order(a, b):
        size = F.sign(b["length"] * a["period"] - a["length"] * b["period"])
        start = F.sign(a["start"] - b["start"])
        return F.when(size != 0, size).when(start != 0, start).otherwise(F.sign(a["period"] - b["period"])).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def collapsed(text: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text but those that repeat inside a run, with one space between them."""
    parts, at = [], 0
    start, stop = (np.array(x, np.int64) for x in zip(*[(s + q, s + n) for s, n, q in runs], strict=True)) if runs else (np.zeros(0, np.int64),) * 2
    for a, b in slices(text, CASED):
        part = text[a:b]
        inside = np.concatenate(([False], CASED[part] > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[0::2], edges[1::2]
        here = (start < at + len(begin)) & (stop > at)
        change = np.zeros(len(begin) + 1, np.int64)
        np.add.at(change, np.clip(start[here] - at, 0, len(begin)), 1)
        np.add.at(change, np.clip(stop[here] - at, 0, len(begin)), -1)
        kept = np.cumsum(change)[:-1] == 0
        at += len(begin)
        size = end[kept] - begin[kept] + 1  # a word and what stands behind it
        upto = np.cumsum(size)
        if len(size):
            place = np.arange(upto[-1]) + np.repeat(begin[kept] - (upto - size), size)
            out = part[np.minimum(place, len(part) - 1)]
            out[upto - 1] = 32
            parts.append(out.tobytes())
    return b"".join(parts)[:-1]


def collapse(df: DataFrame, keep: list[str], text: str = "text", runs: str = "runs", name: str = "collapsed") -> DataFrame:
    """Columns ``keep`` and the texts without what repeats in their runs; null texts are empty."""
    both = df.select(*keep, F.struct(F.col(text).cast("string").alias("text"), F.col(runs).alias("runs")).alias("__both"))

    def start():
        def judge(value):
            spans = [(r["start"], r["length"], r["period"]) for r in value["runs"].as_py() or []]
            return (collapsed(utf8(value["text"]), spans).decode(),)

        return judge

    return map_rows(both, keep, "__both", {name: "string"}, start)
