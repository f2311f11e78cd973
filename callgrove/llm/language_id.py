"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point, so every task draws the same one.
A trigram binds the permuted vectors of its letters by products; a text bundles its trigrams by adding
them up; a language's prototype is the mean of the unit vectors of its texts.  A text gets the language
whose prototype has the largest cosine.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all texts when
nothing was learned; texts of any length are read in full; equal cosines go to the name that sorts first;
repeated rows are judged one by one; an empty table gives an empty table.  Rows with a null language teach
nothing.  Only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrove.llm.texts import SLICE, keep_rows, map_rows, small_batches

UNKNOWN = "und"
MEASURES = LANGUAGE, COSINE, TRIGRAMS = "__language", "__cosine", "__trigrams"


class Bundler:
    """Bundled vector of a text's trigrams over lower-case letters and word gaps."""

    def __init__(self, size: int = 1024, seed: int = 7, most_cached: int = 20_000):
        self.size, self.seed, self.most_cached = size, seed, most_cached
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}  # the row of each trigram in the table
        self.table = np.empty((0, size), np.int8)
        self.kind = np.zeros(0x110000, np.int8)  # of each code point: 0 not asked yet, 1 a letter, 2 none

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.size, dtype=np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def _grams(self, keys: list[int]) -> np.ndarray:
        """The vectors of distinct trigrams, one row for each."""
        at = list(map(self.rows.get, keys))
        if (missing := at.count(None)) and len(self.rows) + missing > self.most_cached:
            self.rows.clear()
            at = [None] * len(keys)
        for i, k in enumerate(keys) if missing else ():
            if at[i] is None:
                a, b, c = k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF
                at[i] = self.rows[k] = len(self.rows)
                if at[i] >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty((max(256, len(self.table)), self.size), np.int8)])
                self.table[at[i]] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
        return self.table[at]

    def bundle(self, text: str) -> np.ndarray | None:
        """None if the text has no letter."""
        return self.measure(text)[0]

    def measure(self, text: str) -> tuple[np.ndarray | None, int]:
        """The bundled vector and the number of trigrams."""
        out, n, text = np.zeros(self.size), 0, text.lower()
        last = np.array([32])  # the codes before the next trigram's last one
        for at in range(0, len(text) + 1, SLICE):
            codes = np.frombuffer(text[at:at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
            new = np.unique(codes[self.kind[codes] == 0])
            self.kind[new] = [1 if chr(c).isalpha() else 2 for c in new.tolist()]
            codes = np.concatenate([last, np.where(self.kind[codes] == 1, codes, 32), [32] * (at + SLICE > len(text))]).astype(np.int64)
            codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
            last = codes[-2:]
            if len(codes) < 3:
                continue
            n += len(codes) - 2
            keys, counts = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
            for i in range(0, len(keys), 4096):
                block = self._grams(keys[i:i + 4096].tolist()).astype(np.float32)
                out += counts[i:i + 4096].astype(np.float32) @ block
        return (out, n) if n else (None, 0)


def _sums(df: DataFrame, text: str, lang: str, size: int, seed: int) -> DataFrame:
    """Sum of the unit vectors of each language and place in the vector; each task sends one row for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(size, seed), {}
        for batch in batches:
            for v, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (x := bundler.bundle(v.as_py())) is not None and (norm := np.linalg.norm(x)):
                    sums[name] = sums.get(name, 0) + x / norm
        for name, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * size), pa.array(range(size), pa.int32()), pa.array(x)], ["lang", "at", "value"])

    found = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return small_batches(found).mapInArrow(run, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", size: int = 1024, seed: int = 7) -> dict[str, np.ndarray]:
    """Prototypes of the languages in ``lang``, learned from every text that has one.

    What comes to the driver is one vector for each language.
    """
    out: dict[str, np.ndarray] = {}
    for r in _sums(df, text, lang, size, seed).collect():
        out.setdefault(r["lang"], np.zeros(size))[r["at"]] = r["value"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v))}


def measure(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", seed: int = 7) -> DataFrame:
    """``df`` with the language of its texts, their cosine and number of trigrams, as ``MEASURES``."""
    judge = _judge(prototypes, seed)
    return map_rows(df, df.columns, text, dict(zip(MEASURES, ("string", "double", "bigint"))), lambda: judge(sized=True))


def learn_bounds(measured: DataFrame, share: float, lang: str = "lang", least_texts: int = 100) -> list[float]:
    """The least cosine of a text by powers of two of its trigrams: ``share`` of the median of learned texts of that size.

    Every text of ``measured`` with a language counts.  Sizes with fewer than ``least_texts`` texts are joined with the next
    larger ones, the largest with those before; with fewer texts in all there are no bounds.  What comes to the driver is one
    count for each size and thousandth.
    """
    found = measured.where(F.col(lang).isNotNull() & (F.col(TRIGRAMS) > 0))
    rows = found.groupBy(_bits(F.col(TRIGRAMS)).alias("_size"), F.rint(1000 * F.col(COSINE)).cast("int").alias("_cosine")).count().collect()
    groups: list[tuple[list[int], Counter]] = []
    for size in range(1, max((r["_size"] for r in rows), default=0) + 1):
        if not groups or groups[-1][1].total() >= least_texts:
            groups.append(([], Counter()))
        groups[-1][0].append(size)
        groups[-1][1].update({r["_cosine"]: r["count"] for r in rows if r["_size"] == size})
    if len(groups) > 1 and groups[-1][1].total() < least_texts:
        sizes, counts = groups.pop()
        groups[-1][0].extend(sizes)
        groups[-1][1].update(counts)
    if not groups or groups[-1][1].total() < least_texts:
        return []
    out = [0.0]
    for sizes, counts in groups:
        cosines = sorted(counts.elements())
        out += [share * cosines[len(cosines) // 2] / 1000] * len(sizes)
    return out


def _judge(prototypes: dict[str, np.ndarray], seed: int):
    """A function that starts a judge of one text in a task: the language and its cosine, with ``sized`` its trigrams, too."""
    names = sorted(prototypes)
    table = np.stack([prototypes[n] for n in names]) if names else None

    def start(sized: bool = False):
        bundler = Bundler(table.shape[1], seed) if names else None

        def judge(value):
            x, n = bundler.measure(value.as_py()) if names and value.is_valid else (None, 0)
            if x is None or not (norm := math.sqrt(x @ x)):
                return (UNKNOWN, 0.0, n)[:2 + sized]
            cosines = table @ x / norm
            best = int(np.argmax(cosines))
            return (names[best], float(min(1.0, max(0.0, cosines[best]))), n)[:2 + sized]

        return judge

    return start


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             seed: int = 7) -> DataFrame:
    """Adds lang_pred and score, the cosine with its prototype (0 if negative), one row per row of ``df``."""
    return map_rows(df, list(keep), text, {"lang_pred": "string", "score": "double"}, _judge(prototypes, seed))


def least_cosine(trigrams: int, bounds: Sequence[float], short: int = 128) -> float:
    """The bound of a text; below ``short`` trigrams it falls with their number, as few of them say little."""
    return bounds[min(trigrams.bit_length(), len(bounds) - 1)] * min(1.0, trigrams / short)


def keep_identified(df: DataFrame, prototypes: dict[str, np.ndarray], least: float, text: str = "text", seed: int = 7, bounds: Sequence[float] = ()) -> DataFrame:
    """Rows of ``df``, all columns, whose text has a language with a cosine of at least ``least``, or of its size's bound if there are ``bounds``.

    With no prototypes nothing can be told and all texts with a letter are kept.
    """
    judge = _judge(prototypes, seed)

    def start():
        if not prototypes:
            return lambda value: value.is_valid and any(map(str.isalpha, value.as_py()))
        one = judge(sized=True)

        def keep(value):
            name, score, n = one(value)
            return name != UNKNOWN and score >= (least_cosine(n, bounds) if bounds else least)

        return keep

    return keep_rows(df, text, start)


def keep_measured(measured: DataFrame, least: float, bounds: Sequence[float] = (), short: int = 128) -> DataFrame:
    """``keep_identified`` of rows that ``measure`` gave; its columns go."""
    bound, n = F.lit(least), F.col(TRIGRAMS)
    if bounds:
        size = F.least(_bits(n), F.lit(len(bounds) - 1))
        bound = F.element_at(F.array(*map(F.lit, bounds)), size + 1) * F.least(F.lit(1.0), n / F.lit(float(short)))
    return measured.where((F.col(LANGUAGE) != UNKNOWN) & (F.col(COSINE) >= bound)).drop(*MEASURES)


def _bits(n: Column) -> Column:
    """The number of binary digits; none for 0."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def held_out(key: str = "doc_id") -> Column:
    """Every fourth row by checksum of its id is kept from learning; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
