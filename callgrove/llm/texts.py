"""Helpers for operators that read whole texts inside Arrow batches.

Words are handled as 64-bit hashes computed with numpy over the UTF-8 bytes of a text, so no string
object per word is made.  A text is worked off in slices of about one megabyte that end between words,
which keeps the memory of a task independent of the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE = 1 << 20
BATCH_ROWS = 500
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
         "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any bits of the result may serve as a hash."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def byte_table(word: Callable[[int], bool], lower: bool = True) -> np.ndarray:
    """For each byte, the byte that stands for it inside words (A-Z lower-cased with ``lower``) plus one, or 0 between words."""
    return np.array([(ord(chr(b).lower()) if lower and 65 <= b <= 90 else b) + 1 if word(b) else 0 for b in range(256)], dtype=np.uint16)


#: Words between white space (the second keeps upper case); words of ASCII letters and digits and all other characters above ASCII.
SPACED = byte_table(lambda b: b != 32 and not 9 <= b <= 13)
CASED = byte_table(lambda b: b != 32 and not 9 <= b <= 13, lower=False)
ALNUM = byte_table(lambda b: b >= 128 or chr(b).isalnum())

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = np.full(max(n, 1 << 14), _BASE if which == "up" else _UNBASE, np.uint64)
        base[0] = 1
        _powers[which] = np.cumprod(base)
    return _powers[which][:n]


def _slice_hashes(codes: np.ndarray) -> np.ndarray:
    inside = np.concatenate(([False], codes > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * _power("up", len(codes)))))
    return mix((total[ends] - total[starts]) * _power("down", len(codes))[starts] + (ends - starts).astype(np.uint64))


def slices(text: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where slices of about ``SLICE`` bytes begin and end; none ends inside a word."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            gap = np.flatnonzero(table[text[at:end]] == 0)
            while not len(gap) and end < len(text):  # one word fills the slice
                end = min(end + SLICE, len(text))
                gap = np.flatnonzero(table[text[at:end]] == 0)
            end = at + int(gap[-1]) + 1 if len(gap) and end < len(text) else end
        yield at, end
        at = end


def word_hashes(text: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word of a text given as UTF-8 bytes; equal words have equal hashes."""
    if len(text) <= SLICE:
        return _slice_hashes(table[text])
    return np.concatenate([_slice_hashes(table[text[a:b]]) for a, b in slices(text, table)])


def utf8(value: pa.StringScalar) -> np.ndarray:
    """Bytes of an Arrow text without a copy; null counts as empty."""
    buffer = value.as_buffer() if value.is_valid else None
    return np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering Spark's default of 10,000 rows in an Arrow batch to ``BATCH_ROWS``: whole texts are
    long, and a task holds a batch in the JVM and in Python at once.  A number set by the user stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def map_rows(df: DataFrame, keep: list[str], column: str, fields: dict[str, str], start: Callable[[], Callable]) -> DataFrame:
    """Columns ``keep`` plus ``fields`` (name to type), computed row by row from ``column``.

    ``start`` is called once in each task and returns the function of one Arrow value that gives a
    tuple, so models are built once per task and nothing is shared between tasks.
    """
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
    types = [ARROW[t] for t in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            rows = [f(v) for v in batch.column(column)]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, [*keep, *fields])

    return small_batches(df).select(*dict.fromkeys([*keep, column])).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, start: Callable[[], Callable]) -> DataFrame:
    """Rows of ``df``, all columns, for whose ``column`` the function that ``start`` returns is true."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            yield batch.filter(pa.array([bool(f(v)) for v in batch.column(column)], pa.bool_()))

    return small_batches(df).mapInArrow(run, df.schema)


def change_rows(df: DataFrame, column: str, start: Callable[[], Callable]) -> DataFrame:
    """``df`` with ``column`` replaced by what the function that ``start`` returns makes of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            at = batch.schema.get_field_index(column)
            made = pa.array([f(v) for v in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), made)

    return small_batches(df).mapInArrow(run, df.schema)
