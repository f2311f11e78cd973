"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are sequences of words (letters and digits, lower-cased).  A window of ``span`` words
begins at every word of an item; a window of m words with a budget of k edits is cut into k + 1 pieces, so
a passage within the budget holds at least one piece unchanged.  Texts are searched for the pieces' first
words by hash; each hit is verified on the words around it with Myers' bit-parallel edit distance.  With
the default 24 words and 4 edits every unchanged passage of 20 words of a longer item is found, and every
passage of 24 words with up to 4 edits, wherever it begins; shorter passages of longer items are not.

Pieces that many items share cost little: equal windows are one, a window of which the text lacks more words
than may be edited is never verified, an alignment is verified once however many pieces lead to it, and
alignments are verified many at a time, their bit vectors in one array.

Windows are no rows: of an item the words and the places of its pieces are held.  Items are collected on the
driver in blocks of at most ``block_items`` items and ``block_chars`` characters and sent to the tasks; a
larger benchmark is worked off in several passes, so its size is not limited.

Defined results: null and empty texts match nothing, and so do items without a word; items with fewer than
``least`` words match as a whole and without an edit, a single word wherever it stands; texts of any length are searched in full; of equal
distances the first place counts; repeated rows are judged one by one, repeated items (id and text) count
once, and different texts of one id are items of their own; an empty table gives an empty table, an empty benchmark no matches.  Other columns of ``df`` pass
through the filter as they are; the search reads only the named ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrove.llm.texts import ALNUM, keep_rows, map_rows, mix, utf8, word_hashes
from callgrove.plans.scratch import materialize

GRAM = 4
#: Alignments verified at a time.
CHUNK = 1 << 16
#: Alignments that begin at one word, from which on their words are counted first.
MANY = 32
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _words(value) -> np.ndarray:
    return word_hashes(utf8(pc.utf8_lower(value)), ALNUM) if value.is_valid else np.zeros(0, np.uint64)


def _grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of each run of ``size`` words, GRAM at most."""
    n = len(words) - size + 1
    return mix(sum((words[i:n + i] * _STEPS[i] for i in range(1, size)), words[:n] * _STEPS[0])) if n > 0 else np.zeros(0, np.uint64)


def _budget(m: int, rate: float) -> int:
    return min(int(rate * m), max(0, m // GRAM - 1))


def _pieces(m: int, budget: int) -> list[int]:
    """Where the pieces of a window of ``m`` words begin."""
    return [i * m // (budget + 1) for i in range(budget + 1)]


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def edit_distances(patterns: np.ndarray, sizes: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least number of word edits from each row of ``patterns`` (its first ``sizes`` words) to any stretch of words low to high, and
    where the first such stretch ends: Myers' bit vectors, one for each row, all rows word by word at once."""
    width = -(-patterns.shape[1] // 8)
    bits = np.zeros((len(sizes), 8), np.uint8)
    full, top = (np.int64(1) << sizes) - 1, np.int64(1) << sizes - 1
    up, down, score = full.copy(), np.zeros_like(full), sizes.copy()
    best, end = score.copy(), low.copy()
    for j in range(int((high - low).max(initial=0))):
        here = np.minimum(low + j, len(words) - 1)
        bits[:, :width] = np.packbits(patterns == words[here][:, None], axis=1, bitorder="little")
        eq = bits.view(np.int64)[:, 0] & full
        d0 = ((eq & up) + up ^ up) | eq | down
        right = down | full & ~(d0 | up)
        left = d0 & up
        score = score + ((right & top) != 0) - ((left & top) != 0)
        right, left = right << 1 & full, left << 1 & full
        up = left | full & ~(d0 | right)
        down = right & d0
        better = (score < best) & (low + j < high)
        best, end = np.where(better, score, best), np.where(better, low + j + 1, end)
    return best, end


class Matcher:
    """Searches texts for the windows of items.  Equal windows, of one item or of many, are one."""

    def __init__(self, items: list[tuple[int, np.ndarray]], span: int, rate: float, least: int):
        if span > 60:
            raise ValueError("a window has at most 60 words")
        self.ids = [i for i, _ in items]
        sizes = np.array([len(words) for _, words in items], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *(words for _, words in items)])
        self.at = np.cumsum(sizes) - sizes  # where the words of each item begin
        self.sizes = np.where(sizes < least, sizes, np.minimum(sizes, span))
        self.budgets = np.array([0 if n < least else _budget(m, rate) for n, m in zip(sizes.tolist(), self.sizes.tolist(), strict=True)], np.int64)
        self.short: dict[int, dict[int, list[int]]] = {}  # items of fewer than GRAM words, by size and hash
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < GRAM:
                self.short.setdefault(len(words), {}).setdefault(int(_grams(words, len(words))[0]), []).append(k)
        long = np.flatnonzero(sizes >= GRAM)
        self.number = np.where(sizes >= GRAM, sizes - self.sizes + 1, 0)  # of windows
        self.window = np.cumsum(self.number) - self.number  # the first one of each item

        self.owner = np.repeat(np.arange(len(items)), self.number)
        self.start = _gather(self.at, self.number)  # of each window, in words
        own = self.sizes[self.owner]
        name = own.astype(np.uint64)
        for j in range(int(own.max(initial=0))):
            name = np.where(j < own, mix(name * _STEPS[0] + self.words[np.minimum(self.start + j, len(self.words) - 1)]), name)
        _, self.shown, self.kind = np.unique(name, return_index=True, return_inverse=True)  # a window of each content, and the content of each
        self.alike = np.argsort(self.kind, kind="stable")  # windows by content
        self.begins_alike = np.searchsorted(self.kind[self.alike], np.arange(len(self.shown) + 1))

        pieces = [_pieces(m, b) for m, b in zip(self.sizes.tolist(), self.budgets.tolist(), strict=True)]
        self.begins = np.full((len(items), max(map(len, pieces), default=1)), -1, np.int64)
        for k, p in enumerate(pieces):
            self.begins[k, :len(p)] = p
        grams, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k in long.tolist():
            at = np.unique(np.add.outer(np.arange(self.number[k]), pieces[k])).astype(np.int32)
            grams.append(_grams(items[k][1])[at])
            item.append(np.full(len(at), k, np.int32))
            place.append(at)
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        self.item, self.place = np.concatenate(item)[order], np.concatenate(place)[order]
        self.keys, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))

    def find(self, value, any_one: bool = False) -> list[tuple[int, int, int]]:
        """Item number, edits and word where the match ends, best of each item; with ``any_one`` one match is enough."""
        words = _words(value)
        best: dict[int, tuple[int, int]] = {}
        for size, items in self.short.items():
            grams = _grams(words, size)
            at = np.flatnonzero(np.isin(grams, np.array(list(items), np.uint64)))
            for gram, first in zip(*np.unique(grams[at], return_index=True), strict=True):
                best.update((k, (0, int(at[first]) + size)) for k in items[int(gram)])
        grams = _grams(words)
        if len(grams) and len(self.keys) and not (any_one and best):
            near = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            hits = np.flatnonzero(self.keys[near] == grams)
            if len(hits):
                best.update(self._long(words, hits, near[hits], any_one))
        return [(i, e, end) for i, (e, end) in sorted(best.items())]

    def _possible(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the key, content and place in it of each piece that has one of ``keys`` and lies in a window of which the whole
        text lacks no more words than may be edited."""
        counts = self.first[keys + 1] - self.first[keys]
        entry = _gather(self.first[keys], counts)
        item, key = self.item[entry].astype(np.int64), np.repeat(np.arange(len(keys)), counts)
        begins = self.begins[item]
        s = self.place[entry][:, None] - begins
        open_ = (begins >= 0) & (s >= 0) & (s < self.number[item][:, None])
        asked = np.unique(item)
        size = self.number[asked] + self.sizes[asked] - 1
        known = np.unique(words)
        told = self.words[_gather(self.at[asked], size)]
        lacks = np.append(0, np.cumsum(known[np.minimum(np.searchsorted(known, told), len(known) - 1)] != told))
        here = (np.cumsum(size) - size)[np.searchsorted(asked, item)][:, None] + np.where(open_, s, 0)
        open_ &= lacks[here + self.sizes[item][:, None]] - lacks[here] <= self.budgets[item][:, None]
        row, piece = np.nonzero(open_)
        found = np.stack([key[row], self.kind[self.window[item[row]] + s[row, piece]], begins[row, piece]])
        return tuple(np.unique(found, axis=1)) if found.size else tuple(found)

    def _told(self, window: np.ndarray, size: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The words of windows as numbers in ``known``; its length stands for other words, and one more for what is behind a window."""
        told = np.full((len(window), int(size.max(initial=1))), len(known) + 1, np.int32)
        for j in range(told.shape[1]):
            rows = np.flatnonzero(size > j)
            word = self.words[self.start[window[rows]] + j]
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            told[rows, j] = np.where(known[at] == word, at, len(known))
        return told

    @staticmethod
    def _likely(kind: np.ndarray, begin: np.ndarray, told: np.ndarray, names: np.ndarray, known: int, size: np.ndarray, budget: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Alignments, in order of ``begin``, without those whose part of the text lacks more words than may be edited; asked where many begin."""
        edge = np.flatnonzero(np.append(True, begin[1:] != begin[:-1])) if len(begin) else np.zeros(0, np.int64)
        here, keep, reach = np.zeros(known + 2, np.int8), np.ones(len(kind), bool), int(budget.max(initial=0))
        here[known + 1] = 1
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(begin)], strict=True):
            if b - a >= MANY:
                near = names[max(0, begin[a] - reach):begin[a] + told.shape[1] + reach]
                here[near] = 1
                keep[a:b] = told.shape[1] - here[told[kind[a:b]]].sum(axis=1) <= budget[kind[a:b]]
                here[near] = 0
        return kind[keep], begin[keep]

    def _long(self, words: np.ndarray, hits: np.ndarray, near: np.ndarray, any_one: bool) -> dict[int, tuple[int, int]]:
        """Best match of each item of GRAM words or more; ``near`` are the keys that stand at words ``hits``."""
        keys, which = np.unique(near, return_inverse=True)
        key, kind, inner = self._possible(words, keys)
        first = np.searchsorted(key, np.arange(len(keys) + 1))
        counts = (first[1:] - first[:-1])[which]
        hits, which, counts = hits[counts > 0], which[counts > 0], counts[counts > 0]
        kinds, local = np.unique(kind, return_inverse=True)
        window = self.shown[kinds]
        size, budget = self.sizes[self.owner[window]], self.budgets[self.owner[window]]
        known, names = np.unique(words, return_inverse=True)
        told = self._told(window, size, known)
        best = np.full(len(kinds), np.iinfo(np.int64).max)  # edits and end in one number
        part = np.cumsum(counts) // CHUNK
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.unique(part, return_index=True)[1], len(part))), strict=True):
            row = _gather(first[which[a:b]], counts[a:b])
            begin = np.repeat(hits[a:b], counts[a:b]) - inner[row]
            pair = np.sort((begin + 63) * len(kinds) + local[row])
            pair = pair[np.append(True, pair[1:] != pair[:-1])]  # other pieces lead to the same alignment
            k, begin = pair % len(kinds), pair // len(kinds) - 63
            open_ = best[k] >> 40 != 0  # an unchanged match is not bettered by later ones
            k, begin = self._likely(k[open_], begin[open_], told, names, len(known), size, budget)
            for c in range(0, len(k), CHUNK >> 3):
                i, at = k[c:c + (CHUNK >> 3)], begin[c:c + (CHUNK >> 3)]
                edits, end = edit_distances(told[i], size[i], names, np.maximum(at - budget[i], 0), np.minimum(at + size[i] + budget[i], len(words)))
                hit = edits <= budget[i]
                np.minimum.at(best, i[hit], (edits << 40 | end)[hit])
            if any_one and (best < np.iinfo(np.int64).max).any():
                break
        found = np.flatnonzero(best < np.iinfo(np.int64).max)
        size = self.begins_alike[kinds[found] + 1] - self.begins_alike[kinds[found]]
        item = self.owner[self.alike[_gather(self.begins_alike[kinds[found]], size)]]
        value, out = np.repeat(best[found], size), {}
        order = np.lexsort((value, item))
        for k, v in zip(item[order].tolist(), value[order].tolist(), strict=True):
            out.setdefault(k, (v >> 40, v & (1 << 40) - 1))
        return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_items: int, block_chars: int):
    """Items of the benchmark as word hashes, block by block; repeated ones are dropped before blocks are counted and dealt."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    rows = materialize(rows.distinct(), "benchmark")
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_items), math.ceil(chars / block_chars))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        yield sorted(((r["item"], _words(pa.scalar(r["text"], pa.string()))) for r in part), key=lambda x: (x[0] is None, x[0], len(x[1]), x[1].tolist()))


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id",
               item_text: str = "text", span: int = 24, rate: float = 0.2, least: int = 8,
               block_items: int = 20_000, block_chars: int = 8_000_000) -> DataFrame:
    """One row for each row of ``df`` and item it holds a passage of: item, edits, end_word (where the passage ends)."""
    out, kind = None, benchmark.schema[item].dataType.simpleString()
    for items in _blocks(benchmark, item, item_text, block_items, block_chars):
        def start(items=items):
            matcher = Matcher(items, span, rate, least)
            names = [None if i is None else str(i) for i in matcher.ids]

            def judge(value):
                found = matcher.find(value)
                return [names[f[0]] for f in found], [f[1] for f in found], [f[2] for f in found]

            return judge

        hits = map_rows(df, list(keep), text, {"_item": "array<string>", "_edits": "array<bigint>", "_end": "array<bigint>"}, start)
        part = hits.select(*keep, F.explode(F.arrays_zip("_item", "_edits", "_end")).alias("_hit")).select(
            *keep, F.col("_hit._item").cast(kind).alias(item), F.col("_hit._edits").alias("edits"), F.col("_hit._end").alias("end_word"))
        out = part if out is None else out.unionByName(part)
    return out


def remove_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                 span: int = 24, rate: float = 0.2, least: int = 8, block_items: int = 20_000, block_chars: int = 8_000_000) -> DataFrame:
    """Rows of ``df`` that hold no passage of the benchmark."""
    for items in _blocks(benchmark, item, item_text, block_items, block_chars):
        def start(items=items):
            matcher = Matcher(items, span, rate, least)
            return lambda value: not matcher.find(value, any_one=True)

        df = keep_rows(df, text, start)
    return df
