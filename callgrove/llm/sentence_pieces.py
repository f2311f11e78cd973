"""Encoding and decoding with a public SentencePiece BPE model, by vectorised merge rounds.

Texts are flat arrays of code points.  They are cut wherever no piece of the model holds the two
neighbouring characters, since no merge can cross such a place; the parts are called words here, and each
distinct word of a slice is worked off once.  In a round every word finds the least rank among its pairs of
symbols, merges all places of that rank from the left at once, and the arrays are compacted; words without a
pair leave.  The library merges one place at a time: a place after which a new pair of the same or a lower
rank appears is therefore the last one of its word in that round.  Words that have pairs left after
``ROUNDS`` rounds (very long runs) are finished one merge at a time from a heap, with the same result.

The model is read on the driver, checked against ``most_pieces`` and sent to the tasks.  Texts are worked off
in slices of about a megabyte, however long they are.

Defined results: null and empty texts have no ids, and no ids give an empty text; characters without a piece
become bytes; equal ranks go to the left; repeated rows are encoded one by one; an empty table gives an empty
table.  Only the named columns are read, so further columns never clash.  Invalid bytes decode to U+FFFD
each; ids outside the model raise.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from callgrove.llm.texts import SLICE, mix, small_batches, utf8

SPACE = "▁"
ROUNDS = 100
_FAR = np.int32(1 << 30)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _one_byte(error):
    return "�", error.start + 1


codecs.register_error("each_byte", _one_byte)


@dataclass
class Model:
    """Tables of a model: symbols are the pieces that merges can make, and the characters in them."""
    char: np.ndarray  # symbol of each code point, -1 if no piece holds it
    piece: np.ndarray  # id of each symbol's piece, -1 if it has none
    keys: np.ndarray  # pairs of symbols that make a piece, sorted
    made: np.ndarray  # symbol of the piece that a pair makes
    ranks: np.ndarray  # its rank; the lowest is merged first
    soonest: np.ndarray  # the lowest rank of a pair with each symbol
    inner: np.ndarray  # for each code point its row in ``beside``, 0 if no longer piece holds it
    beside: np.ndarray  # whether two characters stand side by side in a piece
    bytes_: np.ndarray  # id of each byte's piece
    text: np.ndarray  # UTF-8 of all pieces, with spaces
    begin: np.ndarray  # where the piece of an id begins in ``text``
    size: np.ndarray
    control: np.ndarray
    spaced: np.ndarray  # begins with a space that is dropped at the start of a text

    @property
    def symbols(self) -> int:
        return len(self.piece)


def read_model(path: str | None = None, most_pieces: int = 1_000_000) -> Model:
    """The tables of a BPE model with byte fallback that takes texts as they are, with a space put before them."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path or default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    norm, kinds = proto.normalizer_spec, [p.type for p in proto.pieces]
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    if proto.trainer_spec.model_type != 2 or not plain or proto.trainer_spec.treat_whitespace_as_suffix or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("only BPE models that leave texts unchanged but for a space before them are supported")
    if len(kinds) > most_pieces or kinds.count(_BYTE) != 256:
        raise ValueError(f"the model has {len(kinds)} pieces, {kinds.count(_BYTE)} of them bytes; at most {most_pieces} and 256 are expected")

    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
    symbol = {s: k for k, s in enumerate([*ids, *sorted({c for s in ids for c in s} - ids.keys())])}
    scores = np.array([-proto.pieces[i].score for i in ids.values()])
    rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
    pairs = {(symbol[s[:i]] * len(symbol) + symbol[s[i:]]): symbol[s] for s in ids for i in range(1, len(s)) if s[:i] in symbol and s[i:] in symbol}
    keys = np.array(sorted(pairs), np.int64)
    made = np.array([pairs[k] for k in keys.tolist()], np.int32)
    soonest = np.full(len(symbol), _FAR, np.int32)
    for part in (keys // len(symbol), keys % len(symbol)):
        np.minimum.at(soonest, part, rank[made])

    char = np.full(0x110000, -1, np.int32)
    for s, k in symbol.items():
        if len(s) == 1:
            char[ord(s)] = k
    inner = np.zeros(0x110000, np.int32)
    for k, c in enumerate(sorted({c for s in ids if len(s) > 1 for c in s}), 1):
        inner[ord(c)] = k
    beside = np.zeros((inner.max() + 1,) * 2, bool)
    for s in ids:
        for a, b in zip(s, s[1:], strict=False):
            beside[inner[ord(a)], inner[ord(b)]] = True

    def shown(p) -> bytes:
        if p.type == _BYTE:
            return bytes([int(p.piece[1:-1], 16)])
        if p.type == _CONTROL:
            return b""
        return proto.trainer_spec.unk_surface.encode() if p.type == _UNKNOWN else p.piece.replace(SPACE, " ").encode()

    texts = [shown(p) for p in proto.pieces]
    size = np.array([len(t) for t in texts], np.int64)
    bytes_ = np.zeros(256, np.int32)
    for i, p in enumerate(proto.pieces):
        if p.type == _BYTE:
            bytes_[texts[i][0]] = i
    return Model(char, np.array([ids.get(s, -1) for s in symbol], np.int32), keys, made, rank[made], soonest, inner, beside, bytes_,
                 np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size,
                 np.array([k == _CONTROL for k in kinds]), np.array([p.type == _NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]))


def _lookup(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (``_FAR`` if it makes no piece) and the symbol it makes."""
    key = left.astype(np.int64) * model.symbols + right
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    hit = (model.keys[at] == key) & (left >= 0) & (right >= 0)
    return np.where(hit, model.ranks[at], _FAR), model.made[at]


def _from_heap(model: Model, symbols: list[int]) -> list[int]:
    """Which symbols stay, as pairs of place and symbol, when the pairs of one word are merged one at a time."""
    n = len(symbols)
    after, before, heap = [*range(1, n), -1], list(range(-1, n - 1)), []
    table: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i: int) -> None:
        j = after[i]
        if i < 0 or j < 0:
            return
        pair = symbols[i], symbols[j]
        if pair not in table:
            rank, made = _lookup(model, np.array(pair[:1]), np.array(pair[1:]))
            table[pair] = int(rank[0]), int(made[0])
        if table[pair][0] < _FAR:
            heapq.heappush(heap, (table[pair][0], i, pair))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue
        symbols[i], symbols[j], after[i] = table[pair][1], -2, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return symbols


def _merge(model: Model, symbol: np.ndarray, word: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that stay when no pair is left, and where they stood; ``word`` numbers the word of each symbol, in order."""
    place = np.arange(len(symbol))
    rank, made = _lookup(model, symbol, np.append(symbol[1:], -1))
    rank[np.append(word[:-1] != word[1:], True)] = _FAR
    kept_symbol, kept_place = [], []
    for _ in range(rounds):
        if not len(symbol):
            break
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
        open_ = least < _FAR
        if not open_.all():
            kept_symbol.append(symbol[~open_])
            kept_place.append(place[~open_])
            symbol, place, word, rank, made, least = (x[open_] for x in (symbol, place, word, rank, made, least))
            if not len(symbol):
                break
        at = np.flatnonzero(rank == least)
        run = np.maximum.accumulate(np.where(np.append(True, np.diff(at) != 1), np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]  # of overlapping places the first, third, ...
        sooner = np.flatnonzero(model.soonest[made[at]] <= least[at])
        if len(sooner):
            sooner = sooner[_sooner(model, symbol, word, at, made[at], least[at], sooner)]
        if len(sooner):  # what follows in the word waits for the new pair
            own, mark = word[at], np.zeros(len(at), np.int64)
            mark[sooner] = 1
            seen = np.cumsum(mark) - mark
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            at = at[seen == np.repeat(seen[first], np.diff(np.append(first, len(own))))]
        symbol[at] = made[at]
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        changed = np.cumsum(stay)[at] - 1
        symbol, place, word, rank, made = (x[stay] for x in (symbol, place, word, rank, made))
        touched = np.zeros(len(symbol), bool)
        touched[changed] = touched[np.maximum(changed - 1, 0)] = True
        changed = np.flatnonzero(touched)
        beyond = np.minimum(changed + 1, len(symbol) - 1)
        rank[changed], made[changed] = _lookup(model, symbol[changed], symbol[beyond])
        rank[changed[(beyond == changed) | (word[beyond] != word[changed])]] = _FAR
    if len(symbol):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(word)], strict=True):
            left = np.array(_from_heap(model, symbol[a:b].tolist()), np.int32)
            kept_symbol.append(left[left != -2])
            kept_place.append(place[a:b][left != -2])
    if not kept_symbol:
        return symbol, place
    symbol, place = np.concatenate(kept_symbol), np.concatenate(kept_place)
    order = np.argsort(place, kind="stable")
    return symbol[order], place[order]


def _sooner(model: Model, symbol: np.ndarray, word: np.ndarray, at: np.ndarray, new: np.ndarray, limit: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Whether the merges numbered ``ask`` make a pair that comes before the next place of the same rank."""
    here, own = at[ask], word[at[ask]]
    before = np.maximum(here - 1, 0)
    joined = (ask > 0) & (at[np.maximum(ask - 1, 0)] == here - 2)
    left = np.where(joined, new[np.maximum(ask - 1, 0)], symbol[before])
    left = np.where((here > 0) & (word[before] == own), left, -1)
    beyond = np.minimum(here + 2, len(symbol) - 1)
    right = np.where((here + 2 < len(symbol)) & (word[beyond] == own), symbol[beyond], -1)
    return (_lookup(model, left, new[ask])[0] <= limit[ask]) | (_lookup(model, new[ask], right)[0] <= limit[ask])


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _words(model: Model, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin: at ``starts``, and between characters that stand side by side in no piece."""
    row = model.inner[codes]
    cut = np.append(True, ~model.beside[row[:-1], row[1:]]) if len(codes) else np.zeros(0, bool)
    cut[starts] = True
    return np.flatnonzero(cut)


def _distinct(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word for each distinct content, and its number for every word."""
    power = np.full(max(int(size.max(initial=1)), 1), _BASE)
    power[0] = 1
    power = np.cumprod(power)
    value = mix(codes.astype(np.uint64) + np.uint64(1)) * power[_gather(np.zeros(len(size), np.int64), size)]
    name = mix(np.add.reduceat(value, begin) + size.astype(np.uint64))
    _, first, number = np.unique(name, return_index=True, return_inverse=True)
    same = size[first][number] == size
    if same.all():
        same = codes[_gather(begin[first][number], size)] == codes
    if not same.all():  # two words share a hash: each counts as its own
        return np.arange(len(size)), np.arange(len(size))
    return first, number


def _utf8_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of UTF-8 bytes of each code point, and the bytes."""
    raw = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    return size, np.frombuffer(raw, np.uint8)


def encode_codes(model: Model, codes: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts of which all code points stand in ``codes`` and which begin at ``starts``, and the number of ids of each."""
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
    begin = _words(model, codes, starts[starts < len(codes)])
    size = np.diff(np.append(begin, len(codes)))
    first, number = _distinct(codes, begin, size)
    chosen = codes[_gather(begin[first], size[first])]
    word = np.repeat(np.arange(len(first)), size[first])
    symbol, place = _merge(model, model.char[chosen], word, rounds)

    piece = np.where(symbol >= 0, model.piece[symbol], -1)
    bare = piece < 0
    lengths, raw = _utf8_of(chosen[place[bare]])
    width = np.ones(len(piece), np.int64)
    width[bare] = lengths
    tokens = np.repeat(piece, width)
    tokens[np.repeat(bare, width)] = model.bytes_[raw]
    per_word = np.zeros(len(first), np.int64)
    np.add.at(per_word, word[place], width)
    at = np.cumsum(per_word) - per_word
    ids = tokens[_gather(at[number], per_word[number])]
    upto = np.append(0, np.cumsum(per_word[number]))
    edge = upto[np.searchsorted(begin, np.append(starts, len(codes)))]
    return ids, np.diff(edge)


def _pieces_of(model: Model, text: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Code points of a text, a space before it, in slices that end between words."""
    at, tail = 0, np.array([ord(SPACE)], np.uint32)
    while at < len(text):
        end = min(at + width, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        codes = np.frombuffer(text[at:end].tobytes().decode().encode("utf-32-le"), np.uint32)
        codes = np.concatenate((tail, np.where(codes == 32, np.uint32(ord(SPACE)), codes)))
        at, tail = end, codes[:0]
        if end < len(text):
            cut = int(_words(model, codes, np.zeros(1, np.int64))[-1])
            codes, tail = codes[:cut], codes[cut:]
        if len(codes):
            yield codes


def encode_texts(model: Model, texts: list[np.ndarray], width: int = SLICE, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Ids of each text, given as UTF-8 bytes."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        sizes = np.array([len(codes) for _, codes in held], np.int64)
        ids, counts = encode_codes(model, np.concatenate([codes for _, codes in held]), np.cumsum(sizes) - sizes, rounds)
        for (k, _), part in zip(held, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            out[k].append(part)
        held.clear()

    waiting = 0
    for k, text in enumerate(texts):
        for codes in _pieces_of(model, text, width):
            held.append((k, codes))
            waiting += len(codes)
            if waiting >= width:
                flush()
                waiting = 0
    if held:
        flush()
    return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]


def decode_ids(model: Model, ids: np.ndarray) -> str:
    """The text of a sequence of ids."""
    if not len(ids):
        return ""
    if ids.min() < 0 or ids.max() >= len(model.size):
        raise ValueError("an id is not in the model")
    control = model.control[ids]
    drop = int(model.spaced[ids[np.argmin(control)]])
    parts = [ids] if not control.any() else np.split(ids, np.flatnonzero(control))  # bytes before and after one are apart
    raw = (model.text[_gather(model.begin[x], model.size[x])].tobytes() for x in parts)
    return "".join(x.decode("utf-8", "each_byte") for x in raw)[drop:]


def encode(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "ids") -> DataFrame:
    """Columns ``keep`` and the ids of every whole text, one row per row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encode_texts(shared.value, [utf8(v) for v in batch.column(text)])
            offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            column = pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], [*keep, name])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.ArrayType(T.IntegerType()))])
    return small_batches(df).select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(df: DataFrame, model: Model, ids: str = "ids", name: str = "text") -> DataFrame:
    """``df`` with a column ``name``: the text of the ids; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            made = [decode_ids(shared.value, v.values.to_numpy(zero_copy_only=False)) if v.is_valid else None for v in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(made, pa.string())], [*(f.name for f in kept), name])

    return df.select(*[f.name for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(name, T.StringType())]))
