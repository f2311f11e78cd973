"""Periodic runs, repaired conversations and sentence pieces against plain versions."""

import functools
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrove.llm import periodic_runs, sentence_pieces, turn_repair
from callgrove.llm.queries import R, damaged
from tests.llm.conftest import DOCUMENTS, documents, prose

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# periodic runs

def plain_runs(w, shortest=6, repeats=4):
    """Every stretch of equal words q apart, the smallest q of each."""
    found = {}
    codes = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if w else np.zeros(0, int)
    for q in range(1, len(w) // repeats + 1):
        same = np.concatenate(([False], codes[:-q] == codes[q:], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(shortest, repeats * q):
                found.setdefault((a, b - a + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapse(w, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repetitive(r, n):
    letters = "ab" if r.random() < 0.4 else "abcdefghij"
    w = []
    while len(w) < n:
        unit = [r.choice(letters) for _ in range(r.randint(1, max(1, n // 5)))] * (r.randint(2, 5) if r.random() < 0.3 else 1)
        w += unit * r.randint(1, 7) + [r.choice(letters) for _ in range(r.choice([0, 0, 3]))]
    return w[:n]


@pytest.mark.parametrize("tile", [16, 64, 1 << 13])
def test_runs_of_repetitive_texts(spark, tile):
    r = random.Random(tile)
    texts = [" ".join(repetitive(r, r.randint(0, 200))) for _ in range(60)] + [" ".join(["x"] * 3000), "\t".join((["a"] * 7 + ["b"]) * 300), "Ab ab " * 40, None, "", " \n "]
    df = spark.createDataFrame(documents(enumerate(texts + texts[:5])), DOCUMENTS).repartition(3)
    rows = periodic_runs.with_runs(df, tile=tile)
    assert set(rows.columns) == {*df.columns, "runs"}
    got = periodic_runs.collapse(rows.withColumn("best", periodic_runs.longest()), ["doc_id", "runs", "best"]).collect()
    assert len(got) == len(texts) + 5
    for x in got:
        w = cut((texts + texts[:5])[x.doc_id])
        want = plain_runs(w)
        assert [tuple(y) for y in x.runs] == want
        assert x.collapsed == plain_collapse(w, want)
        best = min(want, key=lambda y: (-y[1] / y[2], y[0], y[2]), default=None)
        assert (tuple(x.best) if x.best else None) == best


def test_runs_of_messy_documents(spark, messy):
    got = periodic_runs.with_runs(messy).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(x.doc_id) for x in messy.collect())
    assert all([tuple(y) for y in x.runs] == plain_runs(cut(x.text)) for x in got if len(x.text or "") < 100_000)
    assert periodic_runs.with_runs(messy.limit(0)).count() == 0
    far = [w for i in range(40) for w in prose(i % 13, 900).split()]  # a period of 11,700 words
    df = spark.createDataFrame([(1, " ".join(far * 2))], "doc_id int, text string")
    assert [tuple(y) for y in periodic_runs.with_runs(df).first().runs] == plain_runs(far * 2)


def test_long_words_and_slices():
    long = ("x" * 700_000 + " ") * 6 + "y"
    runs = plain_runs(long.split())
    assert periodic_runs.collapsed(np.frombuffer(long.encode(), np.uint8), runs).decode() == "x" * 700_000 + " y"


@needs_tables
def test_registered_runs_against_plain_ones(spark):
    got = {x.doc_id: x for x in R.jobs["op11_periodic_runs"](spark, SF).collect()}
    for doc, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = cut(text)
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda y: (-y[1] / y[2], y[0], y[2]), default=(None,) * 3)
        x = got.pop(doc)
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert x.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and x.collapsed_sha256 == sha(plain_collapse(w, runs))
    assert not got


# conversations

KEEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def plain_repair(rows):
    """Counts of faults, least cost, least letters and lines of (role, text) rows, over all edits."""
    kinds, seen = [], set()
    for role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        kinds.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))

    options = {}
    best = {(len(rows), s): (0, "") for s in ("", "a")}
    names = {"u": "user", "a": "assistant", "s": "system"}
    for i in range(len(rows), -1, -1):
        for s in ("", "s", "u", "a"):
            ways = [(*best[i, s], None)] if (i, s) in best else []
            if i < len(rows):
                ways.append((best[i + 1, s][0] + 4, "D" + best[i + 1, s][1], (i + 1, s, None)))
                if kinds[i] in ("", "truncated"):
                    more = 3 * (kinds[i] == "truncated")
                    for letter, initial, cost in (("K", rows[i][0][:1], 0), ("R", "u", 3), ("R", "a", 3)):
                        if (s, initial) in KEEP:
                            to = KEEP[s, initial]
                            ways.append((best[i + 1, to][0] + cost + more, letter + best[i + 1, to][1], (i + 1, to, (rows[i][0] if letter == "K" else names[initial], rows[i][1]))))
            options[i, s] = min(ways, key=lambda x: x[:2], default=(10**9, "", None))
        for _ in range(3):
            for s in ("", "s", "u", "a"):
                to = "a" if s == "u" else "u"
                way = (options[i, to][0] + 3, "I" + options[i, to][1], (i, to, (names[to], "")))
                options[i, s] = min(options[i, s], way, key=lambda x: x[:2])
        best.update({(i, s): options[i, s][:2] for s in ("", "s", "u", "a")})
    at, lines = (0, ""), []
    while options[at][2]:
        i, s, line = options[at][2]
        lines += [f"{line[0]}:{line[1]}"] if line else []
        at = (i, s)
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    return (*counts, sum(p not in ("su", "ua", "au") for p in pairs), *best[0, ""], sha("\n".join(lines)))


def grouped(rows):
    """Rows of (conv, turn, role, text) by conversation in order."""
    by = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2], x[3])):
        by.setdefault(c, []).append((t, role, text))
    return by


def gaps(turns):
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def checked(spark, rows, schema="conv_id int, turn int, role string, text string"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {x.conv: x for x in turn_repair.summarize(turn_repair.repair_conversations(df)).collect()}
    want = grouped([(r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows])
    assert got.keys() == want.keys()
    for c, x in got.items():
        assert (x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.sha256) == plain_repair([r[1:] for r in want[c]]), c
        assert x.gaps == gaps([r[0] for r in want[c]])


def some_rows(r, c, n):
    roles, texts = ["user", "assistant", "system", "tool", None], ["", " \t", "a.", "b!", "c", "d", "e?", None, "f.\n", "ü."]
    return [(c, r.choice([None, r.randint(0, 9), r.randint(0, 9)]), r.choice(roles[:r.choice([2, 3, 5])]), r.choice(texts)) for _ in range(n)]


def test_cheapest_edits_of_small_conversations(spark):
    r = random.Random(4)
    checked(spark, [x for c in [None, *range(150)] for x in some_rows(r, c, r.randint(1, 12))])


def test_conversations_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK", 3)
    r = random.Random(6)
    rows = [x for c in range(4) for x in some_rows(r, c, 5)] + some_rows(r, 7, 700) + [(8, k, "user" if k % 2 else "assistant", f"{k}." if k % 7 else f"{k}") for k in range(300)]
    rows += [(9, 1, "user", "same.")] * 200 + [(9, k, "user", "same.") for k in range(100)]
    seen = []
    monkeypatch.setattr(turn_repair, "_ends", lambda b, f=turn_repair._ends: seen.append(len(b)) or f(b))
    checked(spark, rows)


def test_checkpoints_are_few():
    rows = [turn_repair.Row("ua"[i % 2 if i % 5 else 0], False, i % 3 == 0, 1) for i in range(1000)]
    states = [0]
    edits = "".join(x[1] for x in turn_repair.walk(rows, turn_repair.END, states, True))
    assert states[-1] in (0, 3) and len(edits) >= 1000


def test_no_rows_and_other_columns(spark):
    schema = "conv_id string, turn bigint, role string, text string, audit int, conv int"
    assert turn_repair.summarize(turn_repair.repair_conversations(spark.createDataFrame([], schema))).count() == 0
    rows = turn_repair.repair_conversations(spark.createDataFrame([("x", 1, "user", "Hello.", 1, 2), ("x", 3, "user", "Yes", 1, 2)], schema))
    turns = turn_repair.repaired_turns(rows).orderBy("part", "number", "place").collect()
    assert [(t.conv, t.role, t.text) for t in turns] == [("x", "user", "Hello."), ("x", "assistant", "Yes")] and turn_repair.summarize(rows).first().audit == "KR"


@needs_tables
def test_registered_repair_against_plain_one(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = []
    for x in table.collect():
        say = lambda v: " " if v is None else v
        way = zlib.crc32(f"{say(x.conv_id)}:{say(x.turn)}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", say(x.text)) if way == 2 else say(x.text)
        rows += [(x.conv_id, x.turn, "user" if way == 4 else say(x.role), text)] * {0: 0, 3: 2}.get(way, 1)
    assert sorted(map(tuple, damaged(table).collect()), key=str) == sorted(rows, key=str)
    want = grouped(rows)
    got = R.jobs["op12_turn_repair"](spark, SF).collect()
    assert sorted(x.conv_id for x in got) == sorted({x.conv_id for x in table.collect()})
    for x in got:
        mine = want.get(x.conv_id, [])
        assert (x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired_sha256) == plain_repair([r[1:] for r in mine])
        assert x.gaps == gaps([r[0] for r in mine])


# sentence pieces

@functools.cache
def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=sentence_pieces.default_model()), sentence_pieces.read_model()


def same_as_library(texts, **settings):
    theirs, ours = library()
    got = sentence_pieces.encode_texts(ours, [np.frombuffer(t.encode(), np.uint8) for t in texts], **settings)
    for text, ids, want in zip(texts, got, theirs.encode(texts), strict=True):
        assert ids.tolist() == want, text[:100]
        assert sentence_pieces.decode_ids(ours, ids) == theirs.decode(want), text[:100]


def test_random_texts_like_the_library():
    r = random.Random(2)
    signs = "abcdeéß▁ \n\t xX0123漢字한ก🙂\x00<0x41>'\"   thein"
    same_as_library(["".join(r.choices(signs, k=r.randint(0, 80))) for _ in range(2000)])
    for rounds in (0, 1, 3):  # the heap finishes the rest
        same_as_library(["".join(r.choices("ab the in", k=r.randint(0, 60))) for _ in range(300)], width=16, rounds=rounds)


def test_long_words_like_the_library():
    r = random.Random(7)
    same_as_library([" " * k for k in range(80)] + ["x" * 5000, " " * 5000, "ab" * 3000, "thein" * 3000, "\n" * 999, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))])
    same_as_library(["x" * 100_000 + " the" * 30_000, "é" * 3_000], width=1000)


def test_ids_like_the_library():
    theirs, ours = library()
    r = random.Random(8)
    for _ in range(2000):
        ids = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(3, 258), r.randint(259, 31999), 29871, 259]) for _ in range(r.randint(0, 8))]
        assert sentence_pieces.decode_ids(ours, np.array(ids, np.int64)) == theirs.decode(ids), ids
    with pytest.raises(ValueError):
        sentence_pieces.decode_ids(ours, np.array([32000]))


def test_messy_documents_there_and_back(spark, messy):
    theirs, ours = library()
    both = sentence_pieces.encode(messy.withColumnRenamed("text", "ids"), ours, text="ids", name="text")
    got = sentence_pieces.decode(both, ours, ids="text", name="said").collect()
    want = sorted((str(x.doc_id), theirs.encode(x.text or ""), (x.text or "")) for x in messy.collect())
    assert sorted((str(x.doc_id), x.text, x.said) for x in got) == want
    assert sentence_pieces.encode(messy.limit(0), ours).count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert {x.text for x in sentence_pieces.decode(nothing, ours).collect()} == {None, ""}


@needs_tables
def test_registered_pieces_like_the_library(spark):
    theirs, _ = library()
    got = {x.doc_id: x for x in R.jobs["op13_sentence_pieces"](spark, SF).withColumn("n", F.col("n_tokens")).collect()}
    for doc, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = theirs.encode(text or "")
        x = got.pop(doc)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids)))
    assert not got
