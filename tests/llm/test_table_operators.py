"""Mixture, URL filter, archive, neighbours, decontamination and near duplicates against plain versions."""

import hashlib
import math
import os
import random
import re
import time
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callgrove.llm import decontaminate, minhash_dedup, mixture, neighbours, url_filter, warc
from callgrove.llm.queries import R
from tests.llm.conftest import DOCUMENTS, documents, edited, prose

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


# mixture

def share(budget, children):
    """Exact amounts: raise all children together by weight until the budget is used or they are full."""
    given = {k: Fraction(0) for k in children}
    left = Fraction(min(budget, sum(c for c, w in children.values() if w)))
    while left > 0:
        open_ = [k for k, (c, w) in children.items() if w and given[k] < c]
        step = min([left / sum(children[k][1] for k in open_)] + [(children[k][0] - given[k]) / children[k][1] for k in open_])
        for k in open_:
            given[k] += step * children[k][1]
        left -= step * sum(children[k][1] for k in open_)
    return given


@pytest.mark.parametrize("seed", range(2))
def test_budgets_are_shared_among_siblings_before_ancestors(spark, seed):
    r = random.Random(seed)
    leaves = [(f"d{i}", f"l{j}", f"s{k}", r.choice([0, 1, 5, 40, 1000])) for i in range(3) for j in range(3) for k in range(r.randint(1, 4))]
    weights = {"a": {"d0": 5, "d1": 2}, "b": {"l0": 3, "l2": 0}, "c": {}}
    df = spark.createDataFrame(leaves, "a string, b string, c string, cap bigint")
    w = lambda level, name: weights[level].get(name, 1)
    usable = [x for x in leaves if w("b", x[1])]
    for budget in (0, 7, 1500, 10**7):
        got = {(x.a, x.b, x.c): x.given for x in mixture.budgets(df.where("b <> 'l2'"), ["a", "b", "c"], weights, budget).collect()}
        assert sum(got.values()) == min(budget, sum(x[3] for x in usable))
        cap = defaultdict(int)
        for x in usable:
            for i in (1, 2, 3):
                cap[x[:i]] += x[3]
        for node in {x[:i] for x in usable for i in (0, 1, 2)}:
            below = {x[:len(node) + 1] for x in usable if x[:len(node)] == node}
            amount = lambda n: sum(v for k, v in got.items() if k[:len(n)] == n)
            exact = share(amount(node), {n: (cap[n], w("abc"[len(node)], n[-1])) for n in below})
            assert all(abs(amount(n) - exact[n]) < 1 for n in below), (node, budget)


def test_zero_weights_give_nothing(spark):
    df = spark.createDataFrame([("a", 10), ("b", 10)], "x string, cap bigint")
    assert {(r.x, r.given) for r in mixture.budgets(df, ["x"], {"x": {"b": 0}}, 15).collect()} == {("a", 10)}


def test_mixture_of_messy_documents(spark, messy):
    docs = mixture.with_domain(messy, long=100)
    for percent, epochs in ((0, 1), (50, 1), (250, 3), (1000, 2)):
        weights = {"domain": {"short": 2}, "lang": {}, "source": {}}
        out = mixture.mix_sources(docs, percent, epochs, 5, weights=weights).collect()
        source = docs.collect()
        total = sum(r.n_tokens for r in source)
        assert all(r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in source)
        taken = sum(r.taken_tokens for r in out)
        want = min(total * percent // 100, total * epochs)
        assert want - 8 <= taken <= want  # repeated rows at a cut share what is left
        leaf = lambda r: (r.domain, r.lang or "", r.source or "")
        for key in {leaf(r) for r in out}:
            rows = [r for r in source if leaf(r) == key and r.n_tokens]
            got = sorted((r.epoch, str(r.doc_id), r.taken_tokens) for r in out if leaf(r) == key)
            given = sum(x[2] for x in got)
            size = sum(r.n_tokens for r in rows)
            expect = [(e, str(r.doc_id), r.n_tokens) for e in range(1, given // size + 1) for r in rows]
            rest, e = given % size, given // size + 1
            place = lambda r: hashlib.md5(f"5:{e}:{'' if r.doc_id is None else r.doc_id}:{r.n_tokens}".encode()).hexdigest()
            groups = defaultdict(list)
            for r in rows:
                groups[place(r)].append(r)
            for p in sorted(groups):
                each = min(groups[p][0].n_tokens, rest // len(groups[p]))
                expect += [(e, str(r.doc_id), each) for r in groups[p] if each]
                rest -= each * len(groups[p])
                if each < groups[p][0].n_tokens:
                    break
            assert got == sorted(expect)
        for r in out:
            assert len((r.text or "").split()) == r.taken_tokens or any(ord(c) > 127 for c in r.text)
            assert r.component_id == "x" and isinstance(r.epoch, int)
    assert mixture.mix_sources(docs.limit(0)).count() == 0
    assert mixture.mix_sources(docs.drop("text"), 50).count() == mixture.mix_sources(docs, 50).count()


# URL filter

URLS = [None, "", "no scheme/net/", "http://", "http://a.net", "http://a.net/", "HTTP://A.Net/x", "http://net/x?y#z", "http://x.example.net/en/1", "http://example.net/en", "http://anet/x",
        "http://b.example.com/de/", "http://b.example.com/De/", "http://org/fr/1", "http://a.org/fr?x", "http://x?net/", "http://x#a/b", "a://b://c/d", "http://É.net/é?q", "http://u@h.net:80/p",
        "http://a.org/" + "seg/" * 3000, "http://a.net/\nx?y", "http://a.net/en/1", "http://a.net/en/1"]


def test_rules_match_plain_reading(spark):
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, s1 string")
    for r in url_filter.judge_urls(rows, keep=("page_id",)).collect():
        url = URLS[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(n, v) for n, v in url_filter.RULES if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith("/" + n.partition("/")[2])]
        rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[0])
        assert r.verdict == rule[1] if rule[1] else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_templates_learned_from_rules(spark):
    urls = [f"http://h.com/ad/{i}.html" for i in range(60)] + [f"http://h.com/ads{i}/x" for i in range(3)] + [f"http://h.com/blog/{w}" for w in "abcdefghijklmnopqrstuvwxyz"]
    urls += [f"http://ok.com/ad/{i}.html" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    rules = [(f"h.com/ad/{d}", "block") for d in range(1, 10)]  # not the pages whose number begins with 0
    got = {urls[r.page_id]: r for r in url_filter.judge_urls(df, rules=rules).collect()}
    page = got["http://h.com/ad/0.html"]
    assert page.rule is None and page.verdict == "block" and page.template == "h.com/ad/*.*" and page.purity > 0.8
    assert got["http://ok.com/ad/0.html"].verdict == "allow" == got["http://h.com/blog/a"].verdict


def test_branches_that_look_alike_are_merged_and_others_not(spark):
    rows = [("h", a, b, "", n) for a, b, n in [("en", "*", 500), ("de", "*", 480), ("tags", "red", 300), ("tags", "blue", 250), ("few", "*", 7), ("old", "*", 200), ("old", "x", 150)]]
    df = spark.createDataFrame(rows, "host string, s1 string, s2 string, s3 string, n bigint").withColumn("k2", F.when(F.col("s2") == "*", "digits").otherwise("word"))
    got = {r.s1: r.t1 for r in url_filter._level(df, ["host"], "s1", "k2", "t1", 0.5, 16, 8, 0.05).collect()}
    assert got == {"en": "en", "de": "en", "tags": "tags", "few": "few", "old": "old"}


def test_labels_are_carried_to_urls_without_a_rule(spark):
    langs = ["en", "de", "fr"]
    urls = [f"http://{host}/{lang}/a/b/c/{i}" for host in ("bad.com", "free.com", "mixed.com", "few.com") for lang in langs for i in range(60)]
    urls += [f"http://bad.com/{w}" for w in ("about", "contact")] + [f"http://bad.com/shop/item-{w}" for w in "abcdefghijklmnop"]
    rules = [("bad.com/de/", "block"), ("mixed.com/de/", "block"), ("mixed.com/fr/", "allow"), *[(f"few.com/de/a/b/c/{d}", "block") for d in "12"]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {urls[r.page_id]: r for r in url_filter.judge_urls(df, rules=rules).collect()}
    for url, r in got.items():
        host, lang = url.split("/")[2:4]
        rule = next((v for n, v in rules if url.startswith(f"http://{n}")), None)
        assert r.verdict == (rule or ("block" if host == "bad.com" and lang in langs else "block" if host == "few.com" and lang in langs else "allow")), url
        if host == "bad.com" and lang in langs:
            assert r.template == "bad.com/de/a/b/c/*" and r.purity == (60 + 0.5) / 65
    assert {r.verdict for r in url_filter.judge_urls(df, rules=rules[-1:]).collect() if "few.com" in urls[r.page_id] and r.rule is None} == {"allow"}  # 11 labels are too few
    deep = spark.createDataFrame([(i, f"http://d.com/{'x/' * 5}{i}") for i in range(40)], "page_id int, url string")
    for levels in (1, 8):
        assert {r.verdict for r in url_filter.judge_urls(deep, rules=[(f"d.com/{'x/' * 5}{d}", "block") for d in "123"], levels=levels).collect()} == {"block"}


# archive

def test_archive_round_trip(spark, tmp_path):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/", big), (2, None, big), (3, "u\r\nX: y", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", "z" * 1000), (8, "u", "a\r\n\r\nWARC-Type: x\r\n" * 90),
            (None, "u", big), (9, "u", "y" * 3_000_000), (10, "u", "w" * 1000), (10, "u", "w" * 1000), (None, "u", "v" * 2000), (None, "u", "v" * 2000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, digest string")
    warc.write_archive(df, str(tmp_path / "a"), date="2024-05-06T07:08:09Z")
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got}) and {r.date for r in got} == {"2024-05-06T07:08:09Z"}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = sorted([(r.id, r.payload.decode(), r.record_type, r.refers_to) for r in got], key=key)
    refers = {1: 2}
    expect = [(i, h or "", "revisit" if i in refers or (i is None and h == big) else "response", 2 if i in refers or (i is None and h == big) else None) for i, _, h in rows]
    assert found == sorted(expect, key=key)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.sha1 == r.payload_digest and r.bytes == len(r.payload) for r in got)
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({h or "" for _, _, h in rows})
    for r in warc.rebuild(warc.read_archive(spark, str(tmp_path / "a"))).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
        assert "WARC-Refers-To" not in fields or fields["WARC-Refers-To"] in {x.record_id for x in got if x.id == 2}
        assert head.startswith(b"WARC/1.1") and body.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(body) - 4
    warc.write_archive(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0


def test_damaged_payloads_are_noticed(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id bigint, url string, html string"), str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.lit(b"other")).write.mode("overwrite").parquet(str(tmp_path / "c/payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_payloads(spark, str(tmp_path / "c")).collect()
    for old, new in ((b"Content-Length: 3", b"Content-Length: 4"), (b"sha1:a9", b"sha1:a8")):
        headers = spark.read.parquet(str(tmp_path / "a/headers"))
        changed = headers.withColumn("header", F.replace(F.decode("header", "UTF-8"), F.lit(old.decode()), F.lit(new.decode())).cast("binary"))
        home = tmp_path / new.hex()
        changed.write.parquet(str(home / "headers"))
        spark.read.parquet(str(tmp_path / "a/payloads")).write.parquet(str(home / "payloads"))
        with pytest.raises(Exception, match="damaged record"):
            warc.read_archive(spark, str(home)).collect()


# neighbours

def plain_nearest(rows, k, asks):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = set()
    for q in {i for i, _ in good if asks(i)}:
        own = min(v.tolist() for i, v in good if i == q)
        near = sorted((math.sqrt(((v - own) ** 2).sum()), i) for i, v in good if i != q and len(v) == len(own))
        out |= {(q, n, i, round(d, 9)) for n, (d, i) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("size", [1, 3, 64])
def test_neighbours_match_brute_force(spark, size):
    r = np.random.default_rng(size)
    rows = [(i, (r.integers(-2, 3, size) if i % 3 else r.normal(0, 10 ** r.uniform(-3, 3), size)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [0.0] * size), (303, [None] * size), (304, [float("nan")] * size), (305, [float("inf")] * size), (None, [1.0] * size), (310, [1.0] * (size + 1)), (320, [2.0] * (size + 1)),
             (50, [1.0] * size), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, id string")
    for settings in ({}, {"group_rows": 37, "group_queries": 5}):
        got = neighbours.nearest(df, F.col("vec_id") % 10 == 0, 7, **settings).collect()
        assert {(x.query_id, x.rank, x.vec_id, round(x.score, 9)) for x in got} == plain_nearest(rows, 7, lambda i: i % 10 == 0)
        assert len(got) == len({(x.query_id, x.rank) for x in got})
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_tiles_in_small_parts():
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 8))
    ids = np.arange(90)
    one = sorted(neighbours.tile_nearest(ids[:20], x[:20], ids, x, 5))
    assert one == sorted(neighbours.tile_nearest(ids[:20], x[:20], ids, x, 5, rows=3, columns=7)) and len(one) == 100


@pytest.mark.filterwarnings("ignore:overflow", "ignore:invalid")
def test_squares_beyond_a_double_lose_no_row():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(30, 4)), r.normal(size=(5, 4)) * 1e200, [[1e200, 0, 0, 0], [1e200, 1e140, 0, 0]]])
    ids = np.arange(len(x))
    got = set(neighbours.tile_nearest(ids, x, ids, x, 6))
    with np.errstate(all="ignore"):
        far = [[math.inf if i == j else float(np.sqrt(((x[j] - x[i]) ** 2).sum())) for j in ids] for i in ids]
    want = {(i, j, far[i][j]) for i in ids.tolist() for j in sorted((j for j in ids.tolist() if j != i), key=lambda j: (far[i][j], j))[:6]}
    assert {(int(a), int(b), float(d)) for a, b, d in got} == want


def test_rounding_errors_are_bounds():
    x = np.random.default_rng(2).normal(0, 5, (50, 16))
    q, s, e = neighbours.quantise(x)
    assert np.abs(q).max() <= 127 and np.allclose(np.linalg.norm(x - q * s[:, None], axis=1), e)


# decontamination

def plain_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, w in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != w)))
        row = new
        best = min(best, (row[-1], j))
    return best


def test_bit_parallel_distance_is_edit_distance():
    r = random.Random(1)
    for _ in range(400):
        pattern, text = [r.randint(0, 3) for _ in range(r.randint(1, 40))], [r.randint(0, 3) for _ in range(r.randint(0, 60))]
        a, b = r.randint(0, 3), r.randint(0, 3)
        words = np.array([7] * a + text + [8] * b + [9], np.uint64)
        rows = np.array([pattern + [5] * 3, [6] * (len(pattern) + 3)], np.uint64)
        edits, end = decontaminate.edit_distances(rows, np.array([len(pattern)] * 2), words, np.array([a, 0]), np.array([a + len(text), 0]))
        best = plain_distance(pattern, text)
        assert (edits[0], end[0] - a) == best and (edits[1], end[1]) == (len(pattern), 0)


def windows_of(words, span, rate, least):
    """Each stretch of ``span`` words with the edits it may have; short items as a whole."""
    budget = lambda m: min(int(rate * m), max(0, m // 4 - 1)) if len(words) >= least else 0
    parts = [words[s:s + span] for s in range(max(0, len(words) - span) + 1)] if len(words) >= least else [words] * bool(words)
    return [(p, budget(len(p))) for p in parts]


def plain_leaks(docs, items, span=24, rate=0.2, least=8):
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())
    out = set()
    for d, t in docs:
        for i, item in items:
            if t and item:
                if any(plain_distance(w, words(t))[0] <= budget for w, budget in windows_of(words(item), span, rate, least)):
                    out.add((d, i))
    return out


def quick_leaks(docs, items):
    """The same, looking only at pairs that share four words in a row, as a window within its budget must."""
    grams = lambda t: {tuple(w[i:i + 4]) for w in [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.lower())] for i in range(len(w) - 3)}
    index = [(i, t, grams(t or "")) for i, t in items]
    out = set()
    for d, t in docs:
        own = grams(t or "")
        out |= plain_leaks([(d, t)], [(i, x) for i, x, g in index if own & g])
    return out


def test_leaks_match_plain_search(spark):
    items = [(i, prose(100 + i, n)) for i, n in enumerate([8, 9, 15, 16, 24, 25, 40, 61])] + [(20, None), (21, ""), (22, "two words"), (0, prose(100, 8))]
    docs = []
    for k in range(60):
        r = random.Random(k)
        item = items[k % 8][1].split()
        for _ in range(r.randint(0, len(item) // 4)):
            at = r.randrange(len(item))
            item[at:at + 1] = r.choice([[], ["odd"], [item[at], "more"], [item[at] + "x"]])
        cut = item[r.randint(0, len(item) // 2):] if k % 3 == 0 else item
        docs.append((k, prose(k, 50) + "\n" + ("!! ".join(cut).upper() if k % 2 else " ".join(cut)) + " " + prose(500 + k, 30)))
    docs += [(100, None), (101, ""), (102, "short"), (103, items[6][1]), (103, items[6][1]), (None, items[5][1]), (104, prose(7, 3000))]
    df = spark.createDataFrame(documents(docs), DOCUMENTS)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, doc_id int")
    expect = plain_leaks(docs, items)
    assert 20 < len(expect)
    for blocks in ({}, {"block_items": 3}, {"block_chars": 200}):
        got = decontaminate.find_leaks(df, bench, **blocks).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expect
        kept = decontaminate.remove_leaks(df, bench, **blocks)
        assert kept.columns == df.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d, _ in docs if d not in {x for x, _ in expect})
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 == decontaminate.find_leaks(df, bench.limit(0)).count()
    assert decontaminate.remove_leaks(df, bench.limit(0)).count() == len(docs)


@needs_tables
def test_leak_query_over_whole_tables(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()]
    expect = quick_leaks([(d[0], d[1]) for d in read("documents")], read("benchmark"))
    assert {(r.doc_id, r.item_id) for r in R.jobs["op9_decontaminate"](spark, SF).collect()} == expect


def stretches(words, item, span=24):
    """Edits and end of the best place of any stretch of ``span`` words of the item, by plain distances to all of the text."""
    budget = lambda m: min(m // 5, max(0, m // 4 - 1)) if len(item) >= 8 else 0
    parts = [item[s:s + span] for s in range(max(0, len(item) - span) + 1)] if item else []
    found = [plain_distance(p, words) for p in parts]
    return min((f for f, p in zip(found, parts, strict=True) if f[0] <= budget(len(p))), default=None)


def matcher(*items):
    return decontaminate.Matcher([(i, decontaminate._words(pa.scalar(t))) for i, t in enumerate(items)], 24, 0.2, 8)


def test_passages_are_found_wherever_they_begin():
    for n in (25, 59, 300):
        item = prose(700 + n, n).split()
        one = matcher(" ".join(item))
        for size in (19, 20, 24, 26):
            for at in range(n - size + 1):
                text = f"{'before ' * 30}{' '.join(item[at:at + size])}{' after' * 30}"
                assert bool(one.find(pa.scalar(text))) == (size >= 20) == bool(one.find(pa.scalar(text), any_one=True)), (n, size, at)


def test_edits_and_ends_match_plain_distances():
    items = [prose(800 + n, n).split() for n in (8, 12, 24, 27, 45, 70)] + [["a", "b"] * 20]
    search = matcher(*map(" ".join, items))
    hits = 0
    for k in range(60):
        r = random.Random(k)
        words = prose(900 + k, 20).split()
        for item in r.sample(items, 2):
            at = r.randrange(len(item))
            part = item[at // 2:at // 2 + r.randint(8, 60)]
            for _ in range(r.randint(0, 5)):
                i = r.randrange(len(part))
                part = part[:i] + r.choice([[], ["odd"], [part[i], "more"]]) + part[i + 1:]
            words += part + prose(k, 6).split()
        expect = [(i, *f) for i, item in enumerate(items) if (f := stretches(words, item))]
        assert search.find(pa.scalar(" ".join(words))) == expect
        hits += len(expect)
    assert hits > 40


def test_shared_pieces_and_repetitive_texts_like_plain_distances(monkeypatch):
    r = random.Random(12)
    items = ["answer the following question with a short text".split() + prose(k, r.randint(0, 40)).split() for k in range(30)]
    items += [r.choices("ab", k=r.randint(8, 60)) for _ in range(4)] + [["a"] * 50, ["a"] * 50, (["a"] * 6 + ["b"]) * 8, items[0], items[3] + items[4]]
    search = matcher(*map(" ".join, items))
    for k in range(12):
        words = [w for _ in range(4) for w in items[0][:9] + r.choice(items)[r.randint(0, 9):][:r.randint(0, 40)] + r.choices("ab", k=r.randint(0, 30)) + prose(k, 5).split()]
        expect = [(i, *f) for i, item in enumerate(items) if (f := stretches(words, item))]
        for many, chunk in ((32, 1 << 16), (1, 64)):
            monkeypatch.setattr(decontaminate, "MANY", many)
            monkeypatch.setattr(decontaminate, "CHUNK", chunk)
            assert search.find(pa.scalar(" ".join(words))) == expect and bool(search.find(pa.scalar(" ".join(words)), any_one=True)) == bool(expect)


@pytest.mark.parametrize("case", ["preamble", "equal", "binary"])
def test_time_on_shared_pieces(case):
    r = random.Random(3)
    if case == "preamble":
        start = "answer the following question with a short text "
        search, text = matcher(*(start + prose(k, 50) for k in range(20_000))), " ".join(start + prose(50_000 + k, 10) for k in range(200))
    elif case == "equal":
        search, text = matcher("a " * 300), ("a " * 19 + "b ") * 400
    else:
        search, text = matcher(" ".join(r.choices("ab", k=300))), " ".join(r.choices("abc", k=8000))
    began = time.process_time()
    search.find(pa.scalar(text))
    assert time.process_time() - began < 60


def test_short_items_match_as_a_whole_and_unchanged():
    items = ["two words", "Which river is longest?", "one", "what is the boiling point", "a b c", "", "how many moons has planet mars"]
    search = matcher(*items)
    for text, expect in [("x TWO, words y two words", [(0, 0, 3)]), ("two odd words", []), ("ask: which river is longest", [(1, 0, 5)]), ("which river is the longest", []), ("one", [(2, 0, 1)]),
                         ("ones a b c one", [(2, 0, 5), (4, 0, 4)]), ("what is the boiling point", [(3, 0, 5)]), ("how many moons has planet Mars now", [(6, 0, 6)]), ("how many moons has mars", []), ("", [])]:
        assert search.find(pa.scalar(text)) == expect, text
        words = re.findall("[a-z]+", text.lower())
        assert expect == [(i, *f) for i, t in enumerate(items) if (f := stretches(words, re.findall("[a-z]+", t.lower())))]
        assert bool(search.find(pa.scalar(text), any_one=True)) == bool(expect)


def test_short_items_are_found_by_the_filters(spark):
    df = spark.createDataFrame(documents([(1, "so which river is longest of all"), (2, "no river"), (3, None)]), DOCUMENTS)
    bench = spark.createDataFrame([(7, "Which river is longest?")], "item_id int, text string")
    assert [(r.doc_id, r.item_id, r.edits, r.end_word) for r in decontaminate.find_leaks(df, bench).collect()] == [(1, 7, 0, 5)]
    assert sorted(r.doc_id for r in decontaminate.remove_leaks(df, bench).collect()) == [2, 3]


def test_repeated_items_count_once_and_do_not_fill_a_block(spark):
    text = prose(60, 30)
    bench = spark.createDataFrame([(1, text)] * 50 + [(2, prose(61, 30)), (None, text), (None, text)], "item_id int, text string")
    assert max(len(b) for b in decontaminate._blocks(bench, "item_id", "text", 20, 10_000)) == 3
    df = spark.createDataFrame(documents([(1, text)]), DOCUMENTS)
    assert sorted(str(r.item_id) for r in decontaminate.find_leaks(df, bench, block_items=20).collect()) == ["1", "None"]


# near duplicates

def plain_groups(docs, words=4, percent=80):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def test_groups_match_brute_force(spark):
    docs, n = [], 0
    for g in range(12):
        base = prose(1000 + g, [5, 9, 30, 120, 400][g % 5])
        for k in range(14):
            docs.append((n, edited(base, n, [0, 0.01, 0.03, 0.05, 0.1][k % 5])))
            n += 1
    text = prose(77, 300)  # a chain in which only neighbours are similar
    for k in range(10):
        docs.append((n, text))
        text, n = edited(text, 5000 + k, 0.03), n + 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b"), (n + 4, "A  b"), (n + 5, "b a"), (n + 6, "x"), (n + 7, prose(1003, 30_000)), (n + 8, prose(1003, 30_000) + " end")]
    df = spark.createDataFrame(documents(docs), DOCUMENTS)
    for block in (1024, 4):
        got = {tuple(r) for r in minhash_dedup.near_duplicates(df, block=block).collect()}
        assert got == plain_groups(docs)


def test_links_that_no_centre_takes_part_in(spark):
    """A hub of smaller id than all is similar to none of two that are similar to each other."""
    hub = prose(1, 200).split()
    side = hub[:]
    for i in range(4, 200, 38):
        side[i] = f"side{i}"
    far = side[:]
    far[150] = "far"
    docs = [(0, " ".join(hub)), (1, " ".join(side)), (2, " ".join(far))]
    docs += [(10 + k, edited(docs[0][1], k, 0.01)) for k in range(20)] + [(40 + k, edited(docs[1][1], k, 0.015)) for k in range(20)]
    df = spark.createDataFrame(documents(docs), DOCUMENTS)
    assert {tuple(r) for r in minhash_dedup.near_duplicates(df, block=7).collect()} == plain_groups(docs)


def test_near_duplicates_of_messy_documents(spark, messy):
    rows = minhash_dedup.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {i: r.component_id for i, r in by.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 8, 11: 11, 12: 12, 13: 13, 14: 14, 15: 15}
    assert {(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None} == {(117, 1, False), (0, None, True)}
    out = minhash_dedup.drop_near_duplicates(messy, words=5)
    assert out.columns == messy.columns
    assert sorted(r.doc_id for r in out.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7, 8, 11, 12, 13, 14, 15]
    assert minhash_dedup.near_duplicates(messy.limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(40, 41), (41, 50), (50, 7)], [(5, 3), (9, 3), (9, 8), (8, 2), (20, 21)]])
def test_components(spark, edges):
    got = {(r.id, r.component) for r in minhash_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    top = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    assert got == set(top.items())


def test_sketches_estimate_similarity():
    signer = minhash_dedup.Signer()
    a = minhash_dedup.shingles(pa.scalar(prose(1, 2000)), 4)
    b = minhash_dedup.shingles(pa.scalar(edited(prose(1, 2000), 9, 0.03)), 4)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signer.sketch(a) == signer.sketch(b)).mean() - true) < 0.2
    small = a[:3]
    assert set(signer.sketch(small).tolist()) <= set(small.tolist()) and len(signer.keys(a[:1])) == minhash_dedup.BANDS


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_marks_miss_no_id(spark, monkeypatch, bits):
    from callgrove.llm import marks

    monkeypatch.setattr(marks, "BITS", bits)
    df = spark.range(-500, 500).selectExpr("CASE WHEN id <> 3 THEN id END AS k", "id AS __id", "'x' AS word")
    ids = spark.range(-40, 60).selectExpr("CASE WHEN id % 7 <> 0 THEN id END AS k")
    rows = marks.mark(df, ids, "k").collect()
    wanted = {i for i in range(-40, 60) if i % 7}
    assert len(rows) == 1000 and {r.k for r in rows if r["__marked"]} >= wanted - {3} and not any(r["__marked"] for r in rows if r.k is None)
    kept = marks.without(df, ids, "k")
    assert kept.columns == df.columns
    assert sorted(r["__id"] for r in kept.collect()) == [i for i in range(-500, 500) if i not in wanted or i == 3]
    assert marks.without(df, ids.limit(0), "k").count() == 1000
