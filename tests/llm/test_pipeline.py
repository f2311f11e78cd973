"""The corpus pipeline, stage by stage."""

import os
import random
import re

import pytest

import corpus_pipeline
from callgrove.llm import secret_scan
from tests.llm.test_table_operators import plain_groups, quick_leaks

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_stages_on_the_whole_table(spark, tmp_path):
    docs = read(spark, "documents")
    items = [tuple(r) for r in read(spark, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns and len({r.doc_id for r in rows}) == len(rows)
        ids = {r.doc_id for r in rows}
        if name == "language_id":
            assert ids == {i for i, r in before.items() if any(map(str.isalpha, r.text or ""))}
        if name == "near_duplicates":
            assert ids == {i for i, _, _, kept in plain_groups([(i, r.text) for i, r in before.items()], words=5) if kept}
        if name == "decontaminate":
            assert ids == set(before) - {d for d, _ in quick_leaks([(i, r.text) for i, r in before.items()], items)}
        if name in ("language_id", "near_duplicates", "decontaminate"):
            assert all(before[r.doc_id] == r for r in rows)
        if name == "secrets":
            assert ids == set(before)
            for r in rows:
                assert r.text == secret_scan.redact(before[r.doc_id].text) and r.n_chars == len(r.text)
        if name == "mixture":
            total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before.values())
            assert sum(r.taken_tokens for r in rows) == total * 50 // 100
        docs = out


LONG_JUNK = {
    "letters": lambda r: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=3000)), "many letters": lambda r: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=50_000)),
    "c": lambda r: "for (int i = 0; i < n; i++) { sum += values[i] * weights[i]; } return sum / (double) n; } static void print_list(struct node *head) { while (head) head = head->next; } " * 12,
    "polish": lambda r: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 12,
    "norwegian": lambda r: "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. " * 12,
    "italian": lambda r: "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. " * 12}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="benchmark tables are not here")
def test_short_clean_texts_stay_and_long_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = docs.first().asDict()
    clean = {f"clean {k}": t for k, t in enumerate(["Von.", "Osrañ.", "Erinst resh.", "Osiebo | armici. |"])}
    junk = {name: f(random.Random(4)) for name, f in LONG_JUNK.items()}
    more = [tuple((row | {"doc_id": -k - 1, "text": t, "lang": None, "n_chars": len(t)})[c] for c in docs.columns) for k, t in enumerate([*clean.values(), *junk.values()])]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(more, docs.schema)), SF).collect()}
    names = [*clean, *junk]
    assert [n for k, n in enumerate(names) if -k - 1 in kept] == list(clean)
    gone = [r.text for r in docs.collect() if r.doc_id not in kept and any(map(str.isalpha, r.text or ""))]
    assert all(10 * len(set(words)) <= len(words) for words in (re.findall(r"\w+", t) for t in gone)), [t[:80] for t in gone]  # a few words over and over


def test_run_and_messy_documents(spark, messy):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.taken_tokens > 0 for r in rows)
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == messy.columns, name
    left = docs.where("doc_id IS NOT NULL").collect()
    assert sorted(r.doc_id for r in left) == [1, 4, 8, 11, 13, 14]  # 12 is one letter repeated, near to no language
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, messy.limit(0), SF).count() == 0, name
