import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from callgrove.llm import texts


def hashes(text, table):
    return texts.word_hashes(texts.utf8(pa.scalar(text, pa.string())), table).tolist()


@given(st.text(alphabet=st.sampled_from("aAbB zZ09\n\t\r\x0b\x0c-_é漢\x00\x1f"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_are_those_of_the_patterns(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    for table, pattern in ((texts.SPACED, r"[^\x20\x09-\x0D]+"), (texts.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = re.findall(pattern, low)
        got = hashes(text, table)
        assert len(got) == len(words)
        assert len(set(zip(words, got, strict=True))) == len(set(words)) == len(set(got))


def test_slices_do_not_change_words(monkeypatch):
    text = " ".join(["word", "longer" * 40, "x"] * 50) + " " + "y" * 500
    whole = hashes(text, texts.SPACED)
    monkeypatch.setattr(texts, "SLICE", 64)
    assert hashes(text, texts.SPACED) == whole
    assert hashes(None, texts.SPACED) == [] == hashes("", texts.SPACED)


def test_mix_is_one_to_one():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(texts.mix(x))) == len(x)
