import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilmoch.llm import codepoints as C
from tilmoch.llm.consistent import consistent_texts
from tilmoch.llm.text_columns import words_text


def fold(*texts):
    out, changed = C.fold(pa.array(texts, pa.string()))
    return list(zip(out.to_pylist(), changed.tolist()))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ｆｕｌｌ １２", "full 12"), ("a​b﻿", "ab"), ("a b　c", "a b c"), ("é", "é"), ("xаlq", "xalq"), ("Каcpap қалам", "Касрар қалам"), ("рірі keldi shunda", "pipi keldi shunda"),
        ("Κοkibon bilan", "Kokibon bilan"), ("mіνlіk deb", "mivlik deb"), ("o­siyo", "osiyo"), ("a͏́b", "áb"), ("а́lma gul", "álma gul"), ("Ⅸ asr", "IX asr"), ("ﬁl", "fil"),
    ],
)
def test_folds(text, want):
    assert fold(text) == [(want, True)]


@pytest.mark.parametrize("text", ["", "oddiy matn", "tab\tva\nqator", "№ 5 ² ½", "oʻzbek ʼ ‘ ’ `", "«Ҳамроҳ» gazetasi", "қулай QR ва Wi-Fi, GPS, usb", "çarşı ǵarın", "— «ha» – „yoʻq“", "ы́", "GPSни oldim"])
def test_keeps(text):
    assert fold(text) == [(text, False)]


def test_nulls_long_texts_and_slices():
    big = "xаlq " * 300_000
    arr = pa.array([None, "", big, "xаlq", None])
    out, changed = C.fold(arr)
    assert out.to_pylist() == [None, "", big.replace("а", "a"), "xalq", None] and changed.tolist() == [False, False, True, True, False]
    cut, _ = C.fold(arr.slice(3, 2))
    assert cut.to_pylist() == ["xalq", None]
    assert C.fold(pa.array([], pa.string()))[0].to_pylist() == []
    assert C.fold(pa.array(["xаlq"], pa.large_string()))[0].to_pylist() == ["xalq"]


MARKS = [chr(c) for c in (0x300, 0x301, 0x302, 0x306, 0x308, 0x323, 0x327, 0x328, 0x31B, 0x345)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aeiouycsgnéêüçệǘ w") + MARKS + ["ᄒ", "ᅡ", "ᆫ", "하"]), max_size=12), max_size=6))
def test_composition_is_the_standard_one(texts):
    out, _ = C.fold(pa.array(texts, pa.string()))
    assert out.to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=8))
def test_fold_is_idempotent_and_batches_do_not_mix(texts):
    once = C.fold(pa.array(texts, pa.string()))[0]
    assert not C.fold(once)[1].any()
    assert once.to_pylist() == [C.fold(pa.array([t], pa.string()))[0].to_pylist()[0] for t in texts]


def plain_words(text):
    text = C.fold(pa.array([text]))[0][0].as_py().lower()
    for c in C.APOSTROPHES:
        text = text.replace(c, "")
    return "".join(c if c.isalnum() else " " for c in text).split()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abÁß İ'ʻ.,-​ж№½ \n")), max_size=25), min_size=1, max_size=6))
def test_words_equal_the_plain_definition(texts):
    arr = pa.array(texts)
    assert C.word_form(arr).to_pylist() == [" ".join(plain_words(t)) for t in texts]
    h, n = C.word_hashes(*C.decode(arr))
    want = [w for t in texts for w in plain_words(t)]
    assert n.tolist() == [len(plain_words(t)) for t in texts]
    ids = {}
    for w, x in zip(want, h.tolist()):
        assert ids.setdefault(w, x) == x
    assert len(set(ids.values())) == len(ids)


def test_column_functions(spark):
    df = spark.createDataFrame([("a", ["xаlq", None, "b"], "z"), ("b", None, "z"), ("a", ["xаlq", None, "b"], "z"), ("c", [], "z")], "key string, tokens array<string>, field string")
    got = sorted(map(tuple, consistent_texts(df, "key", "tokens", "f").collect()), key=str)
    assert got == [("f", "a", "xalq b", True), ("f", "a", "xalq b", True), ("f", "b", None, False), ("f", "c", "", False)]
    assert consistent_texts(df.limit(0), "key", "tokens", "f").count() == 0
    assert [r[0] for r in spark.createDataFrame([("A, b'c",), (None,)], "t string").select(words_text(F.col("t"))).collect()] == ["a bc", None]


def test_mixing_of_rows_in_one_batch():
    random.seed(1)
    texts = ["".join(random.choice("abcавс хіó ．１") for _ in range(random.randint(0, 30))) for _ in range(500)]
    whole, flags = C.fold(pa.array(texts))
    for i in random.sample(range(500), 60):
        a, f = C.fold(pa.array([texts[i]]))
        assert a.to_pylist() == [whole[i].as_py()] and f[0] == flags[i]
    assert np.array_equal(flags, [a != b for a, b in zip(texts, whole.to_pylist())])
