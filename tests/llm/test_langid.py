import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyrad.llm import langid, queries

TEXTS = {
    "en": ["the cat sat on the mat, the cat ran", "That is the THING", "over and over the hat"],
    "ru": ["кот сидел на ковре", "это кот и ковёр"],
    "zh": ["猫坐在垫子上", "猫在垫子上睡觉"],
}


def plain_bits(text, corpus):
    """PPM with method C and no exclusion, by dictionaries of contexts."""
    counts = defaultdict(Counter)
    for t in corpus:
        data = langid.START + t.encode().lower()
        for i in range(langid.ORDER, len(data)):
            for order in range(langid.ORDER + 1):
                counts[data[i - order : i]][data[i]] += 1
    kept = {c: seen for c, seen in counts.items() if len(c) <= 2 or sum(seen.values()) >= langid.SEEN}
    data, bits = langid.START + text.encode().lower(), 0.0
    for i in range(langid.ORDER, len(data)):
        for order in range(langid.ORDER, -1, -1):
            seen = kept.get(data[i - order : i])
            if seen is None:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits += math.log2(whole / seen[data[i]])
                break
            bits += math.log2(whole / len(seen))
        else:
            bits += 8
    return bits


def model_of(corpora):
    names = sorted(corpora)
    found = [langid.grams_of(corpora[n]) for n in names]
    return {
        "key": str(random.random()), "languages": names, "lang": np.repeat(np.arange(len(names)), [len(g) for g, _ in found]),
        "gram": np.concatenate([g for g, _ in found]), "n": np.concatenate([n for _, n in found]),
    }


@pytest.mark.parametrize("part", [langid.PART, 5, 64])
def test_code_lengths_like_plain_ppm(monkeypatch, part):
    monkeypatch.setattr(langid, "PART", part)
    known = langid.trees(model_of(TEXTS))
    texts = ["the mat and the CAT", "кот", "猫睡", "", "\x00\x01zq", "a", "the cat " * 30, "mixed кот 猫"]
    got = langid.code_lengths([t.encode() for t in texts], known)
    want = [[plain_bits(t, TEXTS[n]) for n in sorted(TEXTS)] for t in texts]
    assert got == pytest.approx(np.array(want), rel=1e-5, abs=1e-4)


def test_lookup_with_taken_slots():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 40, 5000))
    table = langid.Lookup(keys[::2], np.arange(len(keys[::2]), dtype=float))
    value, there = table.get(keys)
    assert len(table.more) and (there == (np.arange(len(keys)) % 2 == 0)).all()
    assert (value[::2] == np.arange(len(keys[::2]))).all() and not value[1::2].any()


def test_scripts_are_told_apart(spark):
    rows = [(k, t, n) for n, texts in TEXTS.items() for k, t in enumerate(texts)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = ["кот на", "猫", "the hat", "123 456", None, "", "\n", "é" * 300_000, "the hat"]
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(odd)], "doc_id long, text string, score string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert [got[i][0] for i in range(7)] == ["ru", "zh", "en", "und", "und", "und", "und"] and got[3][1] == 0 and got[2] == got[8]
    assert all(0 <= s <= 1 for _, s in got.values()) and len(got) == len(odd)


def test_equal_lengths_go_to_the_first_name():
    bits = langid.code_lengths([b"the cat"], langid.trees(model_of({"b": TEXTS["en"], "a": TEXTS["en"]})))
    assert bits[0, 0] == bits[0, 1] and bits.argmin(axis=1)[0] == 0


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.learn(none)
    assert langid.identify(none, model).count() == 0
    some = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert langid.identify(some, model).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    got = queries.op8_langid(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 3 for i in got.doc_id]) == 1
    assert (held == got.held_out).all()
    both = got.merge(docs, on="doc_id").query("held_out and lang.notna()", engine="python")
    assert (both.lang_pred == both.lang).mean() > 0.95
