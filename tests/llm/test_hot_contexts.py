"""Strings of hot grams are digested in parts of bounded bytes, however many long contexts come together."""

import random

from tallyrad.llm import repeats

from test_repeats import SCHEMA, brute


def test_many_long_contexts_of_hot_grams(spark, monkeypatch):
    """Two long texts that differ at every 250th byte: thousands of undecided contexts of nearly 300 bytes each."""
    monkeypatch.setattr(repeats, "HOT", 0)
    r = random.Random(11)
    text = "".join(r.choices("abcdefgh ", k=250_000))
    near = "".join("#" if i % 250 == 100 else c for i, c in enumerate(text))
    texts = [text, near, None, "short"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    got = {r.doc_id: (bytes(r.kept), len(r.spans), sum(s.end - s.start for s in r.spans)) for r in repeats.without_repeats(docs).collect()}
    want = brute(texts)
    assert [i for i, w in enumerate(want) if got[i] != w] == []
    assert want[0][1] > 0
