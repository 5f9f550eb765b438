import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from tallyrad.llm import anchors, repeats, transforms

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType())]
)


def brute(texts):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for d in data:
        seen.update(d[i : i + 200] for i in range(len(d) - 199))
    kept = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept.append((bytes(c for c, g in zip(d, gone) if not g), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), sum(gone)))
    return kept


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(80)
    texts = [None, "", "x" * 199, "x" * 200, "y" * 900, prose(3)]
    base = prose(150)
    texts += [base, base, base[:300] + "#" + base[301:], base[7:], base[:-3]]
    for _ in range(12):
        lo = r.randint(0, 150)
        texts.append(prose(r.randint(0, 40)) + passage[lo : lo + r.randint(150, 330)] + prose(r.randint(0, 40)))
    texts += ["Eron, " * 80, "Eron, " * 120 + "z", passage * 2]
    near = prose(200)
    for _ in range(10):
        at = r.randint(0, len(near) - 1)
        texts.append(near[:at] + r.choice("xyz") + near[at + 1 :])
    return texts


@pytest.mark.parametrize("hot", [0, 2, repeats.HOT])
def test_same_as_brute_force(spark, monkeypatch, hot):
    """With a least count of 0 all undecided grams are hot, with 2 some are."""
    monkeypatch.setattr(repeats, "HOT", hot)
    for seed in (1, 2):
        texts = corpus(seed)
        docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(5)
        got = {r.doc_id: (bytes(r.kept), len(r.spans), sum(s.end - s.start for s in r.spans)) for r in repeats.without_repeats(docs).collect()}
        want = brute(texts)
        assert [i for i, w in enumerate(want) if got[i] != w] == []


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    r = random.Random(3)
    text = bytes(r.randrange(97, 105) for _ in range(5000))
    monkeypatch.setattr(anchors, "PART", 700)
    a = anchors.find([text, b"short", text[:650]])
    starts = sorted(s for row, lo, hi in zip(a.row, a.first, a.last) if row == 0 for s in range(lo, hi + 1))
    assert starts == list(range(5000 - 199))


def test_a_common_gram_among_different_contexts(spark):
    """One line stands in a third of the documents, each time among other words; some neighbours are shared."""
    r = random.Random(4)
    prose = lambda n: "".join(r.choice("abcdefg ") for _ in range(n))
    line = "this very line of more than thirty-two bytes is everywhere"
    sides = [prose(120) for _ in range(4)]
    texts = [r.choice(sides) + line + r.choice(sides)[: r.randint(80, 120)] + prose(40) for _ in range(40)]
    texts += [prose(150) + line + prose(150) for _ in range(40)] + [prose(300) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (bytes(r.kept), len(r.spans), sum(s.end - s.start for s in r.spans)) for r in repeats.without_repeats(docs).collect()}
    assert [i for i, w in enumerate(brute(texts)) if got[i] != w] == []


def rows_of(grams, wholes, agains):
    n = len(grams)
    columns = (np.array(grams), np.array(grams), np.array(wholes), np.array(agains), np.arange(n), *[np.zeros(n, int)] * 4)
    return repeats._batch(tuple(c.astype(np.int64) for c in columns), repeats.CANDIDATE)


def states(batches, most=repeats.HELD):
    found = pa.Table.from_batches(repeats.streamed(iter(batches), most))
    return dict(zip(found["row"].to_pylist(), found["state"].to_pylist()))


def test_one_digest_that_collides_removes_nothing():
    assert states([rows_of([5, 5, 6, 6, 7], [1, 1, 2, 2, 3], [8, 9, 4, 4, 1])]) == {
        0: repeats.OPEN, 1: repeats.OPEN, 2: repeats.REPEATED, 3: repeats.REPEATED,
    }


def test_long_groups_are_let_go_content_by_content():
    grams, wholes = [1] * 40 + [2] * 3 + [3] * 30, [1] + [2] * 20 + [3] * 19 + [1, 2, 2] + [9] * 30
    whole = rows_of(grams, wholes, wholes)
    want = states([whole])
    assert want == states([whole.slice(i, 3) for i in range(0, len(grams), 3)], most=5)
    assert want[0] == repeats.OPEN and want[1] == repeats.BOTH and want[2] == repeats.REPEATED


def test_bytes_decide_where_grams_collide():
    """All contexts in one block, as if all grams had one hash: the strings found are those that bytes repeat."""
    r = random.Random(8)
    base = bytes(r.randrange(97, 101) for _ in range(360))
    contexts, low, high, place = [], [], [], []
    for k in range(60):
        data = bytearray(base)
        for _ in range(r.randint(0, 2)):
            data[r.randrange(360)] = 120
        a, b = sorted((r.randint(0, 160), r.randint(0, 160)))
        contexts.append(bytes(data[a : b + 200]))
        low.append(a + k), high.append(b + k), place.append(165 + k)
    low, high, place = map(np.array, (low, high, place))
    found = {(row, p) for row, a, b in zip(*transforms.repeated_strings(np.zeros(60, int), contexts, low, high, place)) for p in range(a, b + 1)}
    every = [(k, p, contexts[k][p - low[k] :][:200], place[k] - p) for k in range(60) for p in range(low[k], high[k] + 1)]
    seen = Counter((s, d) for _, _, s, d in every)
    assert found == {(k, p) for k, p, s, d in every if seen[s, d] > 1}


def test_common_prefixes():
    r = random.Random(9)
    words = [bytes(r.choice(b"ab") for _ in range(16)) for _ in range(300)]
    block = np.array([r.randrange(3) for _ in words])
    order, common = transforms.interleaved(block, np.frombuffer(b"".join(words), np.uint8).reshape(-1, 16))
    assert [(block[k], words[k]) for k in order] == sorted((b, w) for b, w in zip(block, words))
    for before, now, n in zip(order, order[1:], common[1:]):
        same = next((i for i in range(16) if words[before][i] != words[now][i]), 16)
        assert n == (same if block[before] == block[now] else -1)
