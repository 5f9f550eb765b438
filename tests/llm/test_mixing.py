"""Context mixing: bits one by one, experts token by token, the base by hand, and held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyrad.llm import mixing, queries

SCHEMA = "doc_id long, text string, learnt boolean, score string, word string"
SF = "/root/testdata/sf0.001"


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "cat", "Cats", "dog", "runs", "ünï", "fast-er", "1984"]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(n)]


ODD = [None, "", " \t\n", "x" * 20_000, "the  of\x0bTHE", "a\x00b \x00", "日本 " * 3000]


def filled(words, often, slot_bits=12):
    """Slots as dictionaries of counts, filled bit by bit."""
    n = np.zeros((mixing.PREDICTORS, 1 << slot_bits, 2))
    for word, c in zip(words, often):
        for own, _ in mixing.units([word]):
            data, found, _ = mixing.contexts([own])
            for i, byte in enumerate(data):
                for j in range(8):
                    so_far = np.array([int(byte) >> (8 - j) | 1 << j], np.uint8)
                    for p in range(mixing.PREDICTORS):
                        n[p, int(mixing.slot(found[p][i : i + 1], so_far, slot_bits)[0]), int(byte) >> (7 - j) & 1] += c
    return n


def test_contexts_are_told_apart():
    """Equal hashes where the last bytes are equal, and others elsewhere, whatever stands before the unit."""
    own = [b"abcabc ", b"xbcabc ", b"abc "]
    data, found, starts = mixing.contexts(own)
    assert data.tobytes() == b"".join(own) and starts.tolist() == [0, 7, 14]
    at = lambda p, unit, i: int(found[p][starts[unit] + i])
    assert at(0, 0, 4) == at(0, 0, 1) == at(0, 2, 1) and at(0, 0, 4) != at(0, 0, 5)
    assert at(1, 0, 5) == at(1, 1, 5) == at(1, 1, 2 + 3) and at(1, 0, 1) == at(1, 2, 1) != at(1, 1, 1)
    assert at(4, 0, 3) == at(4, 2, 3) and at(4, 0, 3) != at(4, 1, 3) and at(4, 0, 0) == at(4, 1, 0)


def test_words_cost_what_their_bits_cost():
    words = [b"the", b"then", b"\xc3\xa9", mixing.END, b"q" * (mixing.PIECE + 7), b"unseen"]
    n = filled(words[:5], [9, 2, 1, 20, 1])
    tables = mixing.states(n[:, :, 0], n[:, :, 1])
    weights = mixing.first_weights()
    mixing.learn_online(words[:4], np.array([9, 2, 1, 20]), tables, weights, 0)
    got = mixing.costs(words, tables, weights)
    count = np.exp2(np.arange(256) / 16) - 1
    for word, cost in zip(words, got):
        both = np.zeros(2)
        for own, _ in mixing.units([word]):
            data, found, _ = mixing.contexts([own])
            for i, byte in enumerate(data):
                for j in range(8):
                    so_far, bit = int(byte) >> (8 - j) | 1 << j, int(byte) >> (7 - j) & 1
                    place = lambda p, s: int(tables[p][int(mixing.slot(found[p][i : i + 1], np.array([s], np.uint8), 12)[0])])  # noqa: E731, B023
                    x = []
                    for p in range(mixing.PREDICTORS):
                        n0, n1 = count[place(p, so_far) >> 8], count[place(p, so_far) & 255]
                        odds = math.log((n1 + mixing.PRIOR) / (n0 + mixing.PRIOR))
                        x.append(odds if bit else -odds)
                    x.append(0.4 if bit else -0.4)
                    gate = int(mixing.SEEN[place(4, 1)]) << 3 | int(mixing.SEEN[place(3, 1)])
                    both -= [math.log1p(math.exp(-float(np.dot(w[:, g], x)))) for w, g in zip(weights, (j, gate))]
        assert math.isclose(np.logaddexp(*both) - math.log(2), cost, rel_tol=1e-4, abs_tol=1e-3)


def test_a_bit_and_its_opposite_share_all_probability():
    state = np.arange(65536)
    assert np.allclose(mixing.SCORED[state], -mixing.SCORED[state | 65536])
    n = np.array([0, 1, 2, 5, 1000, 10**9])
    assert mixing.levels(n[:3]).tolist() == [0, 16, 25] and (mixing.states(n, n) >> 8 == mixing.states(n, n) & 255).all()


def test_learning_lowers_the_cost():
    words = [w.encode() for w in {f"{a}{b}{c}" for a in ("un", "re", "pre") for b in ("do", "make", "see", "run") for c in ("", "s", "ing", "er")}]
    n = filled(words, [3] * len(words), 14)
    tables, weights, step = mixing.states(n[:, :, 0], n[:, :, 1]), mixing.first_weights(), 0
    new = [b"unruns", b"reseer", b"premaking"]
    before = mixing.costs(new, tables, weights).sum()
    for _ in range(20):
        step = mixing.learn_online(words, np.full(len(words), 3), tables, weights, step)
    assert mixing.costs(new, tables, weights).sum() > before


def test_experts_token_by_token():
    r = np.random.default_rng(4)
    values, together, left = r.random((2, 4)) / 5, np.array([0.8, 0.6]), np.array([-0.3, -0.1])
    docs = [r.integers(0, 5, n) for n in (0, 1, 7, 60)]
    got = mixing._experts(np.concatenate(docs), [len(d) for d in docs], values, together, left)
    for d, doc in enumerate(docs):
        want = []
        for k in range(2):
            for most in mixing.RECENT:
                seen, total = Counter(), 0.0
                for t in doc.tolist():
                    if t == 4:
                        total += left[k]
                        continue
                    n = sum(seen.values())
                    q = most * n / (n + mixing.WARM)
                    total += math.log((1 - q) * values[k, t] + q * together[k] * (seen[t] / n if n else 0))
                    seen[t] += 1
                want.append(total)
        assert np.allclose(got[d], want)


def plain_base(rows):
    tokens = [(mixing.tokens_of(t), bool(learnt)) for _, t, learnt, *_ in rows]
    c = Counter(w for own, learnt in tokens if learnt for w in own)
    n, v = sum(c.values()), len(c)
    return n, [(len(own), sum(c[w] > 0 for w in own), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) for own, _ in tokens]


def test_base_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FREQUENT", 5)  # most words are looked up by the join
    rows = [(i, t, i % 3 != 0, "clash", "clash") for i, t in enumerate(ODD + texts(60))] + [(None, "the dog", None, None, None)] * 2
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.score(frame.withColumn("key", F.col("doc_id")), F.col("learnt"), slot_bits=14).collect()
    assert len(got) == len(rows)
    n, want = plain_base(rows)
    by_id = {r[0]: w for r, w in zip(rows, want)}
    for r in got:
        tokens, known, base = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score) and math.isclose(r.bits_per_byte, -r.score * math.log2(10) / r.n_bytes)
    assert len({r.score for r in got if r.doc_id is None}) == 1
    assert next(r for r in got if r.doc_id == 0).n_tokens == 1


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.score(none, F.lit(True), slot_bits=14).count() == 0
    alone = spark.createDataFrame([(1, "ab", False, "", "")], SCHEMA)
    (r,) = mixing.score(alone, F.col("learnt"), slot_bits=14).collect()
    assert r.base_score == 0 and r.train_tokens == 0 and r.score < 0


def test_held_out_texts_cost_less_than_by_the_base(spark):
    found = queries.op13_mixing(spark, SF).collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in found)
    assert all(math.isfinite(r.score) for r in found) and held
    # the base gives all words that it doesn't know one probability, so only texts of known words compare
    known = [r for r in held if r.n_known >= 0.95 * r.n_tokens]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_texts_are_split_together_as_one_by_one():
    own = [*ODD, *texts(30), None, "ÀB\x0c\x1fC d E", " a", "a "]
    for array in (pa.array(own), pa.array([None, "zz y", *own, "x"]).slice(2, len(own)), pa.array(own[:1])):
        words, each = mixing.tokenised(array)
        want = [mixing.tokens_of(t) for t in array.to_pylist()]
        assert each.tolist() == [len(w) for w in want] and words.to_pylist() == [w for own in want for w in own]


def test_frequent_words_are_the_first_of_all(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FREQUENT", 20)
    r = random.Random(8)
    rows = [(f"w{k}".encode(), r.choice([0, 1, 1, 2, 2, 2, 3, 900, 901, 10**6]), -1.0) for k in range(300)] + [(b"l" * 65, 10**9, -1.0)]
    for most in (rows, rows[:25], []):
        frame = spark.createDataFrame(most, "word binary, c long, e double").repartition(7)
        want = sorted((-c, w) for w, c, _ in most if c and len(w) <= 64)[:20]
        got = mixing.frequent_words(frame)
        assert list(zip(got["c"].to_pylist(), got["word"].to_pylist())) == [(-c, w) for c, w in want]


def test_tables_hold_the_counts_of_all_partitions(spark):
    words = [f"word{k}".encode() for k in range(50)]
    frame = spark.createDataFrame([(w, 3) for w in words], "word binary, c long").repartition(5)
    n = filled(words, [3] * 50, 16)
    assert (mixing.fill_slots(frame, 300, 16) == mixing.states(n[:, :, 0], n[:, :, 1])).all()
