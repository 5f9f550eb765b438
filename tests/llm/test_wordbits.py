"""Words as bits: probabilities, contexts that cross words, and weights that go on learning within a text."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyrad.llm import mixing, wordbits

CODE = wordbits.Code(np.array([9, 5, 2, 1, 3]), np.array([0, 0, 1, 1, 2]))


def filled(texts, slot_bits=12):
    n = np.zeros((wordbits.PREDICTORS, 2 << slot_bits))
    for at in texts:
        bits = wordbits.Bits(CODE, at, wordbits.contexts(CODE, at, np.array([len(at)])), slot_bits)
        for p, slot in enumerate(bits.slots):
            np.add.at(n[p], slot << 1 | bits.bit, 1)
    return mixing.states(n[:, 0::2], n[:, 1::2])


def learnt(seed=3):
    r = np.random.default_rng(seed)
    texts = [r.integers(0, 5, r.integers(1, 60)) for _ in range(40)]
    tables, weights, step = filled(texts), wordbits.first_weights(), 0
    for at in texts:
        hashes = wordbits.contexts(CODE, at, np.array([len(at)]))
        step = wordbits.learn_online(wordbits.Given(CODE, at, hashes, tables, mixing.LEARNT, mixing.SEEN), weights, step)
    return texts, (tables, mixing.SCORED, mixing.SEEN, weights)


def test_every_symbol_has_its_own_bits():
    paths = {tuple(zip(CODE.node[a : a + n].tolist(), CODE.bit[a : a + n].tolist())) for a, n in zip(CODE.first, CODE.size)}
    assert len(paths) == 5 and sum(2.0 ** -len(p) for p in paths) == 1


def test_all_texts_of_a_length_share_all_probability(monkeypatch):
    """Also while the weights move after each word."""
    monkeypatch.setattr(wordbits, "FIRST_STEP", 1)
    _, given = learnt()
    every = np.array(list(itertools.product(range(5), repeat=4)))
    got = wordbits.refined(CODE, every.reshape(-1), np.full(len(every), 4), *given)
    assert math.isclose(np.exp(got).sum(), 1, rel_tol=1e-4)


def test_a_text_costs_the_same_alone_and_among_others(monkeypatch):
    texts, given = learnt()
    sizes = np.array([len(t) for t in texts])
    got = wordbits.refined(CODE, np.concatenate(texts), sizes, *given)
    alone = [wordbits.refined(CODE, t, np.array([len(t)]), *given)[0] for t in texts]
    monkeypatch.setattr(wordbits, "TOKENS", 7)
    assert np.allclose(got, alone, rtol=1e-4) and np.allclose(got, wordbits.refined(CODE, np.concatenate(texts), sizes, *given), rtol=1e-4)


def test_weights_move_with_the_text_bit_by_bit():
    texts, (tables, by, seen, weights) = learnt()
    text = np.array([0, 1, 0, 1, 2] * 30)
    got = wordbits.refined(CODE, text, np.array([len(text)]), tables, by, seen, weights)[0]
    hashes = wordbits.contexts(CODE, text, np.array([len(text)]))
    given = wordbits.Given(CODE, text, hashes, tables, by, seen)
    now, held, want, fixed, last, moves = weights.astype(float), np.full(wordbits.GATES, wordbits.HELD), 0.0, 0.0, 0, []
    steps = wordbits.steps_of(np.arange(len(text)))
    for i, word in enumerate(given.word):
        if steps[word] != last:
            for g in {m[0] for m in moves}:
                own = [m for m in moves if m[0] == g]
                held[g] += 4 * sum(w * (1 - w) for _, w, _ in own)
                now[:, g] += np.clip(wordbits.OWN_PACE * sum(w * x for _, w, x in own) / held[g], -0.2, 0.2)
            last, moves = steps[word], []
        g, x = given.gate[i], given.odds[:, i].astype(float)
        z = float(now[:, g] @ x)
        want -= math.log1p(math.exp(-z))
        fixed -= math.log1p(math.exp(-float(weights[:, g] @ x)))
        moves.append((g, 1 / (1 + math.exp(z)), x))
    assert math.isclose(got, want, rel_tol=1e-4) and got > fixed


def test_the_order_of_words_counts(spark):
    """Pairs of words always come together; the same words in another order cost more."""
    r = random.Random(6)
    pairs = [(f"left{k}", f"right{k}") for k in range(12)]
    text = lambda: [w for _ in range(30) for w in r.choice(pairs)]
    rows = [(k, " ".join(text()), True) for k in range(200)]
    own = text()
    rows += [(1000, " ".join(own), False), (1001, " ".join(own[0::2] + own[1::2]), False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, learnt boolean")
    got = {x.doc_id: x.score for x in mixing.score(frame, F.col("learnt"), slot_bits=14).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 20
