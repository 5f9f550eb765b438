import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tallyrad.llm import queries, toxicity


def sentence(r, n=30):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def machine():
    r = random.Random(1)
    texts = [sentence(r) for _ in range(60)]
    return toxicity.fit(texts + [f"{t} idiot" for t in texts] + [f"stupid {t}" for t in texts], [0] * 60 + [1] * 120)


def test_gapped_and_padded_insults(machine):
    bad = [
        "The idiot said so.", "what an i-diot", "such id_iots", "an 1d10t", "i**d**i**o**t", "an i d i o t here", "an i  d  i\no  t", "id iot", "stu pid", "st upi d",
        "IDIOT", "\u00eddi\u00f6t", "you s.t.u.p.i.d one", "idiot" + " fine words" * 3000,
    ]
    good = ["The cat sat there.", "", None, "a", "\n\n", "x y z " * 4000, "2024 1010 777", "gabi feed chafe idea", "study hard", "\u65e5\u672c\u8a9e \u30c6\u30b9\u30c8"]
    scores = toxicity.toxicity(bad + good, machine)
    assert [t[:20] for t, s in zip(bad, scores) if s < 0.5] == []
    assert [t for t, s in zip(good, scores[len(bad) :]) if s >= 0.5] == []
    # an inserted letter lowers the score, and leaves it far above that of a clean word
    one, clean = toxicity.toxicity(["idxiot", "house"], machine)
    assert one > 5 * clean


def test_other_scripts_have_letters():
    r = random.Random(2)
    word = lambda: "".join(r.choice("\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437") for _ in range(5))
    clean = [" ".join(word() for _ in range(20)) for _ in range(60)]
    for insult in ("\u0434\u0443\u0440\u0430\u043a", "\u6df7\u86cb\u767d\u75f4\u50bb\u74dc"):
        model = toxicity.fit(clean + [f"{t} {insult}" for t in clean], [0] * 60 + [1] * 60)
        scores = toxicity.toxicity([insult, "-".join(insult), clean[0]], model)
        assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] < 0.5


def test_kernel_by_enumeration():
    words = ["stupid", "stxpid", "plain", "id-iot", "1d10t"]
    table, _ = toxicity.windows(*toxicity.letters_of(words))
    kernel = toxicity.Nystroem(table).kernel(table)
    plain = ["^stupid$", "^stxpid$", "^plain$", "^idiot$", "^idiot$"]

    def features(word):
        found = defaultdict(float)
        for i, j, k in combinations(range(min(len(word), 8)), 3):
            if k - i <= toxicity.SPREAD:
                found[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i - 2)
        return found

    norm = lambda w: sum(toxicity.DECAY ** (2 * (k - i - 2)) for i, _, k in combinations(range(min(len(w), 8)), 3) if k - i <= toxicity.SPREAD) ** 0.5
    for a, x in enumerate(plain):
        for b, y in enumerate(plain):
            want = sum(v * features(y)[s] for s, v in features(x).items()) / norm(x) / norm(y)
            assert kernel[a, b] == pytest.approx(want, abs=1e-6)


def test_table_of_weights_is_the_machine():
    """The weights by subsequence give the value that landmarks and whitening give."""
    r = random.Random(3)
    table, _ = toxicity.windows(*toxicity.letters_of(sentence(r, 200).split()))
    space, w = toxicity.Nystroem(table[:40]), np.random.default_rng(1).normal(size=1000)
    w = w[: space.whiten.shape[1]]
    assert toxicity.decision(table, space.weights(w), 0.3) == pytest.approx(space.features(table) @ w + 0.3, abs=1e-5)


def test_rows(spark, machine):
    odd = [None, "", "idiot", "idiot", "fine", "x" * 500_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(odd)], "doc_id long, text string, score string")
    got = {x.doc_id: x.score for x in toxicity.score(docs, machine).collect()}
    assert len(got) == len(odd) and got[2] == got[3] > 0.5 and all(0 <= s <= 1 for s in got.values())
    none, labels = docs.where("false"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(none, labels) is None and toxicity.score(none, machine).count() == 0
    assert {x.score for x in toxicity.score(docs, None).collect()} == {0.0}


def test_held_out_documents(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]) == got.held_out).all()
    both = got.merge(labels, on="doc_id").query("held_out")
    assert (both.predicted == both.toxic).mean() > 0.92
    assert (both.query("toxic == 1").predicted == 1).mean() > 0.88
