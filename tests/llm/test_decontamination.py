import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyrad.llm import decontamination, tokens

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("seeds", T.StringType())])


def found(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(f"i{k}", t, "x") for k, t in enumerate(items)], "item_id string, text string, doc_id string")
    rows = decontamination.overlaps(docs, bench).collect()
    got = {(r.doc_id, int(r.item_id[1:])): (r.first_word, r.n_words, r.n_matches) for r in rows}
    assert len(got) == len(rows)
    return got


def plain(doc, item):
    """Whether any alignment without gaps has a stretch that is long and alike enough."""
    size = len(item)
    least = max(decontamination.SHORTEST, min(decontamination.OVERLAP, size))
    for shift in range(-size, len(doc)):
        same = [0 <= shift + k < len(doc) and doc[shift + k] == item[k] for k in range(size)]
        inside = [0 <= shift + k < len(doc) for k in range(size)]
        for a in range(size):
            for n in range(least, size - a + 1):
                if all(inside[a : a + n]) and sum(same[a : a + n]) >= decontamination.ALIKE * n:
                    return True
    return False


@pytest.mark.parametrize("size,changes", [(5, 1), (6, 1), (7, 1), (8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (13, 1), (13, 2), (14, 2), (15, 3), (16, 3), (17, 3)])
def test_every_placement_of_substitutions_is_reported(size, changes):
    words = [f"w{k}" for k in range(size)]
    item, counts = tokens.hashed_words([" ".join(words)])
    have = decontamination.item_seeds(item, counts)[0]
    for places in combinations(range(size), changes):
        text = ["q", *("zz" if k in places else w for k, w in enumerate(words)), "q"]
        mine, n = tokens.hashed_words([" ".join(text)])
        assert any(np.isin(decontamination.seeds(mine, n, m)[0], have).any() for m in decontamination.EVERY_MASK)
        assert decontamination.best_overlap(mine, item, [1]) is not None


def test_all_placements_in_spark(spark):
    """13 words with any two substituted: 78 of 78."""
    words = [f"w{k}" for k in range(13)]
    texts = [" ".join(["q", *("zz" if k in p else w for k, w in enumerate(words)), "q"]) for p in combinations(range(13), 2)]
    assert len(found(spark, texts, [" ".join(words)])) == len(texts) == 78


def test_random_overlaps_like_brute_force(spark):
    """Stretches of items with substitutions, at random places of documents; every alignment is tried."""
    r = random.Random(5)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("aeiou") + r.choice("xyz")
    items = [[word() for _ in range(r.choice([5, 6, 7, 8, 10, 11, 14, 20, 30]))] for _ in range(12)]
    docs = []
    for _ in range(160):
        item = r.choice(items)
        a = r.randint(0, len(item) // 3)
        part = [word() if r.random() < r.choice([0.0, 0.1, 0.2, 0.3]) else w for w in item[a : r.randint(len(item) * 2 // 3, len(item))]]
        docs.append([word() for _ in range(r.randint(0, 9))] + part + [word() for _ in range(r.randint(0, 9))])
    got = found(spark, [" ".join(d) for d in docs], [" ".join(i) for i in items])
    want = {(d, i) for d in range(160) for i in range(12) if plain(docs[d], items[i])}
    assert 20 < len(want) and set(got) == want
    for (d, i), (first, n, matches) in got.items():
        assert any(sum(a == b for a, b in zip(docs[d][first : first + n], items[i][k : k + n])) == matches for k in range(len(items[i])))


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [
        "x " + item.upper().replace(" ", ", ") + ". y", item, item, None, "", " ", "\n", "one two three four five six", "a " * 30_000, "\u65e5\u672c\u8a9e",
        "q " * 50_000 + item, item + " - " + item,
    ]
    got = found(spark, texts, [item, item, "a a a a a a", None, "", "a b c"])
    same = {(d, i) for d in (0, 1, 2, 10, 11) for i in (0, 1)}
    assert set(got) == same | {(8, 2)}
    assert got[0, 0] == (1, 14, 14) and got[10, 1] == (50_000, 14, 14) and got[11, 0] == (0, 14, 14) and got[8, 2] == (0, 6, 6)


def test_no_rows(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.overlaps(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g", None, None)], SCHEMA)
    assert decontamination.overlaps(some, bench).count() == 0
    assert decontamination.overlaps(docs, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0


def test_table_holds_all_seeds_and_few_others(spark):
    r = np.random.default_rng(3)
    code = r.integers(-(1 << 63), 1 << 63, 5000)
    table = decontamination.seed_table(spark.createDataFrame([(int(c),) for c in code], "seed long"))
    assert len(decontamination.known(table, code.view(np.uint64))) == 5000
    other = r.integers(0, 1 << 64, 100_000, np.uint64)
    assert len(decontamination.known(table, other)) < 20


def test_words_of_long_texts_are_hashed_in_slices(monkeypatch):
    texts = ["the quick brown fox " * 50, "x" * 300, None, "end, of it"]
    want = tokens.hashed_words(texts)
    monkeypatch.setattr(tokens, "SLICE", 7)
    got = tokens.hashed_words(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and list(want[1]) == [200, 1, 0, 3]
