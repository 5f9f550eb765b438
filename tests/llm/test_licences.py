import random
from collections import defaultdict

from pyspark.sql import types as T

from tallyrad.llm import licences

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("dice", T.StringType()), T.StructField("licence", T.StringType())])
MIT, BSD = licences.TEMPLATES["MIT"][2], licences.TEMPLATES["BSD-2-Clause"][0]


def scanned(spark, texts):
    got = defaultdict(dict)
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], SCHEMA)
    for r in licences.licences(docs).collect():
        got[r.doc_id][r.licence] = round(r.dice, 6)
    return got


def plain(text, known):
    """The nearest run of pieces for each licence, over all runs and all templates."""
    words, piece = licences.pieces(licences.normalised(text))
    found = {}
    ends = [w for w in range(len(words)) if not w or piece[w] != piece[w - 1]] + [len(words)]
    for i in range(len(ends) - 1):
        for j in range(i + 1, len(ends)):
            run = words[ends[i] : ends[j]]
            own = set(zip(run, run[1:]))
            for name, theirs in known.sets:
                dice = 2 * len(own & theirs) / (len(own) + len(theirs))
                if dice >= known.least:
                    found[name] = max(found.get(name, (0,)), (dice, len(run), -ends[i]))
    return [(name, -first, n, dice) for name, (dice, n, first) in sorted(found.items())]


def test_same_as_all_runs():
    known, r = licences.Templates(licences.TEMPLATES), random.Random(4)
    base = [t for texts in licences.TEMPLATES.values() for t in texts]
    found = 0
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 3)):
            words = r.choice(base).split(" ")
            parts.append(" ".join(w for w in words if r.random() > r.choice([0, 0.1, 0.2])))
            parts.append(" ".join(r.choice(["code", "the software", "of the", "x = 1;"]) for _ in range(r.randint(0, 12))))
        text = r.choice(["\n", "\n\n", ". "]).join(parts)
        assert known.scan(text) == plain(text, known)
        found += bool(known.scan(text))
    assert found > 50


def test_licences_inside_longer_texts(spark):
    filler = "def f(x):\n    return x + 1\n" * 30
    texts = [
        "Copyright (c) 2020 Someone\n\n" + MIT, "words words\nReleased under the MIT License.\nmore", MIT.replace("Software", "Program"),
        filler + "\n" + MIT + "\n\n" + BSD + "\n" + filler, "Intro. Copyright (c) 2024 Acme. Licensed under the MIT License. More text follows here.",
        " ".join((filler + MIT).split()), "no licence here at all, just words", None, "", " ", "\n\n", "the " * 20_000, "日本語",
        "Released under the MIT License.", "Released under the MIT License.",
    ]
    got = scanned(spark, texts)
    assert got[0]["MIT"] == 1.0 and got[1]["MIT"] == 1.0 and 0.8 <= got[2]["MIT"] < 1
    assert got[3]["MIT"] == 1.0 and got[3]["BSD-2-Clause"] == 1.0 and got[4]["MIT"] == 1.0 and got[5]["MIT"] > 0.9
    assert set(got) == {0, 1, 2, 3, 4, 5, 13, 14} and got[13] == got[14]


def test_no_rows(spark):
    assert licences.licences(spark.createDataFrame([], SCHEMA)).count() == 0
