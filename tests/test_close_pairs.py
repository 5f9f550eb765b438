"""The fuzzy stage's joins against scores of all pairs, on titles and descriptions that share frequent words."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyrad.functions import text as T
from tallyrad.operators import matching
from tallyrad.plans import analytics
from tallyrad.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
KINDS = ["ct", "mri", "us", "xr", "nm pet", "mammo", "ir", ""]
PLACES = ["head", "brain", "chest", "abdomen", "pelvis", "knee", "neck", "spine", "foot", "wrist", "thyroid", "breast", ""]
DYES = ["with contrast", "without contrast", "with and without contrast", "w/o dye", "", ""]
REST = ["left", "right", "bilateral", "complete", "limited", "guided", "biopsy", "2 views", "3d", "ct ct", "angiogram", "of", "portable", "follow up"]


def _texts(seed: int, n: int) -> list[str]:
    dice = random.Random(seed)
    made = []
    for _ in range(n):
        parts = [dice.choice(KINDS), dice.choice(PLACES), dice.choice(DYES), *dice.choices(REST, k=dice.choice([0, 1, 1, 2, 4, 14]))]
        dice.shuffle(parts)
        made.append(" ".join(p for p in parts if p))
    return made + ["", "ct", "of", "a b", "with", "head head head"]


@pytest.fixture(scope="module")
def tables(spark):
    """600 titles; all parts, the fixed schedule and 120 more rows."""
    kind = "cpt_code string, modifier string, description string, work_rvu double, status_code string, pc_tc string"
    more = [(f"{10000 + i}", "26", t, 1.0 + i % 7, "A", "0") for i, t in enumerate(_texts(5, 120))]
    schedule = analytics._schedule(spark, SF).select("cpt_code", "modifier", "description", "work_rvu", "status_code", "pc_tc")
    titles = spark.createDataFrame([(t,) for t in _texts(6, 600)], "title string").unionByName(fx.titles(spark).select("title"))
    keys = matching.cut(matching.title_keys(titles))
    return keys, matching.cut(matching.fee_keys(schedule.unionByName(spark.createDataFrame(more, kind))))


def test_pairs_are_those_of_all(spark, tables, monkeypatch):
    keys, fees = tables
    every = matching.scored_descriptions(keys, fees).withColumn(
        "confidence",
        F.greatest(F.when(F.col("f_key") == F.col("description_key"), matching.EXACT).otherwise(0.0), "radiology_score", F.col("text_score") * matching.FUZZY_TEXT),
    )
    want = defaultdict(list)
    for x in every.where(F.col("confidence") >= matching.LEAST_DESCRIPTION).select("title", "confidence", "cpt_code", "description", "work_rvu").toLocalIterator():
        want[x.title].append((-x.confidence, x.cpt_code, x.description, x.work_rvu))
    for k, held in ((1, 4096), (3, 16)):
        monkeypatch.setattr(matching, "HELD", held)
        got = defaultdict(list)
        for x in matching.fuzzy_description(keys, fees, k).collect():
            got[x.title].append((-x.confidence, x.cpt_code, x.description, x.work_rvu))
        assert got.keys() == want.keys()
        for title, rows in want.items():
            assert sorted(got[title]) == sorted(rows)[: 3 * k], title


def test_few_pairs_are_scored(spark, tables):
    """Of the pairs that share a word those are left that can reach 0.85, and of these by far not all do."""
    keys, fees = tables
    texts = matching._texts(fees)
    titles = keys.withColumn("asked", F.to_json("facts")).withColumn("least", F.lit(0.85))
    groups = titles.select("asked", "facts").dropDuplicates(["asked"]).crossJoin(texts.select(F.to_json("f_facts").alias("has"), "f_facts").dropDuplicates(["has"]))
    groups = groups.select("asked", "has", T.facts_score(F.col("facts"), F.col("f_facts")).alias("given"))
    words = lambda c: F.explode(F.array_distinct(T.words(F.col(c)))).alias("word")
    sharing = keys.select("title", words("description_exam_key")).join(texts.select("description", words("f_exam")), "word")
    near, many = matching.close_pairs(titles, texts, groups), sharing.select("title", "description").distinct().count()
    by_words = matching._by_exam_words(titles, texts).distinct().count()
    print(by_words, near.count(), many)
    assert 0 < by_words < many / 4 and by_words < near.count() < many / 2


def test_library_search_meets_few_rows_of_a_description(spark, monkeypatch):
    """Titles are scored with 2 * k rows of each description, however many it has, and find the same."""
    from tallyrad.operators import matching

    met, scored = [], matching.scored_descriptions
    monkeypatch.setattr(matching, "scored_descriptions", lambda keys, fees: met.append(fees.count()) or scored(keys, fees))
    rows = [(n, f"{70000 + n % 40}", "26", d, float(1 + n % 7)) for d in ("CT head w/o contrast", "MRI brain") for n in range(300)]
    cpt = spark.createDataFrame(rows, "id long, cpt_code string, modifier string, description string, work_rvu double")
    titles = spark.createDataFrame([("CT head without contrast",), ("70003",), ("mri brain",)], "title string")
    found = matching.library_search(titles, cpt, k=8).collect()
    assert met == [2 * 2 * 8]
    own = [(r.rank, r.cpt_code) for r in sorted(found, key=lambda r: r.rank) if r.title == "mri brain" and r.source == "exact description"]
    assert own == [(n + 1, f"{70000 + n}") for n in range(8)]
    # of a code's rows the first by description and work units stays
    assert {(r.cpt_code, r.description, r.work_rvu) for r in found if r.title == "70003"} == {("70003", "CT head w/o contrast", 1.0)}
