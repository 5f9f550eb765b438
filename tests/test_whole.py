"""Queries over whole tables against brute force."""

from collections import Counter, defaultdict

import pytest

from __spark_entry__ import queries
from pyspark.sql import functions as F

from tallyrad.functions import text as T
from tallyrad.operators import duplicates, matching, reconcile
from tallyrad.plans import analytics
from tallyrad.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark):
    return duplicates.with_fingerprint(fx.study_logs(spark, SF)).collect()


def test_audit_of_logs(spark, logs):
    of_session, of_day = defaultdict(set), defaultdict(set)
    for x in logs:
        of_session[x.session_id].add(f"{x.match_method}{x.id % 11}")
        of_day[x.log_date].add(f"{x.match_method}{x.id % 11}")
    want = {x.id: ";".join(sorted(of_session[x.session_id] | of_day[x.log_date])) for x in logs}
    assert {x.id: x.actions for x in queries()["audit_of_logs"](spark, SF).collect()} == want


def test_hospital_reconciliation(spark, logs):
    key = lambda x, code: f"{x.exam_name_raw}|{code}"
    reported = [
        (key(x, x.cpt_code + "H" * (x.id % 5 == 0)), x.modifier if x.id % 9 else None, None if x.work_rvu is None else x.work_rvu + 0.5 * (x.id % 4 == 0))
        for x in logs
    ]
    first = {}
    for x in sorted(logs, key=lambda x: x.id):
        first.setdefault(key(x, x.cpt_code), x)
    want = Counter()
    for k, modifier, work in reported:
        if k not in first:
            want["missing_local"] += 1
            continue
        want["modifier_mismatch"] += modifier != first[k].modifier
        want["wrvu_difference"] += None not in (work, first[k].work_rvu) and abs(work - first[k].work_rvu) > 0.01
    known = {k for k, _, _ in reported}
    want["missing_hospital"] = sum(key(x, x.cpt_code) not in known for x in logs)
    found = Counter(x.kind for x in queries()["hospital_reconciliation"](spark, SF).collect())
    assert found == want and min(want.values()) > 0


def test_fee_schedule_upsert(spark):
    parts = fx.cpt_rvu(spark, SF).collect()
    factor = {0: 1.1, 1: 1.01}
    parsed = [(x.cpt_code + "N" * (x.id % 5 == 0), x.modifier, x.work_rvu * factor.get(x.id % 4, 1.0)) for x in parts]
    want, big = Counter(), Counter()
    for x in parts:
        met = [w for code, modifier, w in parsed if (code, modifier) == (x.cpt_code, x.modifier)]
        want["kept"] += not met
        for w in met:
            change = "updated" if w != x.work_rvu else "unchanged"
            want[change] += 1
            big[change] += abs((w - x.work_rvu) / x.work_rvu * 100) >= 5
    stored = {(x.cpt_code, x.modifier) for x in parts}
    want["added"] = sum((code, modifier) not in stored for code, modifier, _ in parsed)
    rows = queries()["fee_schedule_upsert"](spark, SF).collect()
    assert Counter(x.change for x in rows) == want and len(want) == 4
    assert sum(abs(x.percent_change or 0) >= 5 for x in rows) == big["updated"] > 0


def test_duplicate_tiers(spark, logs):
    from datetime import timedelta

    minute = lambda t: t.hour * 60 + t.minute
    want = {}
    for c in logs:
        now = c.study_datetime + timedelta(minutes=c.id % 20)
        number = c.accession_number if c.id % 3 else None
        printed = f"acc:{number}" if number else f"fp:{c.exam_key}|{c.cpt_code}|{c.log_date}|{now:%H:%M}"
        for g in sorted(logs, key=lambda x: x.id):
            if g.log_date != c.log_date:
                continue
            apart = abs(minute(now) - minute(g.study_datetime))
            untimed = 0 in (minute(now), minute(g.study_datetime))
            has, had = c.exam_key.split(), g.exam_key.split()
            shared = sum(w in has for w in had) / max(1, min(len(set(has)), len(had)))
            if number and number == g.accession_number or printed == g.fingerprint:
                tier = "exact"
            elif c.cpt_code == g.cpt_code and (apart <= 15 or untimed and shared >= 0.7):
                tier = "very_likely" if apart <= 3 else "possible"
            else:
                continue
            want[c.id] = (g.id, tier)
            break
    rows = queries()["duplicate_tiers"](spark, SF).collect()
    assert {x.id: (x.log_id, x.tier) for x in rows} == want and len({t for _, t in want.values()}) == 3


def test_titles_meet_all_parts(spark):
    schedule = analytics._schedule(spark, SF)
    assert schedule.count() == len(analytics.SCHEDULE) + fx.cpt_rvu(spark, SF).count()
    odd = spark.createDataFrame([("1", "26", None, 1.0, "A", "0"), ("2", "26", None, 2.0, "A", "0")], schedule.schema)
    keys, fees = matching.title_keys(fx.titles(spark).limit(8)), matching.fee_keys(schedule.unionByName(odd))
    f = fees.select(*[F.col(c).alias(f"f_{c}") for c in fees.columns])
    radiology = T.radiology_score(F.col("radiology_title"), F.col("facts"), F.col("f_description"), F.col("f_facts"))
    every = keys.crossJoin(f).select(
        "title", "f_cpt_code", "f_description", "f_work_rvu", F.round(radiology, 9),
        F.round(T.combined_similarity(F.col("description_exam_key"), F.col("f_description_exam_key")), 9),
    )
    found = matching.scored_descriptions(keys, fees).select(
        "title", "cpt_code", "description", "work_rvu", F.round("radiology_score", 9), F.round("text_score", 9)
    )
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, every.collect()))


def test_candidates_by_facts_and_words_are_those_of_all_pairs(spark):
    """The fuzzy stage against scores of every title with every description, with few rows for each title."""
    schedule = analytics._schedule(spark, SF)
    keys, fees = matching.title_keys(fx.titles(spark)).persist(), matching.fee_keys(schedule).persist()
    every = matching.scored_descriptions(keys, fees).withColumn(
        "confidence",
        F.greatest(F.when(F.col("f_key") == F.col("description_key"), matching.EXACT).otherwise(0.0), "radiology_score", F.col("text_score") * matching.FUZZY_TEXT),
    )
    want = defaultdict(list)
    for x in every.where(F.col("confidence") >= matching.LEAST_DESCRIPTION).collect():
        want[x.title].append((-round(x.confidence, 9), x.cpt_code, x.description, x.work_rvu))
    for k in (1, 4):
        got = defaultdict(list)
        for x in matching.fuzzy_description(keys, fees, k).collect():
            got[x.title].append((-round(x.confidence, 9), x.cpt_code, x.description, x.work_rvu))
        assert {t: sorted(rows) for t, rows in got.items()} == {t: sorted(rows)[: 3 * k] for t, rows in want.items()}


def test_explorer_meets_all_parts(spark):
    parts = {x.description for x in fx.cpt_rvu(spark, "/root/testdata/sf0.01").collect()}
    assert parts & {x.description for x in queries()["explorer_search"](spark, "/root/testdata/sf0.01").collect()}


def test_title_similarity(spark):
    keyed = fx.titles(spark).withColumn("key", T.normalize_exam_text(F.col("title"))).select("title", "key").collect()
    pairs = [(a.title, b.title, a.key, b.key) for a in keyed for b in keyed if a.title < b.title]
    frame = spark.createDataFrame(pairs, "title_a string, title_b string, a string, b string")
    score = F.round(T.combined_similarity(F.col("a"), F.col("b")), 6).alias("score")
    want = {tuple(x) for x in frame.select("title_a", "title_b", score).collect() if x.score >= analytics.LEAST_ALIKE}
    found = queries()["title_similarity"](spark, SF).collect()
    assert {tuple(x) for x in found} == want and len(found) == len(want)
    assert any(a[:2] != b[:2] for a, b, _ in want)


def test_audit_keeps_a_row_for_each_log(spark):
    """No pairs of logs and actions: nothing is grouped by log, and the logs meet two lists."""
    logs = spark.createDataFrame([(1, "s", "d"), (2, None, "d"), (3, "t", None), (4, "u", "e")], "id long, session_id string, log_date string")
    audit = spark.createDataFrame([("s", "x", "b"), ("s", "d", "a"), ("t", "d", None), (None, "d", "c"), ("s", "d", "a")], "session_id string, log_date string, action string")
    found = reconcile.audit_of_logs(logs, audit)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" not in plan
    assert {r.id: r.actions for r in found.collect()} == {1: "a;b;c", 2: "a;c", 3: "", 4: ""}


def test_minutes_are_asked_once(spark):
    """Candidates of one minute share one look-up, and ties of rules go to the smaller log."""
    kind = "id long, log_date string, accession_number string, fingerprint string, cpt_code string, study_datetime timestamp_ntz, exam_key string"
    from datetime import datetime

    at = lambda m: datetime(2024, 1, 5, 10, m)
    stored = spark.createDataFrame([(7, "d", None, "p", "1", at(20), "x"), (5, "d", None, "q", "1", at(9), "x"), (9, "d", "N", "r", "1", at(40), "x")], kind)
    asked = spark.createDataFrame([(k, "d", "n" if k == 3 else None, f"z{k}", "1", at(m), "y") for k, m in ((1, 21), (2, 21), (3, 41), (4, 7), (6, 59))], kind)
    found = duplicates.duplicate_matches(asked, stored)
    assert "Aggregate [log_date#" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: tuple(r)[1:3] for r in found.collect()} == {1: (5, "possible"), 2: (5, "possible"), 3: (9, "exact"), 4: (5, "very_likely")}
    explode = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "explode(sequence" in x]
    assert explode and not any("id#" in x for x in explode)
