"""Golden cases of titles, similarity, codes, dates and pace."""

import pytest
from pyspark.sql import functions as F

from tallyrad.functions import codes, dates
from tallyrad.functions import text as T
from tallyrad.operators import learning, pace


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first().v


def apply(spark, function, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", function(F.col("t")).alias("v")).collect()
    return {r.t: r.v for r in rows}


def test_exam_text(spark):
    cases = {
        "CT A/P W/ CON": "ct abdomen pelvis with contrast",
        "CT Head w/o contrast": "ct head without contrast",
        "STAT_CTA Chest (PE)": "ct angiogram chest pe",
        "US ABD COMPL": "ultrasound abdomen complete",
        "CT C/A/P wwo": "ct chest abdomen pelvis with and without",
        "X-RAY CHEST 2V": "xray chest two view",
        "": "",
    }
    assert apply(spark, T.normalize_exam_text, cases) == cases


def test_description_and_again(spark):
    cases = {
        "CT Abdomen & Pelvis with contrast": "CT ABD AND PEL W",
        "CT ABD/PELVIS W": "CT ABD AND PEL W",
        "CT HEAD W/O": "CT HEAD WO",
        "CTA Chest PE Protocol": "CT ANGIO THORAX PE",
        "MR Brain without and with contrast": "MRI BRAIN WWO",
        "X-Ray chest two views": "XR THORAX 2 VIEWS",
        "US right upper quadrant": "US RUQ",
        "CT chest abdomen pelvis w contrast": "CT THORAX ABD AND PEL W",
    }
    assert apply(spark, T.normalize_description, cases) == cases
    again = {v: v for v in cases.values()}
    assert apply(spark, T.normalize_description, again) == again


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        ("CT abd", "CT abdomen w contrast", 0.883333),
        ("CT head w/o", "CT head w/ contrast", 0.2),
        ("CT A/P W/ CON", "CT Abdomen Pelvis With Contrast", 1.0),
        ("MRI brain", "Us exam abdom complete", 0.024),
    ],
)
def test_similarity(spark, a, b, score):
    column = T.combined_similarity(T.normalize_exam_text(F.col("a")), T.normalize_exam_text(F.col("b")))
    assert one(spark, column, a=a, b=b) == pytest.approx(score, abs=1e-6)


def test_radiology_title(spark):
    got = apply(spark, T.radiology_title, ["cta pelvis", "ct head w/o", "US abd"])
    assert got["cta pelvis"].title == "CTA Chest Pulmonary Embolism with Contrast" and got["cta pelvis"].was_protocol
    assert not got["ct head w/o"].was_protocol


def test_modality_of_codes(spark):
    cases = {
        "70450": "CT", "70553": "MRI", "71046": "XR", "76700": "US", "77067": "MAMMO", "78815": "NM_PET", "G0202": "MAMMO",
        "99999": "OTHER", "73200": "XR", "73218": "XR", "": "OTHER",
    }
    assert apply(spark, codes.classify_modality, cases) == cases


def test_numeric_cells(spark):
    cases = {"1,234.5": 1234.5, "NA": None, "": None, "3.5abc": 3.5, " .25 ": 0.25, "x": None}
    assert apply(spark, codes.numeric_cell, cases) == cases


def test_moments(spark):
    cases = ["6/28/26 2:05 PM", "12/31/2025", "2026-01-02 07:30", "Jun 3, 2026", "13/40/2026", "Yesterday", "x"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    found = dates.with_moment(rows, "t", F.lit("2026-06-28 10:00:00").cast("timestamp_ntz")).collect()
    got = {r.t: r.moment for r in found}
    assert str(got["6/28/26 2:05 PM"].study_datetime) == "2026-06-28 14:05:00" and got["6/28/26 2:05 PM"].confidence == 1.0
    assert str(got["12/31/2025"].study_date) == "2025-12-31" and got["12/31/2025"].confidence == 0.85
    assert str(got["2026-01-02 07:30"].study_datetime) == "2026-01-02 07:30:00"
    assert str(got["Jun 3, 2026"].study_date) == "2026-06-03" and got["Jun 3, 2026"].confidence == 0.75
    assert got["13/40/2026"] is None and got["x"] is None
    assert str(got["Yesterday"].study_date) == "2026-06-27"


def test_sunday_weeks(spark):
    rows = spark.sql("select date'2026-06-28' d union all select date'2026-07-01'").select(dates.sunday_week(F.col("d")).alias("w"))
    assert {str(r.w) for r in rows.collect()} == {"2026-06-28"}


def test_pace_during_shift(spark):
    row = spark.createDataFrame([(40.0,)], "current_wrvu double")
    lit = F.lit
    r = pace.daily_pace(row, lit(90.0), lit("08:00"), lit("17:00"), lit(60), lit(780)).first()
    assert (r.shift_minutes, r.elapsed_minutes, r.remaining_minutes, r.status) == (480, 300, 180, "behind")
    assert r.expected_wrvu == 56.25 and r.pace_difference == -16.25 and r.projected_wrvu == 64
    assert r.required_per_hour == pytest.approx(16.666667) and r.minutes_ahead == pytest.approx(-86.666667)


@pytest.mark.parametrize(
    ("units", "moment", "month", "elapsed", "left", "projected"),
    [
        (7500.0, "2026-06-30 10:00:00", 1, 181, 184, 15124.309392),
        (7500.0, "2026-06-30 13:00:00", 1, 182, 183, 15041.208791),
        (100.0, "2026-06-30 10:00:00", 10, 1, 364, 36500.0),
    ],
)
def test_year_to_date(spark, units, moment, month, elapsed, left, projected):
    logs = spark.createDataFrame([(1, units, False)], "profile_id long, work_rvu double, needs_review boolean")
    r = pace.year_to_date(logs, moment, F.lit(15000.0), fiscal_month=month, vacation=10).first()
    assert (r.days_elapsed, r.days_left) == (elapsed, left)
    assert r.projected_wrvu == pytest.approx(projected, abs=1e-5)


def test_alias_confidence(spark):
    for (base, n, c, r), want in {(0.90, 1, 0, 0): 0.910536, (0.95, 9, 0, 0): 0.985, (0.90, 1, 1, 0): 0.850536, (0.90, 0, 5, 5): 0.65}.items():
        got = one(spark, codes.alias_confidence(*(F.lit(x) for x in (base, n, c, r))))
        assert got == pytest.approx(want, abs=1e-6)


def test_learning_fold(spark):
    events = [(1, None, "k", 1, "confirm", "A")] + [(1, None, "k", n, "confirm", "A") for n in (2, 3, 4)]
    schema = "profile_id int, site_id int, alias_key string, seq int, action string, codes string"
    wanted = [0.90, 0.925535, None, None]
    got = learning.learn_aliases(spark.createDataFrame(events[:1], schema)).first()
    assert got.confidence == 0.90 and got.confirmations == 1
    after = learning.learn_aliases(spark.createDataFrame(events, schema)).first()
    changed = learning.learn_aliases(spark.createDataFrame([*events, (1, None, "k", 5, "confirm", "B")], schema)).first()
    assert after.confidence == pytest.approx(1.0) and after.confirmations == 4
    assert changed.corrections == 1 and changed.confidence < after.confidence
    assert wanted[0] == 0.90
