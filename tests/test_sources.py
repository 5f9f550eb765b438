import zipfile

import pytest
from pyspark.sql import functions as F

from tallyrad.operators import review, sessions, tables
from tallyrad.sources import readers

FEES = """Fee schedule,,,,,
,,,,,WORK,,,,,,,,
HCPCS,MOD,DESCRIPTION,STATUS,X,RVU,PE,X,FAC,X,MP,TOT,FTOT,IND,GLOB
70450,26,"Ct head, no dye",A,,0.85,1.1,,1.2,,0.1,2,3,1,XXX
71260,,Ct thorax,R,,"1,234.5",NA,,,,,,,0,
bad row!,,x,,,,,,,,,,,,
"""


def test_fee_schedule_csv_and_zip(spark, tmp_path):
    (tmp_path / "PPRRVU2026.csv").write_text("﻿" + FEES)
    with zipfile.ZipFile(tmp_path / "rvu.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("PPRRVU_nonQPP.csv", FEES)
    for name in ("PPRRVU2026.csv", "rvu.zip"):
        rows = {r.cpt_code: r for r in readers.fee_schedule(spark, str(tmp_path / name)).collect()}
        assert set(rows) == {"70450", "71260"}
        assert rows["70450"].modifier == "26" and rows["70450"].work_rvu == 0.85 and rows["70450"].pc_tc == "professional"
        assert rows["71260"].work_rvu == 1234.5 and rows["71260"].nonfacility_pe_rvu is None and rows["71260"].modifier is None


def test_fee_schedule_without_header_is_refused():
    with pytest.raises(ValueError, match="header"):
        readers.header_of([["a", "b"], ["c", "d"]])
    at, places, warning = readers.header_of([["CPT", "Work RVU"]])
    assert at == 0 and places == {"hcpcs": 0, "work_rvu": 1} and warning


def test_bulk_text(spark):
    def entries(*lines):
        rows = readers.bulk_entries(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
        return [r.entry for r in rows.orderBy("line_no", "place").collect()]

    assert entries("70450 71260") == ["70450", "71260"]
    assert entries("CT head, MRI brain") == ["CT head", "MRI brain"]
    assert entries("CT abdomen pelvis") == ["CT abdomen pelvis"]
    assert entries("CT head", " ", "ct HEAD", "70450") == ["CT head", "70450"]


def test_studies_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Exam Name,CPT,wRVU,Date,Modality,Other\n"CT head, w/o",70450,0.85,6/28/2026,ct,x\n,,,,,\nMRI brain,,,2026-06-29,zz,y\n')
    rows = readers.studies_csv(spark, str(path)).orderBy("exam_title").collect()
    assert [(r.exam_title, r.cpt, r.work_rvu, str(r.study_date), r.modality) for r in rows] == [
        ("CT head, w/o", "70450", 0.85, "2026-06-28", "CT"), ("MRI brain", None, None, "2026-06-29", None)
    ]
    path.write_text("CT head\n70450 71260\n")
    assert readers.studies_csv(spark, str(path)).count() == 3


def test_ocr_lines(spark):
    lines = ["CT HEAD W/O 6/28/26 2:05 PM ACC: AB12345", "Patient Name: X", "MRN 1234567", "MRI BRAIN 12345678", "ab"]
    rows = readers.ocr_studies(spark.createDataFrame([(x,) for x in lines], "value string"), "2026-06-28 00:00:00").collect()
    got = {r.exam_name: r for r in rows}
    assert set(got) == {"CT HEAD W/O", "MRI BRAIN"}
    assert got["CT HEAD W/O"].accession_number == "AB12345" and str(got["CT HEAD W/O"].study_datetime) == "2026-06-28 14:05:00"
    assert got["MRI BRAIN"].accession_number == "12345678"


def test_hospital_report(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Exam,CPT,Mod,wRVU,Qty\nCT head,70450,26,,3\n,70553,,1.5\n")
    rows = readers.hospital_report(spark, str(tmp_path / "h.csv")).collect()
    assert [(r.exam_title, r.cpt_code, r.modifier, r.work_rvu, r.quantity) for r in rows] == [
        ("CT head", "70450", "26", 0.0, 3.0), ("Untitled exam", "70553", None, 1.5, 1.0)
    ]


CANDIDATES = "id int, title string, duplicate_status string, candidates array<struct<cpt_code:string,modifier:string,description:string,work_rvu:double,modality:string,confidence:double,method:string>>"


def test_review_rules(spark):
    good = ("70450", "26", "Ct head", 0.85, "CT", 0.99, "alias_match")
    weak = ("71260", "26", "Ct thorax", 1.2, "CT", 0.80, "radiology_match")
    biopsy = ("19083", "26", "Breast biopsy", 3.0, "PROCEDURE", 0.97, "radiology_match")
    rows = spark.createDataFrame(
        [(1, "ct head", None, [good]), (2, "ct chest", None, [weak]), (3, "?", None, []), (4, "ct head", "exact", [good]), (5, "biopsy", None, [biopsy]), (6, "ct", "possible", [good, weak])],
        CANDIDATES,
    )
    got = {r.id: r for r in review.classify(rows).collect()}
    assert got[1].auto_approved and not got[1].needs_review and got[1].approval_level == "silent"
    assert got[2].review_reason == "Low confidence match" and got[2].selected == [0]
    assert got[3].review_reason == "New or unknown exam" and got[3].selected == []
    assert got[4].route == "skipped" and got[6].review_reason == "Possible duplicate"
    safe = {r.id: r.safe for r in review.classify(rows).select("id", review.safe_approval().alias("safe")).collect()}
    assert safe == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    approved = review.approve(review.classify(rows), F.col("id") == 1).where("id = 1").first()
    assert approved.selected == [0] and approved.needs_review is False
    both = review.select_candidates(review.classify(rows), F.col("id") == 6, [0, 1, 7]).where("id = 6").first()
    assert both.selected == [0, 1] and both.needs_review
    moved = review.choose_first(review.classify(rows), F.col("id") == 6, "71260", "26").where("id = 6").first()
    assert [c.cpt_code for c in moved.candidates] == ["71260", "70450"] and not moved.needs_review
    taken = review.force_include(review.classify(rows), [4]).where("id = 4").first()
    assert taken.route == "review" and taken.duplicate_status is None and taken.needs_review
    added = review.add_selection(review.classify(rows), F.col("id") == 1, F.array(F.struct(*[F.lit(v).alias(n) for v, n in zip(weak, ("cpt_code", "modifier", "description", "work_rvu", "modality", "confidence", "method"))])))
    assert added.where("id = 1").first().selected == [0, 1]


def test_commit_is_repeatable(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None)], "id int, fingerprint string, deleted_at timestamp_ntz")
    none = rows.limit(0)
    first = tables.commit(rows, none)
    assert sorted(r.id for r in first.collect()) == [1, 3]
    assert tables.commit(rows, first).count() == 0
    root = str(tmp_path / "t")
    tables.swap(rows, root)
    tables.swap(rows.where("id > 1"), root)
    assert tables.current(spark, root).count() == 2


def test_upsert(spark):
    schema = "cpt_code string, modifier string, description string, work_rvu double, status_code string"
    stored = spark.createDataFrame([("1", None, "x", 1.0, "A"), ("2", "26", "y", 2.0, "A"), ("3", None, "z", 3.0, "A")], schema)
    parsed = spark.createDataFrame([("1", None, "x", 1.1, "A"), ("2", "26", "y", 2.0, "A"), ("2", None, "n", 0.0, "A")], schema)
    changes = tables.upsert_fee_schedule(stored, parsed)
    got = {(r.cpt_code, r.modifier): (r.change, r.work_rvu) for r in changes.collect()}
    assert got == {("1", None): ("updated", 1.1), ("2", "26"): ("unchanged", 2.0), ("2", None): ("added", 0.0), ("3", None): ("kept", 3.0)}
    counts = {r.change: (r.n, r.significant) for r in tables.import_counts(changes).collect()}
    assert counts["updated"] == (1, 1)


def test_sessions(spark):
    schema = "ord int, accession_number string, title string, study_date date, study_time string, route string, duplicate_status string"
    a = spark.createDataFrame([(1, "A1", "ct", None, None, "review", None)], schema)
    b = spark.createDataFrame([(1, "A1", "CT ", None, None, "review", None), (2, None, "mri", None, None, "review", None)], schema)
    merged = sessions.merge_rows(a, b)
    assert sorted((r.title, r.route) for r in merged.collect()) == [("CT ", "skipped"), ("ct", "review"), ("mri", "review")]
    saved = sessions.saved(merged, "s1", 7, "2026-01-01")
    assert sessions.loaded(saved, merged.schema).count() == 3
    assert sessions.active_session(saved, 9).first().session_id == "s1"
    assert sessions.with_status(saved, "s1", "done", "2026-01-02").where("status = 'active'").count() == 0
