"""Heavy columns are computed once a row and by all tasks, whatever is asked of them afterwards."""

from pyspark.sql import functions as F

from tallyrad.functions import dates, rows
from tallyrad.operators import duplicates, records
from tallyrad.sources import readers

AS_OF = "2024-02-01 00:00:00"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_moments_are_found_once(spark):
    lines = spark.createDataFrame([(1, 1, "seen 1/5/2024"), (1, 2, "seen 2024-01-05 10:30"), (2, 1, "nothing")], "file int, line_no int, value string")
    found = records.best_moment(dates.with_moment(lines, "value", F.lit(AS_OF).cast("timestamp_ntz"), "m"), "file")
    filters = [line for line in _plan(found).splitlines() if "Filter" in line]
    assert not any("regexp" in line.lower() or "rlike" in line.lower() for line in filters)
    assert [(r.file, str(r.study_datetime), r.confidence) for r in found.collect()] == [(1, "2024-01-05 10:30:00", 1.0)]


def test_moments_of_odd_texts(spark):
    texts = {
        "2/30/2024": None, "13/1/2024": None, "1/5/24 12:07 AM": ("2024-01-05", "2024-01-05 00:07:00"), "12/31/1999 1:05 pm": ("1999-12-31", "1999-12-31 13:05:00"),
        "1/5/2024 25:10": ("2024-01-05", None), "2024-02-29T07:09": ("2024-02-29", "2024-02-29 07:09:00"), "Feb 3": ("2024-02-03", None), "1/1/0099": ("1999-01-01", None), "1/1/150": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in dates.with_moment(df, "t", F.lit(AS_OF).cast("timestamp_ntz"), "m").collect():
        want = texts.get(r.t)
        assert (r.m and (str(r.m.study_date), r.m.study_datetime and str(r.m.study_datetime))) == want, r.t


def test_lines_go_to_all_tasks(spark):
    lines = spark.range(40).select(F.format_string("CT head 1/5/2024 10:%02d ACC: A00000%02d", F.col("id"), F.col("id")).alias("value")).coalesce(1)
    found = readers.ocr_studies(lines, AS_OF)
    assert found.rdd.getNumPartitions() > 1 and found.count() == 40
    assert rows.spread(lines).rdd.getNumPartitions() >= 4


def test_typed_titles_are_normalised_once_each(spark):
    entries = spark.createDataFrame(
        [(k, 1, " CT Head w/o ", "70450", "26", 1.0, "CT", "m", 0.9, " ", "d") for k in range(3)] + [(9, 1, None, "70450", None, 1.0, "CT", "m", 0.5, "n", "d")],
        "id long, profile_id long, exam_name_raw string, cpt_code string, modifier string, work_rvu double, modality string, method string, confidence double, notes string, description string",
    ).withColumn("log_date", F.lit("2024-01-05").cast("date"))
    logs = records.manual_logs(entries)
    assert "Aggregate [exam_name_raw" in _plan(logs)
    own = duplicates.with_fingerprint(logs.select("id", F.trim("exam_name_raw").alias("exam_name_raw"), "cpt_code", "log_date", "study_datetime", "accession_number", "modality"))
    key = lambda df: {r.id: r.exam_key for r in df.collect()}
    assert key(logs) == key(own) and key(logs)[9] is None
