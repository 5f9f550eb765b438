"""Review sessions in a stream: batches, restarts, ends and silence, against the merge of all rows at once."""

import datetime

from pyspark.sql import functions as F

from tallyrad.operators import sessions
from tallyrad.streaming import reviews


def event(session, ord, minute, event="append", title="CT head", number=None, route="review"):
    at = datetime.datetime(2024, 1, 5, 8, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minute)
    return (session, 1, event, ord, at, title, number, datetime.date(2024, 1, 5), "08:00", route, None)


def run(spark, tmp_path, batches, **options):
    """Each batch is a file; the query is started anew for every one."""
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, reviews.EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(spark.createDataFrame([], reviews.EVENTS).schema).parquet(str(folder))
        query = reviews.sessions(stream, **options).writeStream.format("parquet").outputMode("append")
        query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.schema(reviews.OUT).parquet(str(tmp_path / "out")).collect()


def test_three_batches_and_restarts_equal_one_merge(spark, tmp_path):
    titles = ["CT head", "ct  head w/o", "MRI brain", "US RUQ", "CT HEAD"]
    rows = [event("s", i, i, title=titles[i * 7 % 5], number=f"A{i % 4}" if i % 3 else None) for i in range(30)]
    found = run(spark, tmp_path, [rows[:10], rows[10:21], rows[21:]])
    frame = spark.createDataFrame(rows, reviews.EVENTS)
    want = sessions.merge_rows(frame.limit(0), frame).collect()
    key = lambda rows: sorted((r.ord, r.route, r.duplicate_status) for r in rows)
    assert key(r for r in found if r.kind == "row") == key(want)
    last = max((r for r in found if r.kind == "session"), key=lambda r: r.rows)
    assert last.rows == 30 and last.skipped == sum(r.route == "skipped" for r in want) > 0


def test_ends_and_what_comes_after(spark, tmp_path):
    batches = [
        [event("s", 1, 0), event("t", 2, 0)],
        [event("s", 3, 5), event("s", 4, 6, "finalize"), event("t", 5, 7, "discard")],
        [event("s", 6, 8), event("s", 7, 9)],
    ]
    found = run(spark, tmp_path, batches)
    routes = {r.ord: r.route for r in found if r.kind == "row"}
    assert routes == {1: "review", 2: "review", 3: "skipped", 6: "review", 7: "skipped"}
    ends = sorted((r.session_id, r.status, r.rows, r.skipped) for r in found if r.kind == "session" and r.status != "active")
    assert ends == [("s", "finalized", 2, 1), ("t", "discarded", 1, 0)]


def test_silence_ends_a_session(spark, tmp_path):
    found = run(spark, tmp_path, [[event("s", 1, 0)], [event("t", 2, 600)], [event("t", 3, 601)], [event("s", 4, 602)]], silence="2 hours", late="1 minute")
    expired = [(r.session_id, r.rows) for r in found if r.status == "expired"]
    assert expired == [("s", 1)]
    assert {r.ord: r.route for r in found if r.kind == "row"}[4] == "review"  # the session had been forgotten


def test_keys_of_rows(spark):
    rows = [("A1", "CT ABD/PELVIS W", "2024-01-01", "10:00"), ("A1", "CT Abdomen & Pelvis with contrast", "2024-01-01", "10:00"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "accession_number string, title string, study_date string, study_time string")
    a, b, c = (r.k for r in frame.select(sessions.row_key().alias("k")).collect())
    assert a == b == "A1|CT ABD AND PEL W|2024-01-01|10:00" and c == "|||"
    assert frame.select(F.col("title")).count() == 3
