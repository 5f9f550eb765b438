from pyspark.sql import functions as F

from tallyrad.plans import fixtures as fx
from tallyrad.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    logs = fx.study_logs(spark, SF)
    logs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.log_stream(spark, str(tmp_path / "in"), logs.schema, files_per_batch=1)
    got = ingest.run_once(ingest.running_totals(stream), "totals", "complete", str(tmp_path / "c1"))
    want = ingest.running_totals(logs)
    key = lambda df: sorted((r.profile_id, r.log_date, round(r.wrvu, 6), r.studies, r.under_review) for r in df.collect())
    assert key(got) == key(want)


def test_commit_stream_adds_each_study_once(spark, tmp_path):
    logs = fx.study_logs(spark, SF).where("deleted_at is null").limit(200)
    logs.repartition(2).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("table", "review", "failed")]
    for checkpoint in ("c1", "c2"):  # a second checkpoint sees all files again
        stream = ingest.log_stream(spark, str(tmp_path / "in"), logs.schema, files_per_batch=1)
        ingest.commit_stream(stream, *paths, str(tmp_path / checkpoint)).awaitTermination()
    stored = spark.read.parquet(paths[0])
    assert stored.count() == stored.select("fingerprint").distinct().count() > 0
    assert stored.where(F.col("needs_review")).count() == 0
    under_review = logs.where("needs_review").count()
    assert spark.read.parquet(paths[1]).count() == under_review  # the second run wrote the same batches again


def test_flawed_rows_are_set_apart_and_batches_can_be_repeated(spark, tmp_path):
    logs = fx.study_logs(spark, SF).where("deleted_at is null").limit(60)
    bad = logs.limit(3).withColumn("exam_name_raw", F.lit(" ")).unionByName(logs.limit(2).withColumn("log_date", F.lit(None).cast("date")))
    batch = logs.unionByName(bad)
    paths = [str(tmp_path / p) for p in ("table", "review", "failed")]
    for _ in range(2):
        ingest.commit_batch(batch, 7, *paths)
    failed = spark.read.parquet(paths[2])
    assert sorted(r.error for r in failed.collect()) == ["no date"] * 2 + ["no title"] * 3
    good = spark.read.parquet(paths[0])
    assert good.count() == good.select("fingerprint").distinct().count()
    assert spark.read.parquet(paths[1]).count() == logs.where("needs_review").count()
    newest = ingest.activity(spark, *paths, logs, n=10).collect()
    assert len(newest) == 10 and newest[0].study_datetime >= newest[-1].study_datetime


def test_an_error_that_is_no_rows_ends_the_batch(spark, tmp_path):
    import pytest

    logs = fx.study_logs(spark, SF).limit(5)
    (tmp_path / "table").write_text("not a folder")
    with pytest.raises(Exception):
        ingest.commit_batch(logs, 1, str(tmp_path / "table"), str(tmp_path / "review"), str(tmp_path / "failed"))
    assert not (tmp_path / "failed").exists()


def test_images_settle(spark):
    rows = [("a", "2024-01-01 10:00:00.000", 5), ("b", "2024-01-01 10:00:00.900", 5), ("c", "2024-01-01 10:00:00.000", 0)]
    images = spark.createDataFrame(rows, "path string, t string, length long").withColumn("modificationTime", F.col("t").cast("timestamp"))
    assert [r.path for r in ingest.settled(images, F.lit("2024-01-01 10:00:01").cast("timestamp")).collect()] == ["a"]


def test_goal_states(spark, tmp_path):
    logs = fx.study_logs(spark, SF)
    logs.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.log_stream(spark, str(tmp_path / "in"), logs.schema)
    got = ingest.run_once(ingest.goal_states(stream, 1.0), "goals", "update", str(tmp_path / "c"))
    want = ingest.running_totals(logs).where("wrvu >= 1").count()
    assert got.where("reached").count() == want
