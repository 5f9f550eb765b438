"""Totals kept up to date against a recount, after adds, edits and soft deletes."""

from pyspark.sql import functions as F

from tallyrad.operators import upkeep
from tallyrad.operators.snapshots import Change, Warehouse
from tallyrad.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def same(w):
    key = lambda df: sorted((str(r.profile_id), str(r.log_date), str(r.modality), round(r.wrvu, 6), r.studies, r.under_review) for r in df.collect())
    assert key(w.read("totals")) == key(upkeep.day_totals(w.read("logs")))


def test_adds_edits_and_deletes(spark, tmp_path, monkeypatch):
    w = Warehouse(spark, str(tmp_path / "w"))
    logs = fx.study_logs(spark, SF).where("log_date < '2024-01-08'")
    logs = logs.withColumn("log_date", F.when(F.col("id") % 50 != 0, F.col("log_date")))  # some without a day
    w.commit({"logs": Change(logs.where("id % 3 = 0"), "log_date")})
    upkeep.refresh(w)
    same(w)
    assert upkeep.refresh(w).version == w.snapshot().version == 2  # nothing changed, nothing written
    w.commit({"logs": Change(logs.where("id % 3 = 1 and log_date = '2024-01-02'"), "log_date")})
    w.commit({"logs": Change(logs.where("id % 3 = 1 and (log_date > '2024-01-04' or log_date is null)"), "log_date")})
    before = w.snapshot().folders("totals")
    upkeep.refresh(w)
    same(w)
    after = w.snapshot().folders("totals")
    assert {p for p in before if before[p] != after[p]} == {"2024-01-02", "2024-01-05", "2024-01-06", "2024-01-07", upkeep.NULL_PART}
    total = upkeep.of_day(w, "2024-01-02").agg(F.sum("wrvu")).first()[0]
    gone = w.read("logs", parts={"2024-01-02"}).where("deleted_at is null and not needs_review and work_rvu > 0").limit(3).select("id")
    deleted = lambda df: df.withColumn("deleted_at", F.when(F.col("hit"), F.lit("2024-02-01").cast("timestamp_ntz")).otherwise(F.col("deleted_at")))
    w.edit("logs", gone, "id", deleted)
    reads, real = [], Warehouse.read
    monkeypatch.setattr(Warehouse, "read", lambda self, table, like=None, parts=None, at=None: reads.append((table, parts)) or real(self, table, like, parts, at))
    upkeep.refresh(w)
    monkeypatch.setattr(Warehouse, "read", real)
    assert ("logs", {"2024-01-02"}) in reads  # only the day that was rewritten is counted again
    same(w)
    assert upkeep.of_day(w, "2024-01-02").agg(F.sum("wrvu")).first()[0] < total
    assert upkeep.of_day(w, None).count() > 0
