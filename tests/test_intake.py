"""The stream from images to committed logs, against one batch over the same lines."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tallyrad.operators import imports
from tallyrad.operators.snapshots import Change, Warehouse
from tallyrad.plans import analytics
from tallyrad.sources import readers
from tallyrad.streaming import arrivals, intake

AS_OF = "2024-01-20 12:00:00"
SCHEDULE = [("70553", "Mri brain without and with contrast"), ("76705", "Echo exam of abdomen"), ("70450", "Ct head/brain w/o dye"), ("71250", "Ct thorax without contrast")]
#: Lines of recognised images: sure ones by alias, unknown ones, metadata, and one image without a study.
IMAGES = {
    "a.png": ["Accession Number", "MRI brain 1/15/2024 9:05 AM ACC: A0000001", "US RUQ 1/15/2024 9:40 AM ACC: A0000002"],
    "b.png": ["US RUQ 1/16/2024 8:00 AM ACC: A0000003", "Frobnication of the gizzard 1/16/2024 8:30 AM"],
    "c.png": ["MRI brain 1/15/2024 9:05 AM ACC: A0000001", "MRI brain 1/17/2024 7:15 PM ACC: A0000004"],
    "d.png": ["Accession Number"],
}


@pytest.fixture
def store(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    schedule = spark.createDataFrame([(c, "26", t, 1.5, "A", "0") for c, t in SCHEDULE], "cpt_code string, modifier string, description string, work_rvu double, status_code string, pc_tc string")
    aliases = analytics._aliases(spark, [(4, 0, "mri brain", ["70553-26"], 0.98, 9, 0, 0), (5, 0, "us ruq", ["76705-26"], 0.97, 9, 0, 0)])
    w.commit({"schedule": Change(schedule), "aliases": Change(aliases), "entries": Change(analytics._entries(spark))})
    return w


def facts(w):
    rows = w.read("logs").collect()
    return sorted((r.exam_name_raw, str(r.log_date), str(r.study_datetime), r.cpt_code, r.work_rvu, r.fingerprint, r.match_method) for r in rows)


def queued(w):
    return sorted((r.exam_title, r.review_reason, str(r.log_date)) for r in w.read("queue").collect())


def lines(spark, names=IMAGES):
    rows = [(n, k, v) for n in names for k, v in enumerate(IMAGES[n])]
    return spark.createDataFrame(rows, "path string, line_no int, value string")


def test_a_stream_of_images_equals_one_batch(spark, tmp_path, store):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, (name, own) in enumerate(IMAGES.items()):
        (folder / name).write_bytes("\n".join(own).encode())
        os.utime(folder / name, (time.time() - 100 + k,) * 2)

    def go(checkpoint, log):
        images = arrivals.settled_files(spark, str(folder), str(tmp_path / log), files_per_batch=2)
        intake.import_stream(readers.ocr_images(images, lambda content: content.decode().split("\n")), store, str(tmp_path / checkpoint), AS_OF, f"stream-{checkpoint}", pin=1).awaitTermination()

    for _ in range(3):  # two files for each batch, and nothing more
        go("c1", "l1")
    other = Warehouse(spark, str(tmp_path / "other"))
    other.commit({t: Change(store.read(t)) for t in ("schedule", "aliases", "entries")})
    every = lines(spark)
    intake.import_batch(other, intake.line_studies(every, AS_OF), 0, other.snapshot(), "batch", files=every)
    assert facts(store) == facts(other) and len(facts(store)) == 4
    assert queued(store) == queued(other) and [q[0] for q in queued(store)] == ["Frobnication of the gizzard"]
    counters = intake.totals(store).first()
    assert (counters.files, counters.committed, counters.under_review, counters.wrvu) == (4, 4, 1, 6.0)
    by_file = {os.path.basename(r.path): (r.outcome, r.committed, r.skipped) for r in store.read("activity").collect()}
    assert by_file == {"a.png": ("committed", 2, 0), "b.png": ("needs_review", 1, 0), "c.png": ("committed", 1, 1), "d.png": ("skipped", 0, 0)}


def test_a_repeated_batch_adds_nothing(spark, store):
    studies = intake.line_studies(lines(spark), AS_OF)
    pin = store.snapshot()
    first = intake.import_batch(store, studies, 7, pin, "s")
    assert intake.import_batch(store, studies, 7, pin, "s").version == first.version
    # a change of the schedule after the pin is not seen by the stream
    store.replace("schedule", store.read("schedule").where("cpt_code = '70450'"))
    before = len(facts(store))
    again = lines(spark, ["a.png"]).withColumn("value", F.replace("value", F.lit("1/15/2024"), F.lit("1/18/2024"))).withColumn("value", F.replace("value", F.lit("A000"), F.lit("B000")))
    intake.import_batch(store, intake.line_studies(again, AS_OF), 8, pin, "s")
    assert len(facts(store)) == before + 2


def test_a_batch_opens_only_its_days(spark, tmp_path):
    """Logs of many other days make no difference to the files that are read."""
    store = Warehouse(spark, str(tmp_path / "w"))
    like = imports.committed_logs(intake._no_rows(intake.line_studies(lines(spark), AS_OF)), "s", None).schema

    def day(k, number, month=1):
        own = spark.createDataFrame([(f"{k}a", f"acc:A{number}"), (f"{k}b", f"fp:mri brain|70553|2024-{month:02d}-{k:02d}|09:05")], "id string, fingerprint string")
        rows = own.withColumn("log_date", F.lit(f"2024-{month:02d}-{k:02d}").cast("date"))
        return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like])

    read = []
    for k in range(1, 7):
        intake.commit_logs(store, day(k, k), "s", k)
        at = store.snapshot()
        known, relied = intake.committed_prints(store, day(1, 1), at)
        assert known.count() == 2
        read.append(sum(len(f) for table, parts in relied.items() for f in at.folders(table, parts).values()))
    assert len(set(read)) == 1 and len(at.folders("logs")) == 6
    # a number comes again on another day: found by the index, so only the row without one is new
    before = store.read("logs").count()
    known, relied = intake.committed_prints(store, day(2, 3, month=2), at)
    assert relied["logs"] == {"2024-01-03", "2024-02-02"} and known.where("fingerprint = 'acc:A3'").count() == 1
    intake.commit_logs(store, day(2, 3, month=2), "s", 7)
    intake.commit_logs(store, day(2, 3, month=2), "t", 1)
    assert store.read("logs").count() == before + 1


def test_two_streams_into_the_same_days(spark, store, monkeypatch):
    """The second writer finds the first one's logs after a conflict, and adds only what is new."""
    pin = store.snapshot()
    real, once = Warehouse.commit, []

    def late(self, changes, base=None, relied=None, by=None, number=0):
        if by == "b" and not once:
            once.append(1)
            intake.import_batch(self, intake.line_studies(lines(spark, ["a.png"]), AS_OF), 0, pin, "a")
        return real(self, changes, base, relied, by, number)

    monkeypatch.setattr(Warehouse, "commit", late)
    intake.import_batch(store, intake.line_studies(lines(spark, ["a.png", "b.png"]), AS_OF), 0, pin, "b")
    assert len(facts(store)) == 3 and len({f[5] for f in facts(store)}) == 3


def test_several_codes_make_several_logs(spark, store):
    aliases = analytics._aliases(spark, [(4, 0, "ct head and chest", ["70450-26", "71250-26"], 0.99, 9, 0, 0)])
    study = spark.createDataFrame([("s1", "CT head and chest")], "id string, exam_title string").selectExpr(
        "*", "cast(null as string) cpt", "date'2024-01-05' log_date", "timestamp_ntz'2024-01-05 10:00:00' study_datetime", "1.0D date_time_confidence", "cast(null as string) accession_number", "cast(null as string) modality"
    )
    none = store.read("logs", imports.committed_logs(intake._no_rows(study), "i", 1))
    rows = imports.import_rows(study, store.read("schedule"), none, aliases)
    both = rows.withColumn("selected", F.array(F.lit(0), F.lit(1)))
    found = imports.committed_logs(both, "i", 1).orderBy("cpt_code").collect()
    assert [r.cpt_code for r in found] == ["70450", "71250"] and len({r.session_id for r in found}) == 1
    assert found[0].notes == "Combined CPT study: Ct head/brain w/o dye + Ct thorax without contrast"
    assert rows.first().candidates[0].explanation == "alias to Ct head/brain w/o dye, 100%"
