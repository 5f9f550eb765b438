"""From recognised lines to committed logs, batch after batch, in one warehouse of snapshots.

Every micro-batch is matched against one pinned version of schedule, aliases and dictionary, checked against the logs
of its own days, and committed with its queue of rows under review, its activity and its index entries in one
snapshot that carries the batch's number. A batch that comes again finds its number and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import imports
from ..operators.snapshots import Change, Conflict, Snapshot, Warehouse
from ..operators.staging import cut
from ..sources import readers

#: Buckets of the index of accession numbers, and attempts at a commit that meets other writers.
BUCKETS, ATTEMPTS = 64, 5
NUMBERS = "bucket int, fingerprint string, log_date date"


def _parts(df: DataFrame, column: str) -> set[str]:
    """The distinct values of a partition column: days or buckets, which are few whatever the rows."""
    return {r.v for r in df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().collect()}


def _bucketed(df: DataFrame) -> DataFrame:
    """Rows whose fingerprint is an accession number, with the bucket of the index."""
    own = df.where(F.col("fingerprint").startswith("acc:"))
    return own.withColumn("bucket", F.pmod(F.xxhash64("fingerprint"), F.lit(BUCKETS)).cast("int"))


def committed_prints(warehouse: Warehouse, rows: DataFrame, at: Snapshot) -> tuple[DataFrame, dict[str, set[str]]]:
    """Fingerprints of live logs that rows (fingerprint, log_date) may have, and the parts of tables that were read.

    A fingerprint with a day in it can only be in that day. An accession number is looked up in its bucket of the
    index, which says in which days it was committed. So a batch reads its own days, its buckets and the days of
    numbers that came before; other days are neither listed nor opened.
    """
    days, numbers = _parts(rows.where(F.col("fingerprint").startswith("fp:")), "log_date"), _bucketed(rows)
    buckets = _parts(numbers, "bucket")
    index = warehouse.read("numbers", warehouse.spark.createDataFrame([], NUMBERS), buckets, at)
    days |= _parts(index.join(numbers.select("fingerprint"), "fingerprint", "left_semi"), "log_date")
    live = warehouse.read("logs", rows, days, at).where(F.col("deleted_at").isNull())
    return live.select("fingerprint").distinct(), {"logs": days, "numbers": buckets}


def commit_logs(
    warehouse: Warehouse, logs: DataFrame, by: str, number: int, more: dict[str, Change] | None = None, tally: Callable[[DataFrame], DataFrame] | None = None
) -> Snapshot:
    """Commits logs (with fingerprint) that aren't there yet, the first of each fingerprint, with their index entries
    and further changes. tally: makes rows of the table activity from the logs that are new."""
    logs = cut(logs)
    for _ in range(ATTEMPTS):
        base = warehouse.snapshot()
        if base.done.get(by, -1) >= number:
            return base
        known, relied = committed_prints(warehouse, logs, base)
        first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("id"))
        ready = cut(logs.join(known, "fingerprint", "left_anti").withColumn("copy", first).where("copy = 1").select(*logs.columns))
        changes = {"logs": Change(ready, "log_date"), "numbers": Change(_bucketed(ready).select("bucket", "fingerprint", "log_date"), "bucket")}
        if tally:
            changes["activity"] = Change(tally(ready))
        try:
            return warehouse.commit(changes | (more or {}), base, relied, by, number)
        except Conflict:
            continue  # another writer was in the same days: look again
    raise Conflict(f"other writers kept changing the days of {by}/{number}")


def line_studies(lines: DataFrame, as_of: str) -> DataFrame:
    """Studies of recognised lines (path, line_no, value), see imports.STUDY; a line without a date is of the day
    `as_of`."""
    found = readers.ocr_studies(lines, as_of)
    return found.select(
        F.concat_ws("#", "path", F.col("line_no").cast("string")).alias("id"), F.col("exam_name").alias("exam_title"), F.lit(None).cast("string").alias("cpt"),
        F.coalesce("study_date", F.to_date(F.lit(as_of))).cast("date").alias("log_date"), F.col("study_datetime").cast("timestamp_ntz").alias("study_datetime"),
        F.col("confidence").alias("date_time_confidence"), "accession_number", F.lit(None).cast("string").alias("modality"), "path",
    )


def import_batch(
    warehouse: Warehouse, studies: DataFrame, number: int, pin: Snapshot, by: str, profile_id: int | None = None, files: DataFrame | None = None
) -> Snapshot:
    """Imports one batch: sure rows are committed, others queued, skipped rows and files (path) without studies counted.

    pin: the snapshot whose tables schedule, aliases and entries are matched against. Adds to the tables logs and
    numbers; to queue (rows under review, by day); and to activity (a row for each file: outcome, studies committed,
    under review and skipped, and work units).
    """
    now = warehouse.snapshot()
    if now.done.get(by, -1) >= number:
        return now
    studies = cut(studies)
    schedule = warehouse.read("schedule", at=pin)
    aliases, entries = (warehouse.read(t, at=pin) if t in pin.tables else None for t in ("aliases", "entries"))
    like = imports.committed_logs(_no_rows(studies), by, profile_id).schema
    stored = warehouse.read("logs", like, _parts(studies, "log_date"), now).where(F.col("deleted_at").isNull())
    rows = cut(imports.import_rows(studies, schedule, stored, aliases, entries).withColumn("batch", F.lit(number)))
    sure = ~F.col("needs_review")
    logs = imports.committed_logs(rows.where(sure), f"{by}/{number}", profile_id)
    under_review = rows.where((F.col("route") == "review") & ~sure)

    def activity(ready: DataFrame) -> DataFrame:
        """What became of each file: of its studies those that were read, and of its logs those that are new."""
        own = F.regexp_replace("session_id", r"#\d+$", "")
        wrvu = ready.groupBy(F.substr(own, F.lit(len(f"{by}/{number}/") + 1)).alias("path"))
        wrvu = wrvu.agg(F.sum("work_rvu").alias("wrvu"), F.count("*").alias("committed"))
        seen = rows.groupBy("path").agg(
            F.count_if((F.col("route") == "review") & ~sure).alias("under_review"), F.count_if(F.col("route") == "skipped").alias("skipped")
        )
        some = (seen if files is None else files.select("path").distinct().join(seen, "path", "left")).join(wrvu, "path", "left")
        some = some.fillna(0, ["wrvu", "committed", "under_review", "skipped"])
        outcome = F.when(F.col("under_review") > 0, "needs_review").when(F.col("committed") > 0, "committed").otherwise("skipped")
        return some.select(F.lit(number).alias("batch"), "path", outcome.alias("outcome"), "committed", "under_review", "skipped", "wrvu")

    return commit_logs(warehouse, logs, by, number, {"queue": Change(under_review, "log_date")}, activity)


def _no_rows(studies: DataFrame) -> DataFrame:
    """Rows of the shape that an import makes, none of them; only its schema is asked for."""
    from ..operators.review import classify

    c = "array<struct<cpt_code: string, modifier: string, description: string, work_rvu: double, modality: string, confidence: double, method: string, explanation: string>>"
    none = studies.limit(0).withColumns(
        {"candidates": F.lit(None).cast(c), "duplicate_status": F.lit(None).cast("string"), "title": F.col("exam_title"), "exam_name_raw": F.col("exam_title")}
    )
    return classify(none)


def import_stream(lines: DataFrame, warehouse: Warehouse, checkpoint: str, as_of: str, by: str, pin: int | None = None, profile_id: int | None = None, once: bool = True):
    """A stream of recognised lines (path, line_no, value) imported batch by batch. pin: the version of the warehouse
    that all batches are matched against, by default the newest when the stream starts."""
    reference = warehouse.snapshot(pin)

    def process(batch: DataFrame, number: int) -> None:
        import_batch(warehouse, line_studies(batch, as_of), number, reference, by, profile_id, batch)

    writer = lines.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def totals(warehouse: Warehouse, at: Snapshot | None = None) -> DataFrame:
    """Counters of all that was imported: files, studies committed and under review, and work units."""
    kind = "batch int, path string, outcome string, committed long, under_review long, skipped long, wrvu double"
    rows = warehouse.read("activity", warehouse.spark.createDataFrame([], kind), at=at)
    return rows.agg(
        F.count_distinct("path").alias("files"), F.coalesce(F.sum("committed"), F.lit(0)).alias("committed"),
        F.coalesce(F.sum("under_review"), F.lit(0)).alias("under_review"), F.coalesce(F.sum("wrvu"), F.lit(0.0)).alias("wrvu"),
    )
