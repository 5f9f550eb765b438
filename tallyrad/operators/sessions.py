"""Review sessions: merging batches, picking the active one, committing and discarding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_description
from .snapshots import Change, Snapshot, Warehouse
from .tables import audit_event

SESSION = "session_id string, profile_id long, status string, updated_at timestamp, rows_json string"


def row_key(title_key: Column | None = None) -> Column:
    """Four parts that tell a row: accession number, title in its normal form, date and time."""
    return F.concat_ws(
        "|",
        F.coalesce("accession_number", F.lit("")),
        F.coalesce(normalize_description(F.col("title")) if title_key is None else title_key, F.lit("")),
        F.coalesce(F.col("study_date").cast("string"), F.lit("")),
        F.coalesce(F.col("study_time"), F.lit("")),
    )


def merge_rows(current: DataFrame, added: DataFrame, order: str = "ord") -> DataFrame:
    """Current rows and added ones; rows whose key is there already are skipped as very likely duplicates."""
    both = current.withColumn("side", F.lit(0)).unionByName(added.withColumn("side", F.lit(1)))
    titles = both.select("title").distinct().withColumn("title_key", normalize_description(F.col("title")))  # once each
    both = both.join(titles, "title", "left")
    first = F.row_number().over(Window.partitionBy(row_key(F.col("title_key"))).orderBy("side", order))
    repeated = (F.col("side") == 1) & (F.col("copy") > 1)
    return (
        both.withColumn("copy", first)
        .withColumn("route", F.when(repeated, "skipped").otherwise(F.col("route")))
        .withColumn("duplicate_status", F.when(repeated, "very_likely").otherwise(F.col("duplicate_status")))
        .select(*current.columns)
    )


def active_session(sessions: DataFrame, profile_id: int | None) -> DataFrame:
    """The profile's newest active session, or else the newest active one of all."""
    own = F.col("profile_id").eqNullSafe(F.lit(profile_id).cast("long"))
    return sessions.where(F.col("status") == "active").orderBy(own.desc(), F.desc("updated_at"), "session_id").limit(1)


def saved(rows: DataFrame, session_id: str, profile_id: int, as_of: str) -> DataFrame:
    """A session's rows as one record with JSON. A session is what one person reviews, so it is small."""
    record = F.to_json(F.collect_list(F.struct(*rows.columns)))
    return rows.agg(record.alias("rows_json")).select(
        F.lit(session_id).alias("session_id"), F.lit(profile_id).cast("long").alias("profile_id"), F.lit("active").alias("status"),
        F.lit(as_of).cast("timestamp").alias("updated_at"), "rows_json",
    )


def loaded(session: DataFrame, schema) -> DataFrame:
    """A saved session's rows; malformed JSON gives none."""
    from pyspark.sql.types import ArrayType

    return session.select(F.explode(F.from_json("rows_json", ArrayType(schema))).alias("r")).select("r.*")


def with_status(sessions: DataFrame, session_id: str, status: str, as_of: str) -> DataFrame:
    hit = F.col("session_id") == session_id
    return sessions.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn(
        "updated_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))
    )


#: The audit's names of a session's ends.
ENDED = {"finalized": "day_finalized", "discarded": "day_reopened"}


def finish(warehouse: Warehouse, session_id: str, status: str, as_of: str, profile_id: int | None = None, logs: DataFrame | None = None) -> Snapshot:
    """Ends a session (finalized or discarded): its status in `sessions`, a line in `audit` and, if it was finalized,
    its rows in `logs` (by day) are one commit. A session that isn't active any more is left as it is."""
    base = warehouse.snapshot()
    stored = warehouse.read("sessions", at=base)
    if stored.where((F.col("session_id") == session_id) & (F.col("status") == "active")).isEmpty():
        return base
    summary = "Discarded active review session"
    if status == "finalized":
        counts = (0, 0) if logs is None else logs.agg(F.count("*"), F.count_if(F.col("needs_review"))).first()
        summary = f"Finalized {counts[0]} studies; {counts[1]} still marked for review"
    audit = audit_event(warehouse.spark, ENDED[status], summary, as_of, profile_id=profile_id, session_id=session_id)
    changes = {"sessions": Change(with_status(stored, session_id, status, as_of), None, "all"), "audit": Change(audit)}
    if status == "finalized" and logs is not None:
        changes["logs"] = Change(logs, "log_date")
    return warehouse.commit(changes, base, {"sessions": None})
