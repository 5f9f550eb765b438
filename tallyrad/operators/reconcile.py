"""A hospital's report against local logs, and logs against their audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import spread


def reconcile(hospital: DataFrame, local: DataFrame, order: str = "id") -> DataFrame:
    """Discrepancies: key, kind and both sides' values. Both: exam_key, cpt_code, modifier, work_rvu.

    Each hospital row meets the first local row of its key.
    """
    key = F.concat_ws("|", "exam_key", F.coalesce("cpt_code", F.lit("")))
    h = hospital.select(key.alias("key"), F.col("modifier").alias("h_modifier"), F.col("work_rvu").alias("h_wrvu"))
    mine = local.withColumn("key", key)
    first = mine.groupBy("key").agg(F.min(F.struct(order, "modifier", "work_rvu")).alias("l"))
    met = h.join(first, "key", "left")
    differs = F.array_compact(
        F.array(
            F.when(F.col("l").isNull(), "missing_local"),
            F.when(F.col("l").isNotNull() & ~F.col("h_modifier").eqNullSafe(F.col("l.modifier")), "modifier_mismatch"),
            F.when(F.abs(F.col("h_wrvu") - F.col("l.work_rvu")) > 0.01, "wrvu_difference"),
        )
    )
    of_hospital = met.select("key", F.explode(differs).alias("kind"), "h_modifier", "h_wrvu", "l.modifier", "l.work_rvu")
    absent = mine.join(h.select("key").distinct(), "key", "left_anti").select(
        "key", F.lit("missing_hospital").alias("kind"), F.lit(None).cast("string").alias("h_modifier"),
        F.lit(None).cast("double").alias("h_wrvu"), "modifier", "work_rvu",
    )
    return of_hospital.unionByName(absent)


def weighted_totals(hospital: DataFrame) -> DataFrame:
    units = F.coalesce("work_rvu", F.lit(0.0)) * F.col("quantity")
    return hospital.agg(F.sum(units).alias("wrvu"), F.sum("quantity").alias("studies"))


def audit_of_logs(logs: DataFrame, audit: DataFrame) -> DataFrame:
    """For each log (id, unique) the distinct actions of its session or its day; one join for each of both keys.

    The audit comes down to one list of distinct actions for each key before it meets the logs, so a log stays one
    row and no pairs of logs and actions are shuffled.
    """

    def of(key: str) -> DataFrame:
        return audit.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("action").alias(f"of_{key}"))

    met = spread(logs.select("id", "session_id", "log_date")).join(of("session_id"), "session_id", "left").join(of("log_date"), "log_date", "left")
    lists = [F.coalesce(f"of_{key}", F.array().cast("array<string>")) for key in ("session_id", "log_date")]
    return met.select("id", F.array_join(F.sort_array(F.array_union(*lists)), ";").alias("actions"))


def action_minutes(audit: DataFrame) -> DataFrame:
    """Average minutes between actions of a session; 0 for a single one, else at least 1."""
    spent = (F.unix_timestamp(F.max("created_at").cast("timestamp")) - F.unix_timestamp(F.min("created_at").cast("timestamp"))) / 60.0
    return audit.groupBy("session_id").agg(
        F.count("*").alias("n"),
        F.when(F.count("*") <= 1, 0).otherwise(F.greatest(F.lit(1), F.floor(spent / F.count("*") + 0.5))).cast("long").alias("minutes"),
    )
