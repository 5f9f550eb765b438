"""Writing: upserts, appends that can be repeated, soft deletes, renames, audit and migrations.

Parquet has no MERGE, so an operator returns what a table is to hold; `swap` writes it beside the old version as a
new snapshot, so that readers see one or the other and of two writers neither is lost.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_description
from .snapshots import Warehouse


def upsert_fee_schedule(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Fee schedule after an import, with change (added, updated, unchanged, kept) and percent_change.

    Rows meet by code and modifier, null modifiers too. Updated: work units, description or status differ.
    """
    s, p = stored.alias("s"), parsed.alias("p")
    same = (F.col("s.cpt_code") == F.col("p.cpt_code")) & F.col("s.modifier").eqNullSafe(F.col("p.modifier"))
    differs = (
        ~F.col("s.work_rvu").eqNullSafe(F.col("p.work_rvu"))
        | ~F.col("s.description").eqNullSafe(F.col("p.description"))
        | ~F.col("s.status_code").eqNullSafe(F.col("p.status_code"))
    )
    change = (
        F.when(F.col("s.cpt_code").isNull(), "added").when(F.col("p.cpt_code").isNull(), "kept").when(differs, "updated").otherwise("unchanged")
    )
    moved = F.try_divide(F.col("p.work_rvu") - F.col("s.work_rvu"), F.col("s.work_rvu")) * 100
    new = lambda c: F.when(F.col("p.cpt_code").isNotNull(), F.col(f"p.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return s.join(p, same, "full_outer").select(
        *[new(c) for c in ("cpt_code", "modifier", "description", "work_rvu", "status_code")],
        change.alias("change"),
        F.when(change == "updated", moved).alias("percent_change"),
    )


def import_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(
        F.count("*").alias("n"),
        F.count_if(F.abs("percent_change") >= 5).alias("significant"),
        F.count_if(F.coalesce("work_rvu", F.lit(0.0)) == 0).alias("rows_without_work_rvu"),
    )


def commit(rows: DataFrame, stored: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows to append: those whose key no live row of the table has, the first of each key. Committing the
    same rows again gives none."""
    live = stored.where(F.col("deleted_at").isNull()).select(key).where(F.col(key).isNotNull()).distinct()
    first = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    return rows.join(live, key, "left_anti").withColumn("copy", first).where(F.col("copy") == 1).drop("copy").select(*rows.columns)


def missing_only(stored: DataFrame, seed: DataFrame, *keys: str) -> DataFrame:
    """Seed rows whose keys the table lacks; null keys are equal to each other."""
    a, b = seed.alias("a"), stored.select(*keys).distinct().alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_anti")


def soft_delete(logs: DataFrame, ids: list, as_of: str) -> DataFrame:
    return logs.withColumn(
        "deleted_at", F.when(F.col("id").isin(ids), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("deleted_at"))
    )


def rename(logs: DataFrame, log_id, title: str, column: str = "display_title") -> DataFrame:
    """Gives a log and all logs of its session a new title, and its description key where logs have one."""
    session = logs.where(F.col("id") == log_id).select(F.col("session_id").alias("renamed")).limit(1)
    now = logs.join(F.broadcast(session), F.col("session_id") == F.col("renamed"), "left")
    hit = F.col("renamed").isNotNull() | (F.col("id") == log_id)
    old = F.col(column) if column in logs.columns else F.lit(None).cast("string")
    now = now.withColumn(column, F.when(hit, title).otherwise(old))
    if "exam_title_normalized" in logs.columns:
        now = now.withColumn("exam_title_normalized", F.when(hit, normalize_description(F.lit(title))).otherwise(F.col("exam_title_normalized")))
    return now.drop("renamed")


def mark_reviewed(logs: DataFrame, ids: list) -> DataFrame:
    return logs.withColumn("needs_review", F.when(F.col("id").isin(ids), False).otherwise(F.col("needs_review")))


def audit_event(spark: SparkSession, action: str, summary: str, as_of: str, **more) -> DataFrame:
    row = (uuid.uuid4().hex, more.get("profile_id"), more.get("session_id"), action, summary, as_of)
    return spark.createDataFrame(
        [row], "id string, profile_id long, session_id string, action string, summary string, created_at string"
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))


def upload_days(logs: DataFrame) -> DataFrame:
    """A header row for each profile and day: total and the raw titles in order."""
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "exam_name_raw"))), lambda x: x["exam_name_raw"]), "\n")
    return logs.groupBy("profile_id", "log_date").agg(
        F.sum(F.coalesce("work_rvu", F.lit(0.0))).alias("total_wrvu"), F.count("*").alias("studies"), titles.alias("raw_text")
    )


def remote_work_rvu() -> Column:
    """What the mirror stores: nothing but professional work units."""
    return F.when((F.col("modifier") == "26") & (F.col("work_rvu") > 0), F.col("work_rvu")).otherwise(0.0)


def to_remote(logs: DataFrame, upload_day: str | None = None) -> DataFrame:
    """Logs as rows of the mirror: codes as JSON (none without a code), titles to show, professional work units only,
    and whether a log doesn't count."""
    code = F.struct("cpt_code", "modifier", "work_rvu")
    own = lambda c: F.col(c) if c in logs.columns else F.lit(None).cast("string")
    return logs.select(
        F.lit(upload_day).cast("string").alias("upload_day_id"), F.col("id").alias("local_log_id"), "profile_id", "log_date", "study_datetime",
        "exam_name_raw", F.coalesce(own("display_title"), F.col("exam_name_raw")).alias("exam_title_display"), "accession_number", "modality",
        F.to_json(F.when(F.col("cpt_code").isNotNull(), F.array(code)).otherwise(F.array().cast("array<struct<cpt_code:string,modifier:string,work_rvu:double>>"))).alias("cpt_codes"),
        remote_work_rvu().alias("modifier_26_wrvu"), "match_method", "match_confidence",
        (~F.coalesce((F.col("work_rvu") > 0) & (F.col("modifier") == "26"), F.lit(False))).alias("not_productivity_relevant"),
        "session_id", "deleted_at",
    )


def to_local(remote: DataFrame) -> DataFrame:
    """Fee rows of the mirror (all text) as rows of the table: numbers where they are numbers, defaults where they
    are missing."""
    number = lambda c: F.col(c).try_cast("double").alias(c)
    default = lambda c, value: F.coalesce(c, F.lit(value)).alias(c)
    return remote.select(
        "id", "cpt_code", "modifier", default("description", ""), number("work_rvu"), default("status_code", "A"), default("status_category", "unknown"),
        default("pc_tc", "na"), default("modality", "OTHER"), default("rvu_file_version", "remote"),
        F.coalesce(F.lower("is_user_verified").isin("true", "1"), F.lit(False)).alias("is_user_verified"),
    )


def with_default_places(organizations: DataFrame, practices: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A default organization and practice where there is none at all, and profiles without a practice in the first."""
    spark = organizations.sparkSession
    add = lambda df, row, kind: df.unionByName(spark.createDataFrame([row], kind).join(df.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_anti"))
    orgs = add(organizations, (0, "Default"), "organization_id long, name string")
    first_org = orgs.agg(F.min("organization_id").alias("organization_id"))
    placeholder = spark.createDataFrame([(0, "My Location")], "practice_id long, name string").crossJoin(first_org)  # one row each
    any_practice = practices.limit(1).select(F.lit(1).alias("any"))
    places = practices.unionByName(placeholder.join(any_practice, F.lit(True), "left_anti"))
    first = F.broadcast(places.agg(F.min("practice_id").alias("first_practice")))
    attached = profiles.join(first, F.lit(True)).withColumn("practice_id", F.coalesce("practice_id", "first_practice")).drop("first_practice")
    return orgs, places, attached


def migrate(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds columns of later versions, and fills them where they are null."""
    return df.withColumns({c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in defaults.items()})


def seed_hierarchy(spark: SparkSession, profiles: DataFrame) -> DataFrame:
    """Profiles with orphans attached to the default practice."""
    return profiles.withColumn("practice_id", F.coalesce("practice_id", F.lit(0)))


def export_day(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A day's rows for a CSV file, and its three summary rows."""
    rows = logs.orderBy("study_datetime", "id").select(
        "log_date", "study_datetime", "exam_name_raw", "cpt_code", "modifier", F.format_string("%.2f", F.coalesce("work_rvu", F.lit(0.0))).alias("work_rvu"),
        "modality", "match_method", "needs_review", "accession_number",
    )
    total = logs.agg(
        F.count("*").cast("string").alias("Studies"),
        F.format_string("%.2f", F.coalesce(F.sum("work_rvu"), F.lit(0.0))).alias("Total wRVU"),
        F.count_if(F.col("needs_review")).cast("string").alias("Needs review"),
    )
    return rows, total.unpivot([], ["Studies", "Total wRVU", "Needs review"], "measure", "value")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("quoteAll", False).mode("overwrite").csv(path)


def swap(df: DataFrame, root: str) -> str:
    """Writes a version of a table beside the others and makes it the current one; returns its folder."""
    now = Warehouse(df.sparkSession, root).replace("data", df)
    return f"{root}/{now.folders('data')[''][0]}"


def current(spark: SparkSession, root: str) -> DataFrame:
    return Warehouse(spark, root).read("data")


def append_by_date(logs: DataFrame, path: str) -> None:
    """Facts are laid out by day, which is what most reads ask for."""
    logs.write.mode("append").partitionBy("log_date").parquet(path)


def rewrite_dates(logs: DataFrame, path: str) -> None:
    """Rewrites only the days that the rows belong to."""
    logs.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("log_date").parquet(path)
