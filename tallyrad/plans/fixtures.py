"""The domain's tables made from the driver's tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    "CT A/P W/ CON", "CT Head w/o contrast", "STAT_CTA Chest (PE)", "US ABD COMPL", "CT C/A/P wwo", "X-RAY CHEST 2V",
    "CT Abdomen & Pelvis with contrast", "CT ABD/PELVIS W", "CT HEAD W/O", "CTA Chest PE Protocol",
    "MR Brain without and with contrast", "X-Ray chest two views", "US right upper quadrant",
    "CT chest abdomen pelvis w contrast", "MRI brain", "Us exam abdom complete", "XR shldr lt 2v", "MR l-spine w/o",
    "CT angiogram code stroke head neck", "NM bone scan", "PET/CT skull to thigh", "Screening mammo bilat",
    "Fluoro swallow study", "XR ank rt 3v", "CT neck with contrast", "MRA head", "US thyroid", "CT renal stone",
    "XR CHEST 1 VIEW", "US RUQ", "CT lumbar spine w/o", "MRI knee rt w/o", "US venous le bil", "CT chest w/o",
    "CT sinus", "MRI pelvis w/wo", "XR hip lt", "XR kn rt 2v", "CTA HEAD", "CTA NECK",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TITLES)), "title_id int, title string")


def study_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as study logs."""
    k = F.get_json_object("props", "$.k").cast("int")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("event_id") % len(TITLES) + 1).cast("int"))
    modality = (
        F.when(F.col("event_type") == "signup", "CT").when(F.col("event_type") == "purchase", "MRI")
        .when(F.col("event_type") == "view", "US").when(F.col("event_type") == "click", "XR")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("profile_id"),
        F.to_date("ts").alias("log_date"),
        F.col("ts").alias("study_datetime"),
        title.alias("exam_name_raw"),
        (70000 + F.col("event_id") % 300).cast("string").alias("cpt_code"),
        F.when(F.col("event_id") % 5 != 0, "26").alias("modifier"),
        F.when(k % 17 != 0, F.col("value") / 100).alias("work_rvu"),
        modality.alias("modality"),
        F.when(k % 3 == 0, "alias_match").when(k % 3 == 1, "radiology_match").otherwise("manual_cpt").alias("match_method"),
        (F.lit(0.5) + (k % 51) / 100).alias("match_confidence"),
        (k % 10 == 0).alias("needs_review"),
        F.when(F.col("event_id") % 7 == 0, F.floor(F.col("event_id") / 14).cast("string")).alias("accession_number"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session_id"),
        F.when(k % 23 == 0, F.col("ts")).alias("deleted_at"),
    )


def cpt_rvu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a fee schedule."""
    size = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        (70000 + F.col("p_partkey") % 9000).cast("string").alias("cpt_code"),
        F.when(size == 0, "26").when(size == 2, "TC").alias("modifier"),
        F.col("p_name").alias("description"),
        (F.col("p_retailprice") / 1000).alias("work_rvu"),
        F.element_at(F.array(*[F.lit(x) for x in "ARTBCNX"]), (F.col("p_partkey") % 7 + 1).cast("int")).alias("status_code"),
        (F.col("p_size") % 5).cast("string").alias("pc_tc"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as profiles of nations (practices) and regions (organizations); every eleventh has no practice."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("practice_id"), F.col("n_name").alias("practice"), F.col("n_regionkey").alias("organization_id")
    )
    own = users.select(
        F.col("user_id").alias("profile_id"),
        F.when(F.col("user_id") % 11 != 0, (F.col("user_id") % 25).cast("int")).alias("practice_id"),
        (F.lit(300.0) + F.col("user_id") % 7 * 50).alias("annual_goal"),
    )
    return own.join(F.broadcast(nation), "practice_id", "left")


_TITLE_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in TITLES)

#: The same tables for DuckDB, to put before a query.
SQL = f"""
WITH study_logs AS (
  SELECT event_id AS id, user_id AS profile_id, CAST(ts AS DATE) AS log_date, ts AS study_datetime,
    [{_TITLE_LIST}][CAST(event_id % {len(TITLES)} + 1 AS INT)] AS exam_name_raw,
    CAST(70000 + event_id % 300 AS VARCHAR) AS cpt_code,
    CASE WHEN event_id % 5 <> 0 THEN '26' END AS modifier,
    CASE WHEN k % 17 <> 0 THEN value / 100 END AS work_rvu,
    CASE event_type WHEN 'signup' THEN 'CT' WHEN 'purchase' THEN 'MRI' WHEN 'view' THEN 'US' WHEN 'click' THEN 'XR' END AS modality,
    CASE k % 3 WHEN 0 THEN 'alias_match' WHEN 1 THEN 'radiology_match' ELSE 'manual_cpt' END AS match_method,
    CAST(0.5 AS DOUBLE) + CAST(k % 51 AS DOUBLE) / 100 AS match_confidence,
    k % 10 = 0 AS needs_review,
    CASE WHEN event_id % 7 = 0 THEN CAST(event_id // 14 AS VARCHAR) END AS accession_number,
    CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
    CASE WHEN k % 23 = 0 THEN ts END AS deleted_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
),
cpt_rvu AS (
  SELECT p_partkey AS id, CAST(70000 + p_partkey % 9000 AS VARCHAR) AS cpt_code,
    CASE p_size % 3 WHEN 0 THEN '26' WHEN 2 THEN 'TC' END AS modifier, p_name AS description,
    p_retailprice / 1000 AS work_rvu, substr('ARTBCNX', CAST(p_partkey % 7 + 1 AS INT), 1) AS status_code,
    CAST(p_size % 5 AS VARCHAR) AS pc_tc
  FROM part
),
profiles AS (
  SELECT u.user_id AS profile_id, CASE WHEN u.user_id % 11 <> 0 THEN CAST(u.user_id % 25 AS INT) END AS practice_id,
    CAST(300.0 + u.user_id % 7 * 50 AS DOUBLE) AS annual_goal, n.n_name AS practice, n.n_regionkey AS organization_id
  FROM (SELECT DISTINCT user_id FROM events) u
  LEFT JOIN nation n ON n.n_nationkey = CASE WHEN u.user_id % 11 <> 0 THEN u.user_id % 25 END
)"""
