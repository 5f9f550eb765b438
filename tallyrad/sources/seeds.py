"""Rows and settings that the engine comes with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import stable_id

# Verified rows of a fee schedule, all without modifier, active and global.
SEED_FEES = [
    ("71045", "X-ray exam chest 1 view", 0.18, "XR"), ("71046", "X-ray exam chest 2 views", 0.21, "XR"),
    ("70450", "Ct head/brain w/o dye", 0.83, "CT"), ("71250", "Ct thorax dx c-", 1.05, "CT"),
    ("72125", "Ct neck spine w/o dye", 0.98, "CT"), ("74176", "Ct abd & pelvis w/o contrast", 1.70, "CT"),
    ("74177", "Ct abd & pelvis w/contrast", 1.77, "CT"), ("74178", "Ct abd&plv wo cntr flwd cntr", 1.96, "CT"),
    ("70551", "Mri brain stem w/o dye", 1.44, "MRI"), ("72141", "Mri neck spine w/o dye", 1.44, "MRI"),
    ("72148", "Mri lumbar spine w/o dye", 1.44, "MRI"), ("73721", "Mri jnt of lwr extre w/o dye", 1.32, "MRI"),
    ("76700", "Us exam abdom complete", 0.79, "US"), ("77067", "Scr mammo bi incl cad", 0.74, "MAMMO"),
]

# Exams to add with one press, with estimated work units.
QUICK_ADDS = [
    ("ct-ap", "CT Abdomen/Pelvis w contrast", 3.3), ("ct-chest", "CT Chest w contrast", 2.3), ("cta-pe", "CTA Chest PE", 3.5),
    ("ct-head", "CT Head", 1.9), ("mri-brain", "MRI Brain", 2.7), ("mri-abd", "MRI Abdomen", 3.8),
    ("us-abd", "Ultrasound Abdomen", 1.4), ("mammo", "Mammogram/Tomo", 1.5), ("pet-ct", "PET/CT", 3.0), ("xray", "X-ray", 0.5),
]

# Settings of a new user.
DEFAULT_SETTINGS = {
    "annual_rvu_goal": "15000", "daily_rvu_goal": "90", "fiscal_year_start_month": "1", "low_confidence_threshold": "0.75",
    "workdays_per_week": "5", "vacation_days_planned": "0", "workday_start": "08:00", "workday_end": "17:00", "break_minutes": "0",
    "default_rvu_type": "work", "theme": "system", "active_rvu_file_version": "RVU26A",
}

# What a status of the day's pace is called.
STATUS_LABELS = {
    "before_work": "Shift Not Started", "goal_achieved": "Goal Achieved", "ahead": "Ahead of Pace", "on_track": "On Track",
    "slightly_behind": "Slightly Behind", "behind": "Behind Pace", "after_work": "Shift Complete",
}


def seed_fees(spark: SparkSession) -> DataFrame:
    """The verified rows as a fee schedule."""
    rows = spark.createDataFrame(SEED_FEES, "cpt_code string, description string, work_rvu double, modality string")
    return rows.select(
        F.concat(F.lit("seed_"), "cpt_code", F.lit("_none")).alias("id"), "cpt_code", F.lit(None).cast("string").alias("modifier"),
        "description", "work_rvu", F.lit("A").alias("status_code"), F.lit("active").alias("status"), F.lit("global").alias("pc_tc"), "modality",
        F.lit("SEED_VERIFIED").alias("rvu_file_version"),
    )


def quick_adds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUICK_ADDS, "id string, name string, work_rvu double")


def status_label(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])[status]


def dictionary_fees(entries: DataFrame) -> DataFrame:
    """Rows of a fee schedule from dictionary entries (ord, cpt_codes, display_name, cms_description, modifier_26_wrvu,
    modality): the first of each code and modifier. Work units belong to the professional part."""
    codes = entries.select("*", F.posexplode("cpt_codes").alias("place", "code"))
    parts = F.split("code", "-")
    rows = codes.withColumn("cpt_code", F.trim(parts[0])).withColumn("modifier", F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")))
    order = Window.partitionBy("cpt_code", "modifier").orderBy("ord", "place")
    first = rows.where(F.col("cpt_code") != "").withColumn("copy", F.row_number().over(order)).where(F.col("copy") == 1)
    own = F.col("modifier").isNull() | (F.col("modifier") == "26")
    return first.select(
        stable_id("curated_dictionary_cpt", F.col("cpt_code"), F.col("modifier")).alias("id"), "cpt_code", "modifier",
        F.coalesce(F.nullif("cms_description", F.lit("")), "display_name").alias("description"),
        F.when(own, F.col("modifier_26_wrvu")).alias("work_rvu"),
        F.when(F.col("modifier") == "26", "professional").otherwise("na").alias("pc_tc"), "modality",
    )


def settings(stored: DataFrame, patch: DataFrame) -> DataFrame:
    """Settings as (name, value): a patch's value, else the stored one, else the default. Names that only a patch or
    the store has stay."""
    spark = stored.sparkSession
    default = spark.createDataFrame(list(DEFAULT_SETTINGS.items()), "name string, value string")
    own = lambda df, n: df.select("name", F.struct(F.lit(n).alias("rank"), "value").alias("v"))
    every = own(patch, 0).unionByName(own(stored, 1)).unionByName(own(default, 2))
    return every.groupBy("name").agg(F.min("v")["value"].alias("value"))
