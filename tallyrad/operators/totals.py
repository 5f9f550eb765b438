"""Work units by day, modality, period, profile and hierarchy. `logs` are study logs; times are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import sunday_week
from ..functions.terms import MODALITIES


def counted(include_review: bool = False) -> Column:
    """Work units that count: none for rows under review unless asked, null as 0."""
    units = F.coalesce(F.col("work_rvu"), F.lit(0.0))
    return units if include_review else F.when(~F.col("needs_review"), units).otherwise(0.0)


def live(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("deleted_at").isNull())


def sum_work(logs: DataFrame, *keys: str, include_review: bool = False) -> DataFrame:
    return logs.groupBy(*keys).agg(F.sum(counted(include_review)).alias("total_wrvu"))


def by_modality(logs: DataFrame, include_review: bool = False) -> DataFrame:
    """A row for every modality, also for those without logs; no modality counts as OTHER."""
    every = logs.sparkSession.createDataFrame([(m,) for m in MODALITIES], "modality string")
    sums = (
        logs.groupBy(F.coalesce("modality", F.lit("OTHER")).alias("modality"))
        .agg(F.sum(counted(include_review)).alias("wrvu"))
    )
    return F.broadcast(every).join(sums, "modality", "left").select("modality", F.coalesce("wrvu", F.lit(0.0)).alias("wrvu"))


def daily(logs: DataFrame, hours: float | None = None) -> DataFrame:
    """Per profile and day: total, studies, average, hourly rate and a column for each modality."""
    own = F.coalesce("modality", F.lit("OTHER"))
    ready = logs.where(~F.col("needs_review"))
    found = ready.groupBy("profile_id", "log_date").agg(
        F.sum(counted()).alias("total_wrvu"),
        F.count("*").alias("studies"),
        *[F.sum(F.when(own == m, counted()).otherwise(0.0)).alias(f"wrvu_{m.lower()}") for m in MODALITIES],
    )
    found = found.withColumn("average_wrvu", F.try_divide(F.col("total_wrvu"), F.col("studies")))
    return found if hours is None else found.withColumn("hourly_wrvu", F.try_divide(F.col("total_wrvu"), F.lit(hours)))


def period(logs: DataFrame, *keys: str) -> DataFrame:
    found = logs.where(~F.col("needs_review")).groupBy(*keys).agg(
        F.sum(counted()).alias("total_wrvu"), F.count("*").alias("studies")
    )
    return found.withColumn("average_wrvu", F.coalesce(F.try_divide(F.col("total_wrvu"), F.col("studies")), F.lit(0.0)))


def range_average(logs: DataFrame, days: int, *keys: str) -> DataFrame:
    found = sum_work(logs, *keys)
    return found.withColumn("daily_average", F.col("total_wrvu") / F.lit(float(days)) if days > 0 else F.lit(0.0))


def logs_by_date(logs: DataFrame) -> DataFrame:
    """Logs with the number of logs of their day; a day's logs stay rows, however many there are."""
    counts = logs.groupBy("log_date").agg(F.count("*").alias("n"))
    return logs.join(counts, "log_date").select("log_date", "id", "n")


def trends(logs: DataFrame) -> DataFrame:
    """Totals by day, week (from Sunday) and month; rows under review count 0."""
    one = logs.groupBy("log_date").agg(F.sum(counted()).alias("wrvu"))
    grain = F.explode(
        F.array(
            F.struct(F.lit("day").alias("grain"), F.col("log_date").cast("string").alias("bucket")),
            F.struct(F.lit("week").alias("grain"), sunday_week(F.col("log_date")).cast("string").alias("bucket")),
            F.struct(F.lit("month").alias("grain"), F.date_format("log_date", "yyyy-MM").alias("bucket")),
        )
    )
    return one.select(grain.alias("g"), "wrvu").groupBy("g.grain", "g.bucket").agg(F.sum("wrvu").alias("wrvu"))


def rolling_logged(logs: DataFrame, days: int = 7, *keys: str) -> DataFrame:
    """Average over the last `days` days that have logs, for every day that has logs."""
    one = logs.groupBy(*keys, "log_date").agg(F.sum(counted()).alias("wrvu"))
    frame = Window.partitionBy(*keys).orderBy("log_date").rowsBetween(1 - days, 0)
    return one.withColumn("rolling_wrvu", F.avg("wrvu").over(frame))


def latest_buckets(logs: DataFrame) -> DataFrame:
    return trends(logs).groupBy("grain").agg(F.max("bucket").alias("bucket"), F.max_by("wrvu", "bucket").alias("wrvu"))


def last_days(logs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """The last calendar days, zero where nothing was logged."""
    day = F.explode(F.sequence(F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date")))
    every = logs.sparkSession.range(1).select(day.alias("log_date"))
    inside = logs.where(F.col("log_date").between(F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date")))
    sums = inside.groupBy("log_date").agg(F.sum(counted()).alias("wrvu"))
    return F.broadcast(every).join(sums, "log_date", "left").select("log_date", F.coalesce("wrvu", F.lit(0.0)).alias("wrvu"))


def modality_share(logs: DataFrame) -> DataFrame:
    """Share of each modality that has work units, largest first."""
    sums = by_modality(logs).where(F.col("wrvu") > 0)
    total = sums.agg(F.sum("wrvu").alias("all_wrvu"))
    return sums.join(F.broadcast(total), how="inner").select(
        "modality", "wrvu", (F.col("wrvu") / F.col("all_wrvu") * 100).alias("percent")
    ).orderBy(F.desc("wrvu"), "modality")


def quality_counts(logs: DataFrame, *keys: str) -> DataFrame:
    """Studies, those under review, those approved by a known alias, accuracy and minutes saved."""
    approved = (F.col("match_method") == "alias_match") & ~F.col("needs_review")
    found = logs.groupBy(*keys).agg(
        F.count("*").alias("studies"),
        F.count_if(F.col("needs_review")).alias("under_review"),
        F.count_if(approved).alias("approved"),
        F.sum(counted()).alias("total_wrvu"),
    )
    return found.select(
        *keys, "studies", "under_review", "approved",
        ((F.col("studies") - F.col("under_review")) / F.col("studies") * 100).alias("accuracy"),
        (F.col("approved") / F.col("studies") * 100).alias("approved_percent"),
        F.floor(F.col("studies") * 0.35 + 0.5).alias("minutes_saved"),
        F.try_divide(F.col("total_wrvu"), F.col("studies")).alias("average_wrvu"),
    )


def confidence_histogram(logs: DataFrame) -> DataFrame:
    level = F.when(F.col("match_confidence") >= 0.9, "high").when(F.col("match_confidence") >= 0.75, "medium").otherwise("low")
    return logs.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def by_profile(logs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every profile with its practice, counted work units, studies and goal."""
    sums = logs.groupBy("profile_id").agg(F.sum(counted()).alias("wrvu"), F.count_if(~F.col("needs_review")).alias("studies"))
    return profiles.join(sums, "profile_id", "left").select(
        "profile_id", F.coalesce("practice", F.lit("unassigned")).alias("practice"), "annual_goal",
        F.coalesce("wrvu", F.lit(0.0)).alias("wrvu"), F.coalesce("studies", F.lit(0)).alias("studies"),
    )


def by_practice(logs: DataFrame, profiles: DataFrame) -> DataFrame:
    return by_profile(logs, profiles).groupBy("practice").agg(
        F.count("*").alias("members"), F.sum("annual_goal").alias("goal"), F.sum("wrvu").alias("wrvu"), F.sum("studies").alias("studies")
    )


def hierarchy_rollup(logs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Organization, practice and profile totals in one pass (an extension)."""
    return (
        logs.join(profiles, "profile_id")
        .rollup("organization_id", "practice_id", "profile_id")
        .agg(F.grouping_id().cast("long").alias("level"), F.sum(counted()).alias("wrvu"), F.count("*").alias("studies"))
    )


def scope(logs: DataFrame, profile_ids: DataFrame) -> DataFrame:
    """Logs of the given profiles (column profile_id), and those that belong to no profile."""
    return logs.where(F.col("profile_id").isNotNull()).join(profile_ids, "profile_id", "left_semi").unionByName(
        logs.where(F.col("profile_id").isNull())
    )


def running_total(logs: DataFrame) -> DataFrame:
    """Work units so far on each profile's day, in order of study time."""
    order = Window.partitionBy("profile_id", "log_date").orderBy("study_datetime", "id").rowsBetween(Window.unboundedPreceding, 0)
    return logs.select("id", "profile_id", "log_date", F.sum(counted()).over(order).alias("running_wrvu"))


def milestones(logs: DataFrame, goal: float) -> DataFrame:
    """The log at which a profile's day crosses 25, 50, 75 and 100 percent of the goal."""
    order = Window.partitionBy("profile_id", "log_date").orderBy("study_datetime", "id")
    total = F.sum(counted()).over(order.rowsBetween(Window.unboundedPreceding, 0))
    steps = logs.select("id", "profile_id", "log_date", "study_datetime", (total / goal * 100).alias("percent"))
    steps = steps.withColumn("before", F.coalesce(F.lag("percent").over(order), F.lit(0.0)))
    marks = F.explode(F.array(*[F.lit(m) for m in (25, 50, 75, 100)]))
    return steps.withColumn("milestone", marks).where(
        (F.col("before") < F.col("milestone")) & (F.col("percent") >= F.col("milestone"))
    ).select("profile_id", "log_date", "milestone", "id")
