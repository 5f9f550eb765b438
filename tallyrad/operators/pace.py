"""Pace within a day and within a fiscal year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import js_round
from ..functions.dates import hhmm
from .totals import counted


def daily_pace(current: DataFrame, goal: Column, start: Column, end: Column, pause: Column, now: Column) -> DataFrame:
    """Adds the day's pace to rows with current_wrvu. start, end: HH:MM; now: minutes since midnight."""
    goal = F.greatest(F.lit(1.0), goal)
    first, last = hhmm(start), hhmm(end)
    shift = F.greatest(F.lit(1), F.greatest(F.lit(0), last - first) - F.greatest(F.lit(0), pause))
    has = F.col("current_wrvu")
    before, after = now < first, now >= last
    elapsed = F.when(before, 0).when(after, shift).otherwise(F.least(shift, now - first))
    left = F.when(before, shift).when(after, 0).otherwise(F.greatest(F.lit(0), shift - elapsed))
    expected = F.when(before, 0.0).when(after, goal).otherwise(elapsed / shift * goal)
    ahead = F.when(before, 0.0).otherwise(has - expected)
    percent = has / goal * 100
    share = ahead / goal * 100
    remaining = F.greatest(F.lit(0.0), goal - has)
    return current.select(
        "*",
        goal.alias("daily_goal"),
        percent.alias("percent_complete"),
        elapsed.cast("int").alias("elapsed_minutes"),
        left.cast("int").alias("remaining_minutes"),
        shift.cast("int").alias("shift_minutes"),
        expected.alias("expected_wrvu"),
        F.when(before, 0.0).when(after, 100.0).otherwise(F.least(F.lit(100.0), expected / goal * 100)).alias("expected_percent"),
        F.when(before | after, percent).otherwise(F.least(F.lit(100.0), percent)).alias("actual_percent"),
        ahead.alias("pace_difference"),
        (ahead / (goal / shift)).alias("minutes_ahead"),
        F.when(before, 0.0).when(after, has).otherwise(F.coalesce(F.try_divide(has, elapsed) * shift, F.lit(0.0))).alias("projected_wrvu"),
        remaining.alias("remaining_wrvu"),
        F.when(before, goal / (shift / 60)).when(after, 0.0).otherwise(F.coalesce(F.try_divide(remaining, left) * 60, F.lit(0.0))).alias("required_per_hour"),
        F.when(before, "before_work")
        .when(has >= goal, "goal_achieved")
        .when(after, "after_work")
        .when(share >= 5, "ahead")
        .when(share >= -5, "on_track")
        .when(share >= -15, "slightly_behind")
        .otherwise("behind")
        .alias("status"),
    )


def simple_pace(current: DataFrame, goal: float, start: str, end: str, lunch: int, now: int) -> DataFrame:
    """The older pace: lunch comes off the elapsed time, and the status goes by percent of what was expected."""
    first, last = hhmm(F.lit(start)), hhmm(F.lit(end))
    total = F.greatest(last - first - lunch, F.lit(1))
    elapsed = F.least(F.greatest(F.lit(now) - first - lunch, F.lit(0)), total)
    has = F.col("current_wrvu")
    expected = F.when(elapsed > 0, F.lit(float(goal)) * elapsed / total).otherwise(0.0)
    remaining = F.greatest(F.lit(float(goal)) - has, F.lit(0.0))
    share = F.when(expected > 0, has / expected * 100).otherwise(100.0)
    return current.select(
        "*",
        expected.alias("expected_wrvu"),
        F.coalesce(F.try_divide(has, elapsed) * total, F.lit(0.0)).alias("projected_wrvu"),
        F.least(has / goal * 100, F.lit(100.0)).alias("percent_complete"),
        share.alias("percent_of_expected"),
        remaining.alias("remaining_wrvu"),
        (remaining / F.greatest(total - elapsed, F.lit(1)) * 60).alias("required_per_hour"),
        F.when(has >= goal, "goal-hit")
        .when(expected == 0, "on-track")
        .when(share > 110, "ahead")
        .when(share >= 90, "on-track")
        .when(share >= 75, "falling-behind")
        .otherwise("danger-zone")
        .alias("status"),
    )


def year_to_date(
    logs: DataFrame, as_of: str, goal: Column, fiscal_month: int = 1, workdays: int = 5, vacation: int = 0
) -> DataFrame:
    """Per profile: work units of the year and what they lead to. as_of is a moment; from noon on the day counts."""
    moment = F.lit(as_of).cast("timestamp_ntz")
    start = F.make_date(F.year(moment), F.lit(fiscal_month), F.lit(1))
    days = F.datediff(F.add_months(start, 12), start)
    noon = F.when(F.hour(moment) >= 12, 1).otherwise(0)
    elapsed = F.greatest(F.lit(1), F.least(days, F.datediff(F.to_date(moment), start) + noon + 1))
    left = F.greatest(F.lit(0), days - elapsed)
    free = F.greatest(F.lit(0), js_round(left * (workdays / 7)) - vacation).cast("int")
    sums = logs.where(~F.col("needs_review")).groupBy("profile_id").agg(
        F.sum(counted(True)).alias("ytd_wrvu"), F.count("*").alias("studies"), F.first(goal).alias("annual_goal")
    )
    remaining = F.greatest(F.lit(0.0), F.col("annual_goal") - F.col("ytd_wrvu"))
    expected = F.col("annual_goal") * elapsed / days
    return sums.select(
        "profile_id", "ytd_wrvu", "studies", "annual_goal",
        F.coalesce(F.try_divide(F.col("ytd_wrvu"), F.nullif(F.col("annual_goal"), F.lit(0.0))) * 100, F.lit(0.0)).alias("percent_to_goal"),
        remaining.alias("remaining_wrvu"),
        elapsed.alias("days_elapsed"), left.alias("days_left"), free.alias("workdays_left"),
        F.coalesce(F.try_divide(remaining, free), F.lit(0.0)).alias("required_per_workday"),
        (F.col("ytd_wrvu") / (elapsed / days)).alias("projected_wrvu"),
        (F.col("ytd_wrvu") / elapsed).alias("daily_average"),
        F.when(F.col("ytd_wrvu") >= F.col("annual_goal"), "achieved")
        .when(F.col("ytd_wrvu") >= expected * 0.97, "on_pace").otherwise("behind").alias("status"),
    )
