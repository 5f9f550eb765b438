"""Dates and times in free text, and calendar arithmetic with an explicit as-of moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import let
from .rows import once

_CLOCK = r"\s+(\d{1,2}):(\d{2})(?::\d{2})?\s*(AM|PM|am|pm)?\b"

# Patterns in order of trust, with the groups that hold year, month, day.
PATTERNS = {
    "US_DATE_TIME": r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})" + _CLOCK,
    "ISO_DATE_TIME": r"\b(\d{4})-(\d{2})-(\d{2})[T\s](\d{2}):(\d{2})(?::\d{2})?\b",
    "US_DASH_DATE_TIME": r"\b(\d{1,2})-(\d{1,2})-(\d{4})" + _CLOCK,
    "US_DATE_ONLY": r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b",
    "ISO_DATE_ONLY": r"\b(\d{4})-(\d{2})-(\d{2})\b",
    "ABBREV_MONTH": r"(?i)\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun\s+)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{1,2})(?:,?\s+(\d{4}))?\b",
    "RELATIVE_DATE": r"(?i)\b(Today|Yesterday)\b",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date between 1990 and 2099; null if there is no such day."""

    def made(x: Column) -> Column:
        text = F.concat_ws("-", *[x[c].cast("string") for c in ("year", "month", "day")])
        valid = x["year"].between(1990, 2099) & x["month"].between(1, 12) & x["day"].between(1, 31)
        return F.when(valid, text.try_cast("date"))

    return let(F.struct(year.alias("year"), month.alias("month"), day.alias("day")), made)


def _moment(date: Column, hour: Column, minute: Column) -> Column:
    def made(x: Column) -> Column:
        valid = x["date"].isNotNull() & x["hour"].between(0, 23) & x["minute"].between(0, 59)
        clock = F.concat_ws(":", x["hour"].cast("string"), x["minute"].cast("string"), F.lit("00"))
        return F.when(valid, F.concat_ws(" ", x["date"].cast("string"), clock).cast("timestamp_ntz"))

    return let(F.struct(date.alias("date"), hour.alias("hour"), minute.alias("minute")), made)


def with_moment(df: DataFrame, text: str, as_of: Column, into: str = "moment") -> DataFrame:
    """Adds a struct of study_datetime, study_date, confidence and pattern, or null; patterns are asked in
    order. Every step is a column of its own, so that what later steps use twice is computed once; the parts of a
    pattern are only taken from texts that it is in."""

    def part(name: str, group: int) -> Column:
        return F.regexp_extract(text, PATTERNS[name], group).try_cast("int")

    def own(name: str) -> str:
        return f"{into}:{name}"

    timed, months = ("US_DATE_TIME", "ISO_DATE_TIME", "US_DASH_DATE_TIME"), own("months")
    now = df.withColumns(
        {
            own(n): F.when(F.rlike(F.col(text), F.lit(PATTERNS[n])), F.array(*[part(n, g) for g in range(1, 6 if n in timed else 4)]))
            for n in (*timed, "US_DATE_ONLY", "ISO_DATE_ONLY")
        }
        | {months: F.lower(F.regexp_extract(text, PATTERNS["ABBREV_MONTH"], 0))}
        | {own("said"): F.lower(F.regexp_extract(text, PATTERNS["RELATIVE_DATE"], 1))}
    )
    at = lambda name, k: F.get(F.col(f"`{own(name)}`"), F.lit(k))
    has = lambda name, value: F.when(F.col(f"`{own(name)}`").isNotNull(), value)
    whole = F.col(f"`{months}`")

    def dated(name: str) -> Column:
        if name.startswith("ISO"):
            return has(name, _date(at(name, 0), at(name, 1), at(name, 2)))
        short = at(name, 2)
        year = F.when(short < 50, short + 2000).when(short < 100, short + 1900).otherwise(short)
        return has(name, _date(year, at(name, 0), at(name, 1)))

    month = F.coalesce(*[F.when(F.contains(whole, F.lit(name)), k + 1) for k, name in enumerate(MONTHS)])
    year = F.coalesce(F.regexp_extract(whole, r"\b(20\d{2})\b", 1).try_cast("int"), F.year(as_of))
    day = F.regexp_extract(whole, r"\b(\d{1,2})\b", 1).try_cast("int")
    said = F.col(f"`{own('said')}`")
    relative = F.when(said == "yesterday", F.date_sub(F.to_date(as_of), 1)).when(said == "today", F.to_date(as_of))
    found = {n: dated(n) for n in (*timed, "US_DATE_ONLY", "ISO_DATE_ONLY")}
    found |= {"ABBREV_MONTH": F.when(whole != "", _date(year, month, day)), "RELATIVE_DATE": relative}
    now = now.withColumns({own(n) + ":date": d for n, d in found.items()})
    date = lambda name: F.col(f"`{own(name)}:date`")

    def clock(name: str) -> Column:
        hour, half = at(name, 3), F.upper(F.regexp_extract(text, PATTERNS[name], 6)) if name.startswith("US") else F.lit("")
        full = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
        return F.when(date(name).isNotNull(), _moment(date(name), full, at(name, 4)))

    now = now.withColumns({own(n) + ":time": clock(n) for n in timed})
    nothing = F.lit(None).cast("timestamp_ntz")
    results = []
    for name in found:
        time = F.col(f"`{own(name)}:time`") if name in timed else nothing
        trust = 1.0 if name in timed else {"ABBREV_MONTH": 0.75, "RELATIVE_DATE": 0.5}.get(name, 0.85)
        results.append(
            F.when(
                time.isNotNull() if name in timed else date(name).isNotNull(),
                F.struct(
                    time.alias("study_datetime"), date(name).alias("study_date"), F.lit(trust).alias("confidence"), F.lit(name).alias("pattern")
                ),
            )
        )
    chosen = F.when(F.length(F.trim(text)) >= 3, F.coalesce(*results))
    return once(now, into, chosen).select(*[F.col(f"`{c}`") for c in df.columns if c != into], into)


def hhmm(text: Column) -> Column:
    """Minutes since midnight of HH:MM; what isn't a time counts as 0."""
    parts = F.split(text, ":")
    return F.coalesce(F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int"), F.lit(0))


def minutes_of_day(moment: Column) -> Column:
    return F.hour(moment) * 60 + F.minute(moment)


def sunday_week(date: Column) -> Column:
    return F.date_sub(date, F.dayofweek(date) - 1)


def span_label(minutes: Column) -> Column:
    """Xh Ym."""
    whole = F.round(F.abs(minutes)).cast("int")
    hours, rest = F.floor(whole / 60).cast("int"), whole % 60
    return F.when(hours == 0, F.format_string("%dm", rest)).when(rest == 0, F.format_string("%dh", hours)).otherwise(
        F.format_string("%dh %dm", hours, rest)
    )
