"""Queries over work units: totals, trends, pace, hierarchy, duplicates, learning, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, dates
from ..functions import text as T
from ..functions.terms import MODALITIES
from ..operators import duplicates, learning, matching, pace, reconcile, totals
from . import fixtures as fx
from . import sqltext
from .fixtures import SQL as PRE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF_DAY, AS_OF = "2024-01-20", "2024-01-20 10:00:00"
COUNTED = "CASE WHEN needs_review THEN 0.0 ELSE coalesce(work_rvu, 0.0) END"


def query(sql: str | None = None):
    """Registers a function as a query by its name, with the SQL that checks it."""

    def keep(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: plain_dates(function(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def plain_dates(df: DataFrame) -> DataFrame:
    """Dates as text, which every reader shows alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_BY_MODALITY = ", ".join(
    f"round(sum(CASE WHEN coalesce(modality, 'OTHER') = '{m}' THEN coalesce(work_rvu, 0.0) ELSE 0.0 END), 8) AS wrvu_{m.lower()}"
    for m in MODALITIES
)


@query(
    PRE
    + f"""
SELECT profile_id, CAST(log_date AS VARCHAR) AS log_date, round(sum(coalesce(work_rvu, 0)), 8) AS total_wrvu, count(*) AS studies, {_BY_MODALITY},
  round(sum(coalesce(work_rvu, 0)) / count(*), 8) AS average_wrvu, round(sum(coalesce(work_rvu, 0)) / 8.0, 8) AS hourly_wrvu
FROM study_logs WHERE NOT needs_review GROUP BY profile_id, study_logs.log_date"""
)
def daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(totals.daily(fx.study_logs(spark, sf_dir), hours=8.0))


@query(PRE + f"SELECT profile_id, round(sum({COUNTED}), 8) AS total_wrvu FROM study_logs GROUP BY 1")
def sum_work(spark, sf_dir):
    return rounded(totals.sum_work(fx.study_logs(spark, sf_dir), "profile_id"))


_DENSE = f"""
m AS (SELECT unnest(['CT','MRI','US','XR','NM_PET','MAMMO','FLUORO','PROCEDURE','OTHER']) AS modality),
s AS (SELECT coalesce(modality, 'OTHER') AS modality, sum({COUNTED}) AS wrvu FROM study_logs GROUP BY 1),
d AS (SELECT modality, coalesce(wrvu, 0.0) AS wrvu FROM m LEFT JOIN s USING (modality))"""


@query(PRE + "," + _DENSE + " SELECT modality, round(wrvu, 8) AS wrvu FROM d")
def modality_totals(spark, sf_dir):
    return rounded(totals.by_modality(fx.study_logs(spark, sf_dir)))


@query(PRE + "," + _DENSE + " SELECT modality, round(wrvu, 8) AS wrvu, round(wrvu / sum(wrvu) OVER () * 100, 8) AS percent FROM d WHERE wrvu > 0")
def modality_share(spark, sf_dir):
    return rounded(totals.modality_share(fx.study_logs(spark, sf_dir)))


@query(
    PRE
    + """
SELECT modality, round(sum(coalesce(work_rvu, 0)), 8) AS total_wrvu, count(*) AS studies,
  round(sum(coalesce(work_rvu, 0)) / count(*), 8) AS average_wrvu
FROM study_logs WHERE NOT needs_review AND log_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1"""
)
def period_totals(spark, sf_dir):
    inside = F.col("log_date").between("2024-01-05", "2024-01-25")
    return rounded(totals.period(fx.study_logs(spark, sf_dir).where(inside), "modality"))


@query(PRE + f"SELECT profile_id, round(sum({COUNTED}), 8) AS total_wrvu, round(sum({COUNTED}) / 30, 8) AS daily_average FROM study_logs GROUP BY 1")
def range_average(spark, sf_dir):
    return rounded(totals.range_average(fx.study_logs(spark, sf_dir), 30, "profile_id"))


@query(PRE + "SELECT CAST(l.log_date AS VARCHAR) AS log_date, id, count(*) OVER (PARTITION BY l.log_date) AS n FROM study_logs l")
def logs_by_date(spark, sf_dir):
    return totals.logs_by_date(fx.study_logs(spark, sf_dir))


_TRENDS = f"""
d AS (SELECT log_date, sum({COUNTED}) AS wrvu FROM study_logs GROUP BY 1),
g AS (
  SELECT 'day' AS grain, CAST(log_date AS VARCHAR) AS bucket, wrvu FROM d
  UNION ALL SELECT 'week', CAST(CAST(log_date - CAST(dayofweek(log_date) AS INT) AS DATE) AS VARCHAR), wrvu FROM d
  UNION ALL SELECT 'month', strftime(log_date, '%Y-%m'), wrvu FROM d
),
t AS (SELECT grain, bucket, sum(wrvu) AS wrvu FROM g GROUP BY 1, 2)"""


@query(PRE + "," + _TRENDS + " SELECT grain, bucket, round(wrvu, 8) AS wrvu FROM t")
def trends(spark, sf_dir):
    return rounded(totals.trends(fx.study_logs(spark, sf_dir)))


@query(PRE + "," + _TRENDS + " SELECT grain, max(bucket) AS bucket, round(arg_max(wrvu, bucket), 8) AS wrvu FROM t GROUP BY 1")
def latest_buckets(spark, sf_dir):
    return rounded(totals.latest_buckets(fx.study_logs(spark, sf_dir)))


@query(
    PRE
    + f""", d AS (SELECT profile_id, log_date, sum({COUNTED}) AS wrvu FROM study_logs GROUP BY 1, 2)
SELECT profile_id, CAST(log_date AS VARCHAR) AS log_date, round(wrvu, 8) AS wrvu, round(avg(wrvu) OVER (PARTITION BY profile_id ORDER BY d.log_date
  ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 8) AS rolling_wrvu FROM d"""
)
def rolling_logged(spark, sf_dir):
    return rounded(totals.rolling_logged(fx.study_logs(spark, sf_dir), 7, "profile_id"))


@query(
    PRE
    + f""", days AS (SELECT CAST(unnest(range(DATE '2024-01-28', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS log_date),
s AS (SELECT log_date, sum({COUNTED}) AS wrvu FROM study_logs GROUP BY 1)
SELECT CAST(log_date AS VARCHAR) AS log_date, round(coalesce(wrvu, 0.0), 8) AS wrvu FROM days LEFT JOIN s USING (log_date)"""
)
def last_seven_days(spark, sf_dir):
    return rounded(totals.last_days(fx.study_logs(spark, sf_dir), "2024-02-03"))


@query(
    PRE
    + f"""
SELECT CAST(l.log_date AS VARCHAR) AS log_date, count(*) AS studies, count(*) FILTER (needs_review) AS under_review,
  count(*) FILTER (match_method = 'alias_match' AND NOT needs_review) AS approved,
  round(count(*) FILTER (NOT needs_review) / count(*) * 100, 8) AS accuracy,
  round(count(*) FILTER (match_method = 'alias_match' AND NOT needs_review) / count(*) * 100, 8) AS approved_percent,
  CAST(floor(count(*) * CAST(0.35 AS DOUBLE) + 0.5) AS BIGINT) AS minutes_saved, round(sum({COUNTED}) / count(*), 8) AS average_wrvu
FROM study_logs l GROUP BY l.log_date"""
)
def quality_counts(spark, sf_dir):
    return rounded(totals.quality_counts(fx.study_logs(spark, sf_dir), "log_date"))


@query(
    PRE
    + """
SELECT CASE WHEN match_confidence >= 0.9 THEN 'high' WHEN match_confidence >= 0.75 THEN 'medium' ELSE 'low' END AS level,
  count(*) AS n FROM study_logs GROUP BY 1"""
)
def confidence_histogram(spark, sf_dir):
    return totals.confidence_histogram(fx.study_logs(spark, sf_dir))


_BY_PROFILE = f"""
s AS (SELECT profile_id, sum({COUNTED}) AS wrvu, count(*) FILTER (NOT needs_review) AS studies FROM study_logs GROUP BY 1),
p AS (SELECT profile_id, coalesce(practice, 'unassigned') AS practice, annual_goal, coalesce(wrvu, 0.0) AS wrvu,
  coalesce(studies, 0) AS studies FROM profiles LEFT JOIN s USING (profile_id))"""


@query(PRE + "," + _BY_PROFILE + " SELECT profile_id, practice, annual_goal, round(wrvu, 8) AS wrvu, studies FROM p")
def profile_cards(spark, sf_dir):
    return rounded(totals.by_profile(fx.study_logs(spark, sf_dir), fx.profiles(spark, sf_dir)))


@query(
    PRE + "," + _BY_PROFILE
    + """ SELECT practice, count(*) AS members, round(sum(annual_goal), 8) AS goal, round(sum(wrvu), 8) AS wrvu,
  CAST(sum(studies) AS BIGINT) AS studies FROM p GROUP BY 1"""
)
def practice_groups(spark, sf_dir):
    return rounded(totals.by_practice(fx.study_logs(spark, sf_dir), fx.profiles(spark, sf_dir)))


@query(
    PRE
    + f"""
SELECT coalesce(CAST(p.organization_id AS VARCHAR), '-') AS organization_id, coalesce(CAST(p.practice_id AS VARCHAR), '-') AS practice_id,
  coalesce(CAST(profile_id AS VARCHAR), '-') AS profile_id, CAST(grouping_id(p.organization_id, p.practice_id, profile_id) AS BIGINT) AS level,
  round(sum({COUNTED}), 8) AS wrvu, count(*) AS studies
FROM study_logs JOIN profiles p USING (profile_id) GROUP BY ROLLUP (p.organization_id, p.practice_id, profile_id)"""
)
def hierarchy_rollup(spark, sf_dir):
    found = totals.hierarchy_rollup(fx.study_logs(spark, sf_dir), fx.profiles(spark, sf_dir))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in found.columns[:3]]
    return rounded(found.select(*keys, "level", "wrvu", "studies"))


@query(
    PRE
    + f"""
SELECT id, profile_id, CAST(log_date AS VARCHAR) AS log_date, round(sum({COUNTED}) OVER (PARTITION BY profile_id, l.log_date ORDER BY study_datetime, id
  ROWS UNBOUNDED PRECEDING), 8) AS running_wrvu FROM study_logs l"""
)
def running_total(spark, sf_dir):
    return rounded(totals.running_total(fx.study_logs(spark, sf_dir)))


@query(
    PRE
    + f""", t AS (
  SELECT *, sum({COUNTED}) OVER (PARTITION BY profile_id, log_date ORDER BY study_datetime, id ROWS UNBOUNDED PRECEDING) / 3.0 * 100 AS pct
  FROM study_logs),
b AS (SELECT *, coalesce(lag(pct) OVER (PARTITION BY profile_id, log_date ORDER BY study_datetime, id), 0) AS was FROM t)
SELECT profile_id, CAST(log_date AS VARCHAR) AS log_date, milestone, id FROM b, (VALUES (25), (50), (75), (100)) v(milestone) WHERE was < milestone AND pct >= milestone"""
)
def goal_milestones(spark, sf_dir):
    return totals.milestones(fx.study_logs(spark, sf_dir), 3.0)


def _pace_sql(now: int) -> str:
    return (
        PRE
        + f""", c AS (SELECT profile_id, coalesce(sum(CASE WHEN NOT needs_review THEN work_rvu END), 0.0) AS has
  FROM study_logs WHERE log_date = DATE '{AS_OF_DAY}' GROUP BY 1),
v AS (SELECT *, CAST(3.0 AS DOUBLE) AS goal, 480 AS shift, CAST(least(480, {now} - 480) AS DOUBLE) AS el FROM c),
w AS (SELECT *, el / shift * goal AS expected, greatest(0.0, goal - has) AS rest, shift - el AS left_ FROM v)
SELECT profile_id, round(has, 8) AS current_wrvu, goal AS daily_goal, round(has / goal * 100, 8) AS percent_complete,
  CAST(el AS INT) AS elapsed_minutes, CAST(left_ AS INT) AS remaining_minutes, shift AS shift_minutes, round(expected, 8) AS expected_wrvu,
  round(least(100.0, expected / goal * 100), 8) AS expected_percent, round(least(100.0, has / goal * 100), 8) AS actual_percent,
  round(has - expected, 8) AS pace_difference, round((has - expected) / (goal / shift), 8) AS minutes_ahead,
  round(has / el * shift, 8) AS projected_wrvu, round(rest, 8) AS remaining_wrvu, round(rest / left_ * 60, 8) AS required_per_hour,
  CASE WHEN has >= goal THEN 'goal_achieved' WHEN (has - expected) / goal * 100 >= 5 THEN 'ahead'
    WHEN (has - expected) / goal * 100 >= -5 THEN 'on_track' WHEN (has - expected) / goal * 100 >= -15 THEN 'slightly_behind' ELSE 'behind' END AS status
FROM w"""
    )


def _current(spark, sf_dir):
    logs = fx.study_logs(spark, sf_dir).where(F.col("log_date") == AS_OF_DAY)
    return logs.groupBy("profile_id").agg(
        F.coalesce(F.sum(F.when(~F.col("needs_review"), F.col("work_rvu"))), F.lit(0.0)).alias("current_wrvu")
    )


def _pace(spark, sf_dir, now: int):
    lit = F.lit
    return rounded(pace.daily_pace(_current(spark, sf_dir), lit(3.0), lit("08:00"), lit("17:00"), lit(60), lit(now)))


@query(_pace_sql(780))
def daily_pace(spark, sf_dir):
    return _pace(spark, sf_dir, 780)


_CURRENT_SQL = f""", c AS (SELECT profile_id, coalesce(sum(CASE WHEN NOT needs_review THEN work_rvu END), 0.0) AS has
  FROM study_logs WHERE log_date = DATE '{AS_OF_DAY}' GROUP BY 1)"""


@query(
    PRE + _CURRENT_SQL
    + """ SELECT profile_id, round(has, 8) AS current_wrvu, CAST(3.0 AS DOUBLE) AS daily_goal, round(has / 3 * 100, 8) AS percent_complete, 0 AS elapsed_minutes, 480 AS remaining_minutes, 480 AS shift_minutes,
  CAST(0 AS DOUBLE) AS expected_wrvu, CAST(0 AS DOUBLE) AS expected_percent, round(has / 3 * 100, 8) AS actual_percent, CAST(0 AS DOUBLE) AS pace_difference, CAST(0 AS DOUBLE) AS minutes_ahead,
  CAST(0 AS DOUBLE) AS projected_wrvu, round(greatest(0.0, 3 - has), 8) AS remaining_wrvu, CAST(0.375 AS DOUBLE) AS required_per_hour, 'before_work' AS status FROM c"""
)
def daily_pace_before(spark, sf_dir):
    """The day's pace before the shift starts."""
    return _pace(spark, sf_dir, 400)


@query(
    PRE + _CURRENT_SQL
    + """ SELECT profile_id, round(has, 8) AS current_wrvu, CAST(3.0 AS DOUBLE) AS daily_goal, round(has / 3 * 100, 8) AS percent_complete, 480 AS elapsed_minutes, 0 AS remaining_minutes, 480 AS shift_minutes,
  CAST(3 AS DOUBLE) AS expected_wrvu, CAST(100 AS DOUBLE) AS expected_percent, round(has / 3 * 100, 8) AS actual_percent, round(has - 3, 8) AS pace_difference, round((has - 3) / (3.0 / 480), 8) AS minutes_ahead,
  round(has, 8) AS projected_wrvu, round(greatest(0.0, 3 - has), 8) AS remaining_wrvu, CAST(0 AS DOUBLE) AS required_per_hour, CASE WHEN has >= 3 THEN 'goal_achieved' ELSE 'after_work' END AS status FROM c"""
)
def daily_pace_after(spark, sf_dir):
    """The day's pace after the shift has ended."""
    return _pace(spark, sf_dir, 1020)


@query(
    PRE
    + f""", c AS (SELECT profile_id, coalesce(sum(CASE WHEN NOT needs_review THEN work_rvu END), 0.0) AS has
  FROM study_logs WHERE log_date = DATE '{AS_OF_DAY}' GROUP BY 1),
w AS (SELECT *, CAST(3.0 AS DOUBLE) * 240 / 480 AS expected FROM c)
SELECT profile_id, round(has, 8) AS current_wrvu, expected AS expected_wrvu, round(has / 240 * 480, 8) AS projected_wrvu,
  round(least(has / 3.0 * 100, 100.0), 8) AS percent_complete, round(has / expected * 100, 8) AS percent_of_expected,
  round(greatest(3.0 - has, 0.0), 8) AS remaining_wrvu, round(greatest(3.0 - has, 0.0) / 240 * 60, 8) AS required_per_hour,
  CASE WHEN has >= 3.0 THEN 'goal-hit' WHEN has / expected * 100 > 110 THEN 'ahead' WHEN has / expected * 100 >= 90 THEN 'on-track'
    WHEN has / expected * 100 >= 75 THEN 'falling-behind' ELSE 'danger-zone' END AS status FROM w"""
)
def simple_pace(spark, sf_dir):
    return rounded(pace.simple_pace(_current(spark, sf_dir), 3.0, "08:00", "17:00", 60, 780))


@query(
    PRE
    + """, s AS (SELECT profile_id, sum(coalesce(work_rvu, 0)) AS y, count(*) AS n, CAST(20.0 AS DOUBLE) AS goal FROM study_logs WHERE NOT needs_review GROUP BY 1)
SELECT profile_id, round(y, 8) AS ytd_wrvu, n AS studies, goal AS annual_goal, round(y / goal * 100, 8) AS percent_to_goal,
  round(greatest(0.0, goal - y), 8) AS remaining_wrvu, 20 AS days_elapsed, 346 AS days_left, 237 AS workdays_left,
  round(greatest(0.0, goal - y) / 237, 8) AS required_per_workday, round(y / (20.0 / 366), 8) AS projected_wrvu,
  round(y / 20, 8) AS daily_average,
  CASE WHEN y >= goal THEN 'achieved' WHEN y >= goal * 20 / 366 * 0.97 THEN 'on_pace' ELSE 'behind' END AS status FROM s"""
)
def year_to_date(spark, sf_dir):
    return rounded(pace.year_to_date(fx.study_logs(spark, sf_dir), AS_OF, F.lit(20.0), vacation=10))


@query(f"SELECT p_partkey AS id, {sqltext.modality('CAST(70000 + p_partkey % 9000 AS VARCHAR)')} AS modality FROM part")
def classify_modality(spark, sf_dir):
    return fx.cpt_rvu(spark, sf_dir).select("id", codes.classify_modality(F.col("cpt_code")).alias("modality"))


@query(
    PRE
    + """
SELECT id, CASE pc_tc WHEN '0' THEN 'global' WHEN '1' THEN 'professional' WHEN '2' THEN 'professional' WHEN '3' THEN 'technical' ELSE 'na' END AS pc_tc,
  CASE WHEN status_code = 'A' THEN 'active' WHEN status_code IN ('R', 'T') THEN 'restricted' WHEN status_code IN ('B', 'C', 'N', 'X') THEN 'excluded' ELSE 'unknown' END AS status,
  cpt_code || coalesce('-' || modifier, '') AS label, coalesce(modifier = '26' AND work_rvu > 0, false) AS productive FROM cpt_rvu"""
)
def code_categories(spark, sf_dir):
    return fx.cpt_rvu(spark, sf_dir).select(
        "id",
        codes.pc_tc(F.col("pc_tc")).alias("pc_tc"),
        codes.status_category(F.col("status_code")).alias("status"),
        codes.code_label(F.col("cpt_code"), F.col("modifier")).alias("label"),
        codes.productive(F.col("modifier"), F.col("work_rvu")).alias("productive"),
    )


_TITLES = f"titles AS MATERIALIZED (SELECT DISTINCT exam_name_raw AS title, exam_name_raw AS prev FROM study_logs)"
_EXAM = f"exam AS MATERIALIZED (SELECT title, {sqltext.exam_text('title')} AS exam_key FROM titles)"


def _titles(spark, sf_dir):
    return fx.study_logs(spark, sf_dir).select(F.col("exam_name_raw").alias("title")).distinct()


@query(f"{PRE}, {_TITLES}, {_EXAM} SELECT title, exam_key FROM exam")
def exam_texts(spark, sf_dir):
    return _titles(spark, sf_dir).select("title", T.normalize_exam_text(F.col("title")).alias("exam_key"))


@query(f"{PRE}, {_TITLES}, {sqltext.description_cte('titles', 'title', 'des')} SELECT title, description_key FROM des")
def descriptions(spark, sf_dir):
    return _titles(spark, sf_dir).select("title", T.normalize_description(F.col("title")).alias("description_key"))


#: Titles are alike from this score on. Without a shared word a score is 0.2 at most.
LEAST_ALIKE = 0.3


@query(
    f"{PRE}, {_TITLES}, {_EXAM}, s AS (SELECT a.title AS title_a, b.title AS title_b, {sqltext.combined('a.exam_key', 'b.exam_key')} AS score FROM exam a JOIN exam b ON a.title < b.title) "
    f"SELECT title_a, title_b, round(score, 6) AS score FROM s WHERE score >= {LEAST_ALIKE}"
)
def title_similarity(spark, sf_dir):
    """All pairs of titles that are alike, whatever they start with; pairs are found by shared words of their keys."""
    keyed = _titles(spark, sf_dir).withColumn("exam_key", T.normalize_exam_text(F.col("title")))
    words = keyed.select("title", "exam_key", F.explode(F.array_distinct(T.words(F.col("exam_key")))).alias("word"))
    a = words.select("word", F.col("title").alias("title_a"), F.col("exam_key").alias("a"))
    b = words.select("word", F.col("title").alias("title_b"), F.col("exam_key").alias("b"))
    pairs = a.join(b, "word").where("title_a < title_b").select("title_a", "title_b", "a", "b").distinct()
    score = T.combined_similarity(F.col("a"), F.col("b"))
    return pairs.withColumn("score", score).where(F.col("score") >= LEAST_ALIKE).select("title_a", "title_b", F.round("score", 6).alias("score"))


#: Logs with their fingerprints as table f, from a table of titles with exam_key.
def prints(exam: str) -> str:
    return f"""f AS MATERIALIZED (
  SELECT l.*, exam_key, CASE WHEN accession_number IS NOT NULL THEN 'acc:' || upper(accession_number)
    WHEN study_datetime IS NOT NULL THEN 'fp:' || exam_key || '|' || cpt_code || '|' || CAST(log_date AS VARCHAR) || '|' || strftime(study_datetime, '%H:%M')
    ELSE 'fp:' || exam_key || '|' || cpt_code || '|' || CAST(log_date AS VARCHAR) END AS fingerprint
  FROM study_logs l JOIN {exam} ON {exam}.title = l.exam_name_raw)"""


PRINTS = f"{_TITLES}, {_EXAM},\n{prints('exam')}"


@query(f"{PRE}, {PRINTS} SELECT id, fingerprint FROM f")
def fingerprints(spark, sf_dir):
    return duplicates.with_fingerprint(fx.study_logs(spark, sf_dir)).select("id", "fingerprint")


@query(f"{PRE}, {PRINTS} SELECT id, id <> min(id) OVER (PARTITION BY fingerprint) AS batch_duplicate FROM f")
def batch_repeats(spark, sf_dir):
    return duplicates.repeats_in_batch(duplicates.with_fingerprint(fx.study_logs(spark, sf_dir))).select("id", "batch_duplicate")


_LATER = """
w AS (SELECT * REPLACE (study_datetime + to_minutes(CAST(id % 20 AS INT)) AS study_datetime, CASE WHEN id % 3 <> 0 THEN accession_number END AS accession_number) FROM study_logs),
c AS MATERIALIZED (SELECT w.*, exam_key, CASE WHEN accession_number IS NOT NULL THEN 'acc:' || upper(accession_number)
    ELSE 'fp:' || exam_key || '|' || cpt_code || '|' || CAST(log_date AS VARCHAR) || '|' || strftime(study_datetime, '%H:%M') END AS fingerprint
  FROM w JOIN exam ON exam.title = w.exam_name_raw)"""


@query(
    f"""{PRE}, {PRINTS}, {_LATER},
p AS (
  SELECT c.id, g.id AS log_id, abs((hour(c.study_datetime) * 60 + minute(c.study_datetime)) - (hour(g.study_datetime) * 60 + minute(g.study_datetime))) AS apart,
    hour(c.study_datetime) * 60 + minute(c.study_datetime) = 0 OR hour(g.study_datetime) * 60 + minute(g.study_datetime) = 0 AS untimed,
    coalesce(c.accession_number = g.accession_number, false) AS same_number, c.fingerprint = g.fingerprint AS same_print, c.cpt_code = g.cpt_code AS same_code,
    CAST(len(list_filter(string_split(g.exam_key, ' '), lambda w: list_contains(string_split(c.exam_key, ' '), w))) AS DOUBLE)
      / greatest(1, least(len(list_distinct(string_split(c.exam_key, ' '))), len(string_split(g.exam_key, ' ')))) AS shared
  FROM c JOIN f g ON c.log_date = g.log_date AND (c.accession_number = g.accession_number OR c.fingerprint = g.fingerprint OR c.cpt_code = g.cpt_code)
),
t AS (SELECT id, log_id, CASE WHEN same_number OR same_print THEN 'exact' WHEN same_code AND apart <= 3 THEN 'very_likely'
    WHEN same_code AND apart <= 15 THEN 'possible' WHEN same_code AND untimed AND shared >= 0.7 THEN 'possible' END AS tier FROM p)
SELECT id, min(log_id) AS log_id, arg_min(tier, log_id) AS tier FROM t WHERE tier IS NOT NULL GROUP BY 1"""
)
def duplicate_tiers(spark, sf_dir):
    """All logs, taken a second time some minutes later and in part without their numbers, against all logs."""
    logs = fx.study_logs(spark, sf_dir)
    later = logs.withColumn("study_datetime", F.col("study_datetime") + F.make_dt_interval(mins=(F.col("id") % 20).cast("int")))
    later = later.withColumn("accession_number", F.when(F.col("id") % 3 != 0, F.col("accession_number")))
    found = duplicates.duplicate_matches(duplicates.with_fingerprint(later), duplicates.with_fingerprint(logs))
    return found.select("id", "log_id", "tier")


SCHEDULE = [
    ("70450", "Ct head/brain w/o dye"), ("71260", "Ct thorax dx c+"), ("71250", "Ct thorax without contrast"),
    ("74177", "Ct abd & pelvis with contrast"), ("74176", "Ct abd & pelvis without contrast"),
    ("74178", "Ct abd & pelvis without and with contrast"), ("71275", "Ct angiography chest"),
    ("70496", "Ct angiography head"), ("70498", "Ct angiography neck"), ("70553", "Mri brain without and with contrast"),
    ("76700", "Us exam abdom complete"), ("76705", "Echo exam of abdomen"), ("71045", "X-ray exam chest 1 view"),
    ("71046", "X-ray exam chest 2 views"), ("72148", "Mri lumbar spine without contrast"), ("73721", "Mri knee without contrast"),
    ("76536", "Us exam of head and neck"), ("77067", "Screening mammography bilateral"), ("78815", "Pet image with ct skull-thigh"),
]


#: The same rows for DuckDB, as table fees after cpt_rvu.
FIXED_FEES = f""", fees AS (
  SELECT * FROM (VALUES {", ".join(f"('{code}', '26', '{text}', CAST({0.5 + k / 10!r} AS DOUBLE), 'A', '0')" for k, (code, text) in enumerate(SCHEDULE))})
    AS v(cpt_code, modifier, description, work_rvu, status_code, pc_tc)
  UNION ALL SELECT cpt_code, modifier, description, work_rvu, status_code, pc_tc FROM cpt_rvu)"""


def _schedule(spark, sf_dir):
    """The fixed rows and all parts."""
    rows = [(code, "26", text, 0.5 + k / 10, "A", "0") for k, (code, text) in enumerate(SCHEDULE)]
    kind = "cpt_code string, modifier string, description string, work_rvu double, status_code string, pc_tc string"
    fixed = spark.createDataFrame(rows, kind)
    return fixed.unionByName(fx.cpt_rvu(spark, sf_dir).select(*fixed.columns))


ALIASES = [
    (1, 0, "ct angiogram head neck", ["70496-26", "70498-26"], 0.95, 4, 0, 0),
    (2, 2, "mri lumbar spine without", ["72148-26"], 0.9, 1, 1, 0),
    (3, 6, "ultrasound thyroid exam", ["76536-26"], 0.9, 2, 0, 1),
]

#: Aliases of an import: titles that are approved silently and as learned, and one of two codes.
IMPORT_ALIASES = [
    *ALIASES,
    (4, 0, "mri brain", ["70553-26"], 0.98, 9, 0, 0),
    (5, 0, "us ruq", ["76705-26"], 0.95, 1, 0, 0),
    (6, 2, "ct neck with contrast", ["70498-26", "71260-26"], 0.97, 20, 0, 0),
    (7, 0, "ct sinus", ["70450-26"], 0.9, 12, 2, 0),
]

#: Dictionary entries: names under which an exam is known, and its codes.
ENTRIES = [
    (1, ["US thyroid", "thyroid ultrasound"], ["76536-26"]),
    (2, ["X-Ray chest two views", "chest pa and lateral"], ["71046-26"]),
    (3, ["CT chest w/o", "X-Ray chest two views"], ["71250", "71260"]),
]


def _entries(spark):
    return spark.createDataFrame(ENTRIES, "id int, names array<string>, cpt_codes array<string>")


def _aliases(spark, rows=None):
    return spark.createDataFrame(
        rows or ALIASES,
        "id int, scope int, alias_text string, cpt_codes array<string>, match_confidence double, confirmations int, corrections int, rejections int",
    )


@query(
    """
WITH RECURSIVE e AS (
  SELECT user_id % 5 AS profile_id, 'alias ' || CAST(event_id % 50 AS VARCHAR) AS alias_key, event_id AS seq,
    CASE event_type WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'correct' ELSE 'confirm' END AS action,
    CASE WHEN event_id % 13 = 0 THEN '71260-26' ELSE '71250-26' END AS codes
  FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY profile_id, alias_key ORDER BY seq) AS place FROM e),
fold AS (
  SELECT profile_id, alias_key, place, codes, CAST(CASE WHEN action = 'correct' THEN 0.95 ELSE 0.90 END AS DOUBLE) AS confidence,
    1 AS confirmations, CAST(action = 'correct' AS INT) AS corrections, CAST(action = 'reject' AS INT) AS rejections
  FROM n WHERE place = 1
  UNION ALL
  SELECT profile_id, alias_key, place, codes,
    greatest(0.5, least(1.0, greatest(0.5, least(1.0, base + least(0.09, log10(confirmations + 1) * 0.035) - least(0.25, corrections * 0.06 + rejections * 0.10)))
      + CASE WHEN changed THEN -0.08 ELSE 0.015 END)), confirmations, corrections, rejections
  FROM (
    SELECT n.profile_id, n.alias_key, n.place, n.codes, fold.confidence AS base, n.codes <> fold.codes AS changed,
      confirmations + CAST(action <> 'reject' AS INT) AS confirmations,
      corrections + CAST(n.codes <> fold.codes OR action = 'correct' AS INT) AS corrections, rejections + CAST(action = 'reject' AS INT) AS rejections
    FROM fold JOIN n ON n.profile_id = fold.profile_id AND n.alias_key = fold.alias_key AND n.place = fold.place + 1))
SELECT profile_id, alias_key, round(confidence, 6) AS confidence, codes, confirmations, corrections, rejections, CAST(place AS INT) AS used
FROM fold QUALIFY place = max(place) OVER (PARTITION BY profile_id, alias_key)"""
)
def alias_confidence_fold(spark, sf_dir):
    """Events as decisions on aliases, folded in order."""
    e = fx.table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "correct").otherwise("confirm")
    events = e.select(
        (F.col("user_id") % 5).alias("profile_id"), F.lit(None).cast("long").alias("site_id"),
        F.concat(F.lit("alias "), (F.col("event_id") % 50).cast("string")).alias("alias_key"),
        F.col("event_id").alias("seq"), action.alias("action"),
        F.when(F.col("event_id") % 13 == 0, "71260-26").otherwise("71250-26").alias("codes"),
    )
    return rounded(learning.learn_aliases(events).drop("site_id"), 6)


@query(
    PRE
    + """
SELECT exam_name_raw AS key, count(*) AS n, exam_name_raw AS sample, min(id) AS first_id FROM study_logs WHERE needs_review GROUP BY 1 HAVING count(*) > 1"""
)
def unknown_groups(spark, sf_dir):
    return learning.unknown_groups(fx.study_logs(spark, sf_dir), "exam_name_raw")


@query(
    PRE
    + """, s AS (SELECT exam_name_raw AS alias_key, count(*) AS n, list_sort(list_distinct(list(CASE WHEN modifier = '26' THEN cpt_code || '-26' END))) AS codes
  FROM study_logs WHERE NOT needs_review GROUP BY 1 HAVING count(*) >= 2)
SELECT alias_key, n, array_to_string(codes, '|') AS codes, len(codes) > 1 AS is_combination FROM s
WHERE len(codes) > 0 AND alias_key NOT IN ('MRI brain', 'US RUQ')"""
)
def suggestions(spark, sf_dir):
    known = spark.createDataFrame([("MRI brain",), ("US RUQ",)], "alias_key string")
    return learning.suggestions(fx.study_logs(spark, sf_dir), known, "exam_name_raw")


_HOSPITAL = """
h AS (SELECT exam_name_raw AS exam_key, CASE WHEN id % 5 = 0 THEN cpt_code || 'H' ELSE cpt_code END AS cpt_code, CASE WHEN id % 9 <> 0 THEN modifier END AS modifier,
    work_rvu + CASE WHEN id % 4 = 0 THEN 0.5 ELSE 0 END AS work_rvu, id FROM study_logs),
l AS (SELECT id, exam_name_raw AS exam_key, cpt_code, modifier, work_rvu FROM study_logs)"""


@query(
    PRE + "," + _HOSPITAL
    + """,
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY exam_key, cpt_code ORDER BY id) = 1),
m AS (SELECT h.exam_key || '|' || h.cpt_code AS key, h.modifier AS h_modifier, h.work_rvu AS h_wrvu, f.modifier, f.work_rvu, f.id AS f_id
  FROM h LEFT JOIN f USING (exam_key, cpt_code))
SELECT key, 'missing_local' AS kind, h_modifier, round(h_wrvu, 8) AS h_wrvu, modifier, round(work_rvu, 8) AS work_rvu FROM m WHERE f_id IS NULL
UNION ALL SELECT key, 'modifier_mismatch', h_modifier, round(h_wrvu, 8), modifier, round(work_rvu, 8) FROM m WHERE f_id IS NOT NULL AND h_modifier IS DISTINCT FROM modifier
UNION ALL SELECT key, 'wrvu_difference', h_modifier, round(h_wrvu, 8), modifier, round(work_rvu, 8) FROM m WHERE abs(h_wrvu - work_rvu) > 0.01
UNION ALL SELECT exam_key || '|' || cpt_code, 'missing_hospital', NULL, NULL, modifier, round(work_rvu, 8) FROM l
  WHERE exam_key || '|' || cpt_code NOT IN (SELECT exam_key || '|' || cpt_code FROM h)"""
)
def hospital_reconciliation(spark, sf_dir):
    """All logs as a hospital reports them, with other codes, modifiers and work units in part, against all logs."""
    hospital, logs = _hospital(spark, sf_dir)
    return rounded(reconcile.reconcile(hospital, logs))


def _hospital(spark, sf_dir):
    logs = fx.study_logs(spark, sf_dir).withColumn("exam_key", F.col("exam_name_raw"))
    hospital = logs.select(
        "exam_key", F.when(F.col("id") % 5 == 0, F.concat("cpt_code", F.lit("H"))).otherwise(F.col("cpt_code")).alias("cpt_code"),
        F.when(F.col("id") % 9 != 0, F.col("modifier")).alias("modifier"),
        (F.col("work_rvu") + F.when(F.col("id") % 4 == 0, 0.5).otherwise(0.0)).alias("work_rvu"),
    )
    return hospital, logs.select("id", "exam_key", "cpt_code", "modifier", "work_rvu")


@query(PRE + "SELECT round(sum(coalesce(work_rvu, 0) * (1 + id % 3)), 2) AS wrvu, CAST(sum(1 + id % 3) AS BIGINT) AS studies FROM study_logs")
def hospital_totals(spark, sf_dir):
    rows = fx.study_logs(spark, sf_dir).withColumn("quantity", 1 + F.col("id") % 3)
    return rounded(reconcile.weighted_totals(rows), 2)


@query(
    PRE
    + """, a AS (SELECT session_id, log_date, match_method || CAST(id % 11 AS VARCHAR) AS action FROM study_logs),
u AS (SELECT DISTINCT l.id, action FROM study_logs l JOIN (SELECT DISTINCT session_id, action FROM a) s USING (session_id)
  UNION SELECT DISTINCT l.id, action FROM study_logs l JOIN (SELECT DISTINCT log_date, action FROM a) d USING (log_date))
SELECT l.id, coalesce(string_agg(action, ';' ORDER BY action), '') AS actions FROM study_logs l LEFT JOIN u USING (id) GROUP BY 1"""
)
def audit_of_logs(spark, sf_dir):
    """All logs against the audit of all logs."""
    logs = fx.study_logs(spark, sf_dir)
    action = F.concat("match_method", (F.col("id") % 11).cast("string"))
    return reconcile.audit_of_logs(logs, logs.select("session_id", "log_date", action.alias("action")))


@query(
    PRE
    + """
SELECT session_id, count(*) AS n, CAST(CASE WHEN count(*) <= 1 THEN 0
  ELSE greatest(1, floor((epoch(date_trunc('second', max(study_datetime))) - epoch(date_trunc('second', min(study_datetime)))) / 60.0 / count(*) + 0.5)) END AS BIGINT) AS minutes
FROM study_logs GROUP BY 1"""
)
def action_minutes(spark, sf_dir):
    audit = fx.study_logs(spark, sf_dir).withColumn("created_at", F.date_trunc("second", "study_datetime"))
    return reconcile.action_minutes(audit)
