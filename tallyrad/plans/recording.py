"""Queries over manual entries, decisions, reports, queues, seeds, lists and streams' tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes, dates, rows
from ..functions import text as T
from ..operators import duplicates, reconcile, records, review, tables
from ..sources import readers, seeds
from . import analytics, sqltext
from . import fixtures as fx
from .analytics import query, rounded
from .browsing import _LABELS, _REVIEW, _review_rows
from .fixtures import SQL as PRE

_BY_EXAM = """, x AS MATERIALIZED (SELECT title, {exam} AS exam_key FROM (SELECT DISTINCT exam_name_raw AS title FROM study_logs))""".format(
    exam=sqltext.exam_text("title")
)


def _entries(spark, sf_dir):
    """Logs as people might type them again: no time, no number, other confidence."""
    logs = fx.study_logs(spark, sf_dir)
    return logs.select(
        "id", "profile_id", F.when(F.col("id") % 4 == 0, F.col("log_date")).otherwise(F.date_add("log_date", 400)).alias("log_date"), "exam_name_raw",
        "cpt_code", "modifier", "work_rvu", "modality", F.lit("radiology_match").alias("method"), F.col("match_confidence").alias("confidence"),
        F.lit(" ").alias("notes"), F.col("exam_name_raw").alias("description"),
    )


_SAVED = """, e AS (SELECT id, profile_id, CASE WHEN id % 4 = 0 THEN log_date ELSE CAST(log_date + INTERVAL 400 DAY AS DATE) END AS day, exam_name_raw, exam_key, cpt_code, modifier, match_confidence AS c
  FROM study_logs JOIN x ON x.title = exam_name_raw),
p AS (SELECT e.id, g.id AS log_id, hour(study_datetime) * 60 + minute(study_datetime) AS at,
    'fp:' || e.exam_key || '|' || e.cpt_code || '|' || CAST(day AS VARCHAR) = 'fp:' || y.exam_key || '|' || g.cpt_code || '|' || CAST(g.log_date AS VARCHAR) || '|' || strftime(study_datetime, '%H:%M') AS printed,
    CAST(len(list_filter(string_split(y.exam_key, ' '), lambda w: list_contains(string_split(e.exam_key, ' '), w))) AS DOUBLE)
      / greatest(1, least(len(list_distinct(string_split(e.exam_key, ' '))), len(string_split(y.exam_key, ' ')))) AS shared
  FROM e JOIN study_logs g ON g.log_date = e.day AND g.cpt_code = e.cpt_code JOIN x y ON y.title = g.exam_name_raw),
held AS (SELECT DISTINCT id FROM p WHERE shared >= 0.7)"""


@query(
    PRE + _BY_EXAM + _SAVED
    + """ SELECT id, 'fp:' || exam_key || '|' || cpt_code || '|' || CAST(day AS VARCHAR) AS fingerprint, c < 0.75 AS needs_review, CAST(day AS VARCHAR) AS log_date
FROM e WHERE id NOT IN (SELECT id FROM held)"""
)
def manual_save(spark, sf_dir):
    """All logs typed again, some on their day, against all logs; likely duplicates are held back."""
    saved, _, _ = records.manual_save(_entries(spark, sf_dir), duplicates.with_fingerprint(fx.study_logs(spark, sf_dir)))
    return saved.select("id", "fingerprint", "needs_review", "log_date")


@query(
    PRE + _BY_EXAM
    + """ SELECT id AS seq, exam_key AS alias_key, 'manual_add' AS action, concat_ws('-', cpt_code, modifier) AS codes,
  'Manual entry ' || exam_name_raw || ' -> ' || concat_ws('-', cpt_code, modifier) AS summary FROM study_logs JOIN x ON x.title = exam_name_raw"""
)
def manual_learning(spark, sf_dir):
    """What typed entries teach, saved whether or not there is a duplicate."""
    logs = fx.study_logs(spark, sf_dir)
    _, events, _ = records.manual_save(_entries(spark, sf_dir), duplicates.with_fingerprint(logs), anyway=True)
    return events.select("seq", "alias_key", "action", "codes", "summary")


@query(
    PRE + _BY_EXAM
    + """, f AS (SELECT p_partkey AS id, description, cpt_code FROM (SELECT id AS p_partkey, description, cpt_code FROM cpt_rvu)),
d AS MATERIALIZED (SELECT description, """ + sqltext.exam_text("description") + """ AS exam_key FROM (SELECT DISTINCT description FROM cpt_rvu)),
k AS (SELECT id, 'fp:' || exam_key || '|' || cpt_code || '|2024-01-15' AS fingerprint FROM f JOIN d USING (description))
SELECT min(id) AS id, fingerprint FROM k WHERE fingerprint NOT IN (SELECT fingerprint FROM k WHERE id % 10 = 0) GROUP BY 2"""
)
def queue_logs(spark, sf_dir):
    """All parts queued, of which a tenth were logged before."""
    rows = fx.cpt_rvu(spark, sf_dir).withColumn("modality", F.lit("OTHER"))
    queued = lambda df: records.queue_logs(df, df.limit(0).select(F.lit("").alias("fingerprint")), "2024-01-15", "s", 7)
    before = queued(rows.where("id % 10 = 0"))
    return records.queue_logs(rows, before.select("fingerprint"), "2024-01-15", "s", 7).select("id", "fingerprint")


_KEYED = f", titles AS (SELECT DISTINCT exam_name_raw AS title, exam_name_raw AS prev FROM study_logs), {sqltext.description_cte('titles', 'title', 'des')}"


@query(
    PRE + _KEYED
    + """, s AS (SELECT description_key AS alias_key, list_sort(list_distinct(list(cpt_code))) AS codes, min(id) AS id, count(*) AS n FROM study_logs JOIN des ON des.title = exam_name_raw GROUP BY 1),
d AS (SELECT *, CASE id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM s),
src AS (SELECT description_key AS alias_key, arg_min(exam_name_raw, id) AS source FROM study_logs JOIN des ON des.title = exam_name_raw GROUP BY 1),
u AS (SELECT cpt_code, arg_min(work_rvu, id) FILTER (work_rvu IS NOT NULL) AS work_rvu FROM study_logs GROUP BY 1),
t AS (SELECT id, sum(coalesce(work_rvu, 0)) AS work_rvu FROM (SELECT id, unnest(codes) AS cpt_code FROM d WHERE status = 'approved') LEFT JOIN u USING (cpt_code) GROUP BY 1)
SELECT id, alias_key, status, CASE WHEN status = 'approved' THEN source END AS source, round(t.work_rvu, 8) AS work_rvu, status = 'approved' AS learnt,
  CASE status WHEN 'approved' THEN 'alias_learned' WHEN 'rejected' THEN 'cpt_changed' END AS audit_action FROM d JOIN src USING (alias_key) LEFT JOIN t USING (id)"""
)
def resolve_suggestions(spark, sf_dir):
    logs = fx.study_logs(spark, sf_dir)
    titles = logs.select("exam_name_raw").distinct().withColumn("alias_key", T.normalize_description(F.col("exam_name_raw")))
    found = logs.join(titles, "exam_name_raw").groupBy("alias_key").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat("cpt_code", F.lit("-26")))), "|").alias("codes"), F.min("id").alias("id")
    )
    decided = found.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "approved").otherwise("rejected").alias("status"))
    done = records.resolve_suggestions(found.withColumn("status", F.lit("pending")), decided, logs)
    return rounded(done.drop("codes"))


@query(
    PRE + _REVIEW + _KEYED.replace("titles AS", "titles AS")
    + """, hit AS (SELECT id FROM study_logs JOIN des ON des.title = exam_name_raw WHERE description_key = (SELECT description_key FROM des WHERE title = 'CT Head w/o contrast'))
SELECT id, CASE WHEN id IN (SELECT id FROM hit) THEN '70450' WHEN has THEN (SELECT cpt_code FROM study_logs g WHERE g.id = s.id) END AS first_code,
  id NOT IN (SELECT id FROM hit) AND NOT (level IS NOT NULL AND reason IS NULL) AND (reason IS NOT NULL OR NOT has OR c < 0.75) AS needs_review FROM s"""
)
def bulk_correction(spark, sf_dir):
    """All rows with a title's key get a chosen candidate; it comes to the front where the row lacks it."""
    rows = review.classify(_review_rows(spark, sf_dir)).where("candidates is not null")
    kind = rows.schema["candidates"].dataType.elementType
    value = {"cpt_code": "70450", "modifier": "26", "description": "Ct head/brain w/o dye", "work_rvu": 0.83, "modality": "CT", "confidence": 1.0, "method": "manual_cpt"}
    chosen = F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
    key = spark.createDataFrame([("CT Head w/o contrast",)], "t string").select(T.normalize_description(F.col("t"))).first()[0]
    now = records.bulk_correction(rows, key, chosen)
    return now.select("id", F.get(F.col("candidates"), F.lit(0))["cpt_code"].alias("first_code"), "needs_review")


@query(
    PRE + _BY_EXAM
    + """, a AS (SELECT title, exam_key FROM x), n AS (SELECT title || ' w/o' AS text, title FROM x WHERE length(title) % 2 = 0),
m AS MATERIALIZED (SELECT text, title, """ + sqltext.exam_text("text") + """ AS k FROM n)
SELECT title AS id, coalesce(m.text, title) AS alias_text_raw, coalesce(k, exam_key) AS alias_text FROM a LEFT JOIN m USING (title) WHERE title NOT IN ('MRI brain', 'US RUQ')"""
)
def edit_aliases(spark, sf_dir):
    titles = fx.study_logs(spark, sf_dir).select(F.col("exam_name_raw").alias("id")).distinct()
    known = titles.select("id", F.col("id").alias("alias_text_raw"), T.normalize_exam_text(F.col("id")).alias("alias_text"))
    edits = titles.select("id", F.when(F.length("id") % 2 == 0, F.concat("id", F.lit(" w/o "))).otherwise("  ").alias("text"))
    return records.edit_aliases(known, edits, ["MRI brain", "US RUQ"])


@query(
    PRE + "," + analytics._HOSPITAL + """, found AS (
  SELECT 1 AS one FROM h LEFT JOIN (SELECT DISTINCT exam_key, cpt_code FROM l) k USING (exam_key, cpt_code) WHERE k.exam_key IS NULL
  UNION ALL SELECT 1 FROM h JOIN (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY exam_key, cpt_code ORDER BY id) = 1) f USING (exam_key, cpt_code) WHERE h.modifier IS DISTINCT FROM f.modifier
  UNION ALL SELECT 1 FROM h JOIN (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY exam_key, cpt_code ORDER BY id) = 1) f USING (exam_key, cpt_code) WHERE abs(h.work_rvu - f.work_rvu) > 0.01
  UNION ALL SELECT 1 FROM l WHERE exam_key || '|' || cpt_code NOT IN (SELECT exam_key || '|' || cpt_code FROM h))
SELECT '2024-01-31' AS report_date, 'list.csv' AS filename, round((SELECT sum(coalesce(work_rvu, 0) * (1 + id % 3)) FROM h), 4) AS hospital_wrvu,
  round((SELECT sum(coalesce(work_rvu, 0)) FROM l), 4) AS local_wrvu, CAST((SELECT sum(1 + id % 3) FROM h) AS BIGINT) AS hospital_exams, (SELECT count(*) FROM l) AS local_exams,
  (SELECT count(*) FROM found) AS discrepancies, 'Compared list.csv: ' || (SELECT count(*) FROM found) || ' discrepancies' AS summary"""
)
def comparison_report(spark, sf_dir):
    hospital, logs = analytics._hospital(spark, sf_dir)
    own = fx.study_logs(spark, sf_dir)
    quantity = own.select((F.col("work_rvu") + F.when(F.col("id") % 4 == 0, 0.5).otherwise(0.0)).alias("work_rvu"), (1 + F.col("id") % 3).alias("quantity"))
    return rounded(records.comparison_report(quantity, logs, reconcile.reconcile(hospital, logs), "2024-01-31", "list.csv"), 4)


@query(
    PRE
    + """, s AS (SELECT profile_id, sum(CASE WHEN NOT needs_review THEN coalesce(work_rvu, 0) ELSE 0 END) AS confirmed, sum(CASE WHEN needs_review THEN coalesce(work_rvu, 0) ELSE 0 END) AS pending FROM study_logs GROUP BY 1)
SELECT profile_id, round(confirmed, 6) AS confirmed, round(pending, 6) AS pending, round(confirmed + pending, 6) AS projected, round(greatest(0.0, 90 - confirmed - pending), 6) AS remaining,
  round(least(100.0, (confirmed + pending) / 90 * 100), 6) AS percent, round(confirmed * 40, 6) AS confirmed_pay, round((confirmed + pending) * 40, 6) AS projected_pay FROM s"""
)
def projection(spark, sf_dir):
    return rounded(records.projection(fx.study_logs(spark, sf_dir), "profile_id", goal=90.0, rate=40.0), 6)


@query(
    PRE
    + """ SELECT id, round(CASE WHEN id % 10 = 0 THEN 7.5 WHEN id % 3 <> 0 THEN (id % 600 + 1) / 60.0 END, 6) AS hours FROM study_logs"""
)
def hours_worked(spark, sf_dir):
    """Hours of sessions that end some minutes after they start, or before; a tenth were typed in."""
    logs = fx.study_logs(spark, sf_dir)
    apart = F.when(F.col("id") % 3 == 0, -5).otherwise(F.col("id") % 600 + 1).cast("int")
    end = F.col("study_datetime") + F.make_dt_interval(mins=apart)
    manual = F.when(F.col("id") % 10 == 0, 7.5).when(F.col("id") % 7 == 0, 0.0)
    return rounded(logs.select("id", records.hours_worked(manual, F.col("study_datetime"), end).alias("hours")), 6)


@query(
    PRE
    + """, k AS (SELECT *, exam_name_raw || '|' || cpt_code AS fingerprint FROM study_logs),
d AS (SELECT min(id) AS id FROM k WHERE fingerprint NOT IN (SELECT fingerprint FROM k WHERE id % 3 = 0 AND deleted_at IS NULL) GROUP BY fingerprint)
SELECT count(*) FILTER (d.id IS NOT NULL) AS imported, count(*) FILTER (d.id IS NOT NULL AND needs_review) AS review_needed, count(*) FILTER (d.id IS NULL) AS skipped FROM k LEFT JOIN d USING (id)"""
)
def commit_counts(spark, sf_dir):
    rows = fx.study_logs(spark, sf_dir).withColumn("fingerprint", F.concat_ws("|", "exam_name_raw", "cpt_code"))
    return records.commit_counts(rows, tables.commit(rows, rows.where("id % 3 = 0")))


@query(PRE + " SELECT count(DISTINCT match_method) AS sources, count(DISTINCT log_date) AS dates, CAST(min(log_date) AS VARCHAR) AS first_date, CAST(max(log_date) AS VARCHAR) AS last_date FROM study_logs")
def distinct_values(spark, sf_dir):
    return records.distinct_values(fx.study_logs(spark, sf_dir))


@query(
    PRE
    + """, l AS (SELECT id // 5 AS file, id, log_date, study_datetime, CASE id % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 0.75 WHEN 2 THEN 1.0 WHEN 3 THEN NULL ELSE 1.0 END AS trust FROM study_logs)
SELECT file, CASE WHEN trust = 1.0 THEN strftime(study_datetime, '%Y-%m-%d %H:%M') END AS study_datetime, CAST(log_date AS VARCHAR) AS study_date, CAST(trust AS DOUBLE) AS confidence FROM l
WHERE trust IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY trust DESC, id) = 1"""
)
def best_moment(spark, sf_dir):
    """Files of five lines with dates in several forms; the most trusted line of each."""
    logs = fx.study_logs(spark, sf_dir)
    form = lambda f: F.date_format("study_datetime", f)
    text = (
        F.when(F.col("id") % 5 == 0, form("M/d/yyyy")).when(F.col("id") % 5 == 1, form("MMM d, yyyy")).when(F.col("id") % 5 == 2, form("yyyy-MM-dd HH:mm"))
        .when(F.col("id") % 5 == 3, "no date here").otherwise(form("M/d/yyyy h:mm a"))
    )
    lines = logs.select(F.floor(F.col("id") / 5).alias("file"), F.col("id").alias("line_no"), F.concat(F.lit("seen "), text).alias("value"))
    found = dates.with_moment(rows.spread(lines), "value", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), "m")
    return records.best_moment(found, "file").select(
        "file", F.date_format("study_datetime", "yyyy-MM-dd HH:mm").alias("study_datetime"), "study_date", "confidence"
    )


@query(
    PRE
    + """ SELECT l.profile_id, round(sum(CASE WHEN NOT needs_review THEN coalesce(work_rvu, 0) ELSE 0 END), 6) AS today, round(sum(CASE WHEN NOT needs_review THEN coalesce(work_rvu, 0) ELSE 0 END) + 3.5, 6) AS projected,
  CAST(floor(CAST(count(*) FILTER (match_method = 'alias_match' AND match_confidence >= 0.95) AS DOUBLE) / count(*) * 100 + 0.5) AS BIGINT) AS automatic_percent,
  CAST(floor(count(*) FILTER (match_method = 'alias_match' AND match_confidence >= 0.95) * CAST(0.35 AS DOUBLE) + 0.5) AS BIGINT) AS minutes_saved,
  round(coalesce(sum(CASE WHEN NOT needs_review THEN coalesce(work_rvu, 0) ELSE 0 END) / nullif(count(*) FILTER (NOT needs_review), 0), 0), 6) AS average
FROM study_logs l GROUP BY 1"""
)
def dashboard(spark, sf_dir):
    return rounded(records.dashboard(fx.study_logs(spark, sf_dir), "profile_id", waiting=3.5), 6)


@query(
    PRE + _REVIEW + _LABELS
    + """, d AS (SELECT *, coalesce(dup IN ('exact', 'very_likely'), false) AS skip, NOT (level IS NOT NULL AND reason IS NULL) AND (reason IS NOT NULL OR NOT has OR c < 0.75) AS nr FROM safe),
n AS (SELECT id % 7 AS day, count(*) FILTER (NOT skip) AS included, count(*) FILTER (NOT skip AND chosen) AS matched, count(*) FILTER (NOT skip AND dup = 'possible') AS possible_duplicates,
  count(*) FILTER (safe_one AND dup IS DISTINCT FROM 'possible') AS safe, count(*) FILTER (NOT skip AND NOT nr) AS coded, count(*) FILTER (NOT skip AND nr) AS under_review FROM d GROUP BY 1)
SELECT *, matched AS codes, round(CAST(coded AS DOUBLE) / included * 100, 6) AS coded_percent, CAST(floor(coded * CAST(0.35 AS DOUBLE) + 0.5) AS BIGINT) AS minutes_saved FROM n"""
)
def import_counters(spark, sf_dir):
    rows = review.classify(_review_rows(spark, sf_dir)).withColumn("day", F.col("id") % 7)
    return rounded(review.import_counters(rows, "day"), 6)


@query(
    PRE
    + """ SELECT id, coalesce(nullif(trim(CASE WHEN id % 3 = 0 THEN ' T' || id || ' ' WHEN id % 3 = 1 THEN '  ' END), ''), exam_name_raw) AS display_title,
  CASE id % 7 WHEN 0 THEN 'Shift Not Started' WHEN 1 THEN 'Goal Achieved' WHEN 2 THEN 'Ahead of Pace' WHEN 3 THEN 'On Track' WHEN 4 THEN 'Slightly Behind' WHEN 5 THEN 'Behind Pace' ELSE 'Shift Complete' END AS status_label
FROM study_logs"""
)
def labels_of_logs(spark, sf_dir):
    """Titles to show, and labels of the day's status."""
    override = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" T"), "id", F.lit(" "))).when(F.col("id") % 3 == 1, "  ")
    status = F.element_at(F.array(*[F.lit(s) for s in seeds.STATUS_LABELS]), (F.col("id") % 7 + 1).cast("int"))
    logs = fx.study_logs(spark, sf_dir)
    return logs.select("id", records.display_title(override, F.col("exam_name_raw")).alias("display_title"), seeds.status_label(status).alias("status_label"))


@query(
    """SELECT c_custkey AS id, c_name AS name, upper(substr(list_filter(string_split(replace(c_name, '#', ' '), ' '), lambda w: w <> '')[1], 1, 1)) || coalesce(upper(substr(list_filter(string_split(replace(c_name, '#', ' '), ' '), lambda w: w <> '')[2], 1, 1)), '') AS initials
FROM customer WHERE contains(lower(c_name), '7')"""
)
def named_places(spark, sf_dir):
    """Names that hold a text, and their initials."""
    names = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return records.search_names(names, "7").select("id", "name", records.initials(F.regexp_replace("name", "#", " ")).alias("initials"))


@query(
    PRE
    + """ SELECT min(id) AS id, exam_name_raw AS alias_text_raw, cpt_code FROM study_logs GROUP BY 2, 3 HAVING contains(lower(exam_name_raw), 'chest') OR contains(lower(exam_name_raw || ' exam'), 'chest') OR contains(cpt_code, 'chest')"""
)
def alias_search(spark, sf_dir):
    known = fx.study_logs(spark, sf_dir).groupBy(F.col("exam_name_raw").alias("alias_text_raw"), "cpt_code").agg(F.min("id").alias("id"))
    known = known.withColumn("canonical_exam_name", F.concat("alias_text_raw", F.lit(" exam")))
    return records.search_aliases(known, "Chest").select("id", "alias_text_raw", "cpt_code")


@query(
    PRE
    + """ SELECT id, CAST(log_date AS VARCHAR) AS log_date FROM study_logs WHERE log_date BETWEEN DATE '2024-01-13' AND DATE '2024-01-20' AND deleted_at IS NULL AND (profile_id = 7 OR id % 31 = 0)
  AND (contains(lower(exam_name_raw), 'ct') OR contains(cpt_code, 'ct') OR contains(lower('note ' || modality), 'ct'))"""
)
def own_history(spark, sf_dir):
    """A profile's logs and those of none, of the last seven days, that hold a text."""
    logs = fx.study_logs(spark, sf_dir).withColumn("profile_id", F.when(F.col("id") % 31 != 0, F.col("profile_id")))
    logs = logs.withColumn("notes", F.concat(F.lit("note "), "modality")).withColumn("display_title", F.col("exam_name_raw"))
    start, end = records.date_range("7d", "2024-01-20")
    rows = records.own_or_shared(logs, 7).where(F.col("log_date").between(start, end) & F.col("deleted_at").isNull())
    return records.search_logs(rows, "CT").orderBy(F.desc("log_date"), "study_datetime").select("id", "log_date")


@query(
    PRE
    + """ SELECT session_id, id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY study_datetime DESC, id DESC) AS INT) AS nth FROM study_logs QUALIFY nth <= 8"""
)
def last_events(spark, sf_dir):
    """The last eight events of each session."""
    found = records.newest(fx.study_logs(spark, sf_dir), 8, "study_datetime", "session_id")
    order = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("study_datetime"), F.desc("id")))
    return found.select("session_id", "id", order.alias("nth"))


@query(PRE + " SELECT id, exam_name_raw FROM study_logs ORDER BY study_datetime DESC, id DESC LIMIT 200")
def activity_log(spark, sf_dir):
    """The newest 200 entries, which is what the log shows."""
    return records.newest(fx.study_logs(spark, sf_dir), 200, "study_datetime").select("id", "exam_name_raw")


@query(
    PRE
    + """, u AS (SELECT profile_id, practice_id, profile_id % 40 = 0 AS active FROM profiles), l AS (SELECT profile_id, max(study_datetime) AS last_used FROM study_logs GROUP BY 1)
SELECT coalesce(practice_id, -1) AS practice_id, profile_id FROM u LEFT JOIN l USING (profile_id) QUALIFY row_number() OVER (PARTITION BY u.practice_id ORDER BY active DESC, last_used DESC NULLS LAST, profile_id) = 1"""
)
def active_profiles(spark, sf_dir):
    """Of each practice the active profile, else the one used last."""
    last = fx.study_logs(spark, sf_dir).groupBy("profile_id").agg(F.max("study_datetime").alias("last_used"))
    own = fx.profiles(spark, sf_dir).withColumn("active", F.col("profile_id") % 40 == 0).join(last, "profile_id", "left")
    return records.active_profile(own, "practice_id").select(F.coalesce("practice_id", F.lit(-1)).alias("practice_id"), "profile_id")


@query(PRE + " SELECT profile_id, coalesce(CASE WHEN organization_id IS DISTINCT FROM 1 AND practice_id IS DISTINCT FROM 3 THEN practice_id END, -1) AS practice_id FROM profiles")
def hierarchy_edits(spark, sf_dir):
    """Profiles after an organization and a practice are gone."""
    practices = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("practice_id"), F.col("n_regionkey").alias("organization_id"))
    left, _ = records.remove_organization(fx.profiles(spark, sf_dir).select("profile_id", "practice_id"), practices, 1)
    return records.remove_practice(left, 3).select("profile_id", F.coalesce("practice_id", F.lit(-1)).alias("practice_id"))


@query(
    PRE
    + f""", p AS (SELECT CASE WHEN id % 5 = 0 THEN cpt_code || 'N' ELSE cpt_code END AS cpt_code, modifier, description, status_code, id AS n FROM cpt_rvu),
o AS (SELECT cpt_code, modifier, min(id) AS id FROM cpt_rvu WHERE id % 2 = 0 GROUP BY 1, 2)
SELECT n, coalesce(CAST(o.id AS VARCHAR), concat_ws('-', 'V2', p.cpt_code, p.modifier)) AS id, CASE WHEN o.id IS NOT NULL THEN 'KEPT' ELSE {sqltext.modality("p.cpt_code")} END AS modality,
  CASE WHEN status_code = 'A' THEN 'active' WHEN status_code IN ('R', 'T') THEN 'restricted' ELSE 'excluded' END AS status
FROM p LEFT JOIN o ON p.cpt_code = o.cpt_code AND p.modifier IS NOT DISTINCT FROM o.modifier"""
)
def parsed_rows(spark, sf_dir):
    """All parts parsed again, with other codes in part, as rows of the table."""
    cpt = fx.cpt_rvu(spark, sf_dir)
    code = F.when(F.col("id") % 5 == 0, F.concat("cpt_code", F.lit("N"))).otherwise(F.col("cpt_code"))
    parsed = cpt.withColumn("cpt_code", code).withColumn("description", F.concat_ws("#", "id", "description"))
    stored = cpt.where("id % 2 = 0").select("id", "cpt_code", "modifier", F.lit("KEPT").alias("modality"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    rows = records.parsed_rows(parsed, stored, "V2", "2024-02-01")
    return rows.select(F.split("description", "#")[0].cast("long").alias("n"), "id", "modality", "status")


@query(
    """SELECT p_partkey AS id, CAST(coalesce(nullif(regexp_extract(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' 20' || lpad(CAST(p_partkey % 90 + 10 AS VARCHAR), 2, '0') ELSE '' END, '20[0-9]{2}'), ''), '1999') AS INT) AS year,
  substr(regexp_replace(p_name || CASE p_partkey % 3 WHEN 0 THEN '.ZIP' WHEN 1 THEN '.csv' ELSE '.doc' END, '(?i)\\.(zip|csv|txt)$', ''), 1, 20) AS label FROM part"""
)
def file_names(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    dated = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("20"), F.lpad((F.col("p_partkey") % 90 + 10).cast("string"), 2, "0"))).otherwise("")
    ending = F.when(F.col("p_partkey") % 3 == 0, ".ZIP").when(F.col("p_partkey") % 3 == 1, ".csv").otherwise(".doc")
    return part.select(F.col("p_partkey").alias("id"), records.file_year(F.col("p_name"), dated, 1999).alias("year"), records.file_label(F.concat("p_name", ending)).alias("label"))


@query(
    PRE
    + """ SELECT id, strftime(study_datetime, '%-m/%-d/%Y %-I:%M:%S %p') || ',"' || exam_name_raw || '",' || printf('%.2f', floor(coalesce(work_rvu, 0) * 100 + 0.500001) / 100) || ','
  || printf('%.2f', floor(sum(coalesce(work_rvu, 0)) OVER (PARTITION BY profile_id ORDER BY study_datetime, id ROWS UNBOUNDED PRECEDING) * 100 + 0.500001) / 100) AS line FROM study_logs"""
)
def legacy_export(spark, sf_dir):
    return records.legacy_export(fx.study_logs(spark, sf_dir))


_SEED_SQL = ", ".join(f"('{c}', {sqltext.quoted(d)}, {w!r}, '{m}')" for c, d, w, m in seeds.SEED_FEES)


@query(
    f"""WITH s AS (SELECT * FROM (VALUES {_SEED_SQL}) AS v(cpt_code, description, work_rvu, modality)),
p AS (SELECT DISTINCT CAST(70000 + p_partkey % 9000 AS VARCHAR) AS cpt_code FROM part)
SELECT 'seed_' || cpt_code || '_none' AS id, cpt_code, description, CAST(work_rvu AS DOUBLE) AS work_rvu, modality, cpt_code IN (SELECT cpt_code FROM p) AS in_parts FROM s"""
)
def seed_fees(spark, sf_dir):
    """The verified rows, and whether the parts have their codes; a reset of the table writes just these."""
    have = fx.cpt_rvu(spark, sf_dir).select("cpt_code", F.lit(True).alias("in_parts")).distinct()
    rows = seeds.seed_fees(spark).join(have, "cpt_code", "left").withColumn("in_parts", F.coalesce("in_parts", F.lit(False)))
    return rows.select("id", "cpt_code", "description", "work_rvu", "modality", "in_parts")


@query(
    PRE
    + """, t AS (SELECT exam_name_raw AS title, min(id) AS ord, min(cpt_code) AS a, max(cpt_code) AS b, max(work_rvu) AS w FROM study_logs GROUP BY 1),
c AS (SELECT title, ord, w, a AS cpt_code, '26' AS modifier, 0 AS place FROM t UNION ALL SELECT title, ord, w, b, NULL, 1 FROM t UNION ALL SELECT title, ord, w, b, 'TC', 2 FROM t)
SELECT 'curated_dictionary_cpt_' || lower(concat_ws('_', cpt_code, modifier)) AS id, title AS description, CASE WHEN modifier IS NULL OR modifier = '26' THEN round(w, 6) END AS work_rvu,
  CASE WHEN modifier = '26' THEN 'professional' ELSE 'na' END AS pc_tc FROM c QUALIFY row_number() OVER (PARTITION BY cpt_code, modifier ORDER BY ord, place) = 1"""
)
def dictionary_fees(spark, sf_dir):
    """Titles as dictionary entries with three codes each."""
    entries = fx.study_logs(spark, sf_dir).groupBy(F.col("exam_name_raw").alias("display_name")).agg(
        F.min("id").alias("ord"), F.max("work_rvu").alias("modifier_26_wrvu"),
        F.array(F.concat(F.min("cpt_code"), F.lit(" - 26")), F.max("cpt_code"), F.concat(F.max("cpt_code"), F.lit("-TC"))).alias("cpt_codes"),
    )
    entries = entries.withColumn("cms_description", F.lit("")).withColumn("modality", F.lit("OTHER"))
    return rounded(seeds.dictionary_fees(entries).select("id", "description", "work_rvu", "pc_tc"), 6)


_DEFAULTS_SQL = ", ".join(f"('{n}', '{v}')" for n, v in seeds.DEFAULT_SETTINGS.items())


@query(
    f"""WITH d AS (SELECT * FROM (VALUES {_DEFAULTS_SQL}) AS v(name, value)), s AS (SELECT * FROM (VALUES ('theme', 'dark'), ('break_minutes', '30'), ('own', 'x')) AS v(name, value)),
p AS (SELECT * FROM (VALUES ('theme', 'light'), ('daily_rvu_goal', '80')) AS v(name, value)), n AS (SELECT name FROM d UNION SELECT name FROM s UNION SELECT name FROM p)
SELECT n.name, coalesce(p.value, s.value, d.value) AS value FROM n LEFT JOIN p USING (name) LEFT JOIN s USING (name) LEFT JOIN d USING (name)"""
)
def settings(spark, sf_dir):
    """A patch over stored settings over the defaults."""
    stored = spark.createDataFrame([("theme", "dark"), ("break_minutes", "30"), ("own", "x")], "name string, value string")
    patch = spark.createDataFrame([("theme", "light"), ("daily_rvu_goal", "80")], "name string, value string")
    return seeds.settings(stored, patch)


_QUICK_SQL = ", ".join(f"('{i}', '{n}', {w!r})" for i, n, w in seeds.QUICK_ADDS)


@query(f"SELECT id, name, CAST(work_rvu AS DOUBLE) AS work_rvu FROM (VALUES {_QUICK_SQL}) AS v(id, name, work_rvu)")
def quick_adds(spark, sf_dir):
    return seeds.quick_adds(spark)


@query("SELECT 'events' AS name, (SELECT count(*) FROM events) AS n UNION ALL SELECT 'part', (SELECT count(*) FROM part) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem)")
def table_sizes(spark, sf_dir):
    every = None
    for name in ("events", "part", "lineitem"):
        own = fx.table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        every = own if every is None else every.unionByName(own)
    return every


@query(
    PRE + _BY_EXAM
    + """, k AS (SELECT id, upper(coalesce(modality, 'none')) AS m, id % 2 = 0 AS direct FROM study_logs)
SELECT id, CASE WHEN m IN ('CT', 'MRI', 'US', 'XR') THEN m END AS modality, direct AS allowed FROM k"""
)
def parsed_cells(spark, sf_dir):
    """Modalities as they are typed, and whether a bare code may count as a match."""
    logs = fx.study_logs(spark, sf_dir)
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "cpt_code", F.lit(" "))).otherwise(F.concat(F.lit("x"), "cpt_code"))
    cell = F.concat(F.lit(" "), F.lower(F.coalesce("modality", F.lit("none"))))
    return logs.select("id", codes.parse_modality(cell).alias("modality"), review.direct_code_allowed(text).alias("allowed"))


@query(
    PRE
    + """, s AS (SELECT CAST(log_date AS VARCHAR) AS text, 1 AS kind, id FROM study_logs WHERE id % 3 = 0 UNION ALL SELECT strftime(log_date, '%-m/%-d/%Y'), 2, id FROM study_logs WHERE id % 3 = 1 UNION ALL SELECT 'n/a', 3, id FROM study_logs WHERE id % 3 = 2)
SELECT s.id, CASE WHEN kind < 3 THEN CAST(l.log_date AS VARCHAR) END AS study_date FROM s JOIN study_logs l USING (id)"""
)
def cell_dates(spark, sf_dir):
    """Dates of a study list's cells in several forms."""
    logs = fx.study_logs(spark, sf_dir)
    cell = F.when(F.col("id") % 3 == 0, F.col("log_date").cast("string")).when(F.col("id") % 3 == 1, F.date_format("log_date", "M/d/yyyy")).otherwise("n/a")
    return logs.select("id", readers._csv_date(cell).alias("study_date"))


@query(
    PRE
    + """ SELECT id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 1 THEN CAST(1000 + id AS DOUBLE) WHEN id % 6 = 2 THEN NULL ELSE id / 4.0 END AS number,
  CASE (CAST(id AS INT) * 7) // 60 WHEN 0 THEN '' ELSE ((CAST(id AS INT) * 7) // 60) || 'h' END || CASE WHEN (id * 7) % 60 = 0 AND id * 7 >= 60 THEN '' ELSE CASE WHEN id * 7 >= 60 THEN ' ' ELSE '' END || ((id * 7) % 60) || 'm' END AS span FROM study_logs"""
)
def numeric_cells(spark, sf_dir):
    """Numbers of a fee schedule's cells, and spans of minutes as text."""
    logs = fx.study_logs(spark, sf_dir)
    plain = (F.col("id") / 4).cast("string")
    cell = F.when(F.col("id") % 6 == 0, " ").when(F.col("id") % 6 == 1, F.format_number(1000 + F.col("id"), 0)).when(F.col("id") % 6 == 2, " na ").otherwise(plain)
    return logs.select("id", codes.numeric_cell(cell).alias("number"), dates.span_label(F.col("id") * 7).alias("span"))


@query(
    PRE
    + """, e AS (SELECT profile_id, exam_name_raw AS alias_key, id AS seq FROM study_logs) SELECT alias_key, max(seq) AS last_used, count(*) AS times_used FROM e GROUP BY 1"""
)
def ordered_aliases(spark, sf_dir):
    """Aliases, the one used last first."""
    e = fx.study_logs(spark, sf_dir).groupBy(F.col("exam_name_raw").alias("alias_key")).agg(F.max("id").alias("last_used"), F.count("*").alias("times_used"))
    return e.orderBy(F.desc("last_used"), "alias_key")


@query(
    PRE + _BY_EXAM
    + """, s AS (SELECT * FROM study_logs WHERE session_id = (SELECT session_id FROM study_logs WHERE id = 5))
SELECT (SELECT profile_id FROM study_logs WHERE id = 5) AS profile_id, (SELECT exam_key FROM x WHERE title = (SELECT exam_name_raw FROM study_logs WHERE id = 5)) AS alias_key, 'correct' AS action,
  coalesce(string_agg(DISTINCT CASE WHEN modifier = '26' AND work_rvu > 0 THEN cpt_code || '-26' END, '|' ORDER BY CASE WHEN modifier = '26' AND work_rvu > 0 THEN cpt_code || '-26' END), '') AS codes,
  count(*) AS logs, 'Renamed ' || (SELECT exam_name_raw FROM study_logs WHERE id = 5) || ' to new title' AS summary FROM s"""
)
def rename_learning(spark, sf_dir):
    return records.rename_events(fx.study_logs(spark, sf_dir), 5, "new title")


@query(PRE + " SELECT count(*) AS learned FROM (SELECT exam_name_raw, cpt_code, min(study_datetime) AS created_at FROM study_logs GROUP BY 1, 2) WHERE CAST(created_at AS DATE) = DATE '2024-01-02'")
def learned_today(spark, sf_dir):
    known = fx.study_logs(spark, sf_dir).groupBy("exam_name_raw", "cpt_code").agg(F.min("study_datetime").alias("created_at"))
    return records.learned_on(known, "2024-01-02")


@query(
    PRE
    + """, u AS (SELECT s.cpt_code AS sc, p.cpt_code AS pc, s.work_rvu AS w, p.v
  FROM (SELECT * FROM cpt_rvu WHERE id % 2 = 0) s FULL JOIN (SELECT cpt_code, modifier, description, status_code, CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(id AS DOUBLE) + 1000 END AS v FROM cpt_rvu WHERE id % 11 <> 0) p
  ON s.cpt_code = p.cpt_code AND s.modifier IS NOT DISTINCT FROM p.modifier)
SELECT CASE WHEN sc IS NULL THEN 'added' WHEN pc IS NULL THEN 'kept' ELSE 'updated' END AS change, count(*) AS n FROM u GROUP BY 1"""
)
def fee_import(spark, sf_dir):
    """A file's cells parsed and imported over half of the parts: rows by what became of them."""
    from .reviewing import fee_cells

    parsed = readers.fee_rows(fee_cells(spark, sf_dir))
    _, counts = records.import_fees(parsed, fx.cpt_rvu(spark, sf_dir).where("id % 2 = 0"))
    return counts.select("change", "n")


@query(
    PRE
    + """ SELECT id AS local_log_id, exam_name_raw AS exam_title_display, CASE WHEN modifier = '26' AND work_rvu > 0 THEN round(work_rvu, 8) ELSE 0.0 END AS modifier_26_wrvu,
  NOT coalesce(work_rvu > 0 AND modifier = '26', false) AS not_productivity_relevant, '"cpt_code":"' || cpt_code || '"' AS code FROM study_logs"""
)
def mirrored_logs(spark, sf_dir):
    """All logs as rows of the mirror."""
    rows = tables.to_remote(fx.study_logs(spark, sf_dir))
    code = F.regexp_extract("cpt_codes", '"cpt_code":"[0-9]+"', 0).alias("code")
    return rounded(rows.select("local_log_id", "exam_title_display", "modifier_26_wrvu", "not_productivity_relevant", code))


@query(
    PRE
    + """ SELECT id, CASE WHEN id % 2 = 0 THEN description ELSE '' END AS description, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id AS DOUBLE) / 4 END AS work_rvu, CASE WHEN id % 5 = 0 THEN 'A' ELSE status_code END AS status_code,
  'unknown' AS status_category, pc_tc, 'OTHER' AS modality, 'remote' AS rvu_file_version, id % 4 = 0 AS is_user_verified FROM cpt_rvu"""
)
def mirrored_fees(spark, sf_dir):
    """All parts as the mirror gives them, as rows of the table."""
    none = F.lit(None).cast("string")
    remote = fx.cpt_rvu(spark, sf_dir).select(
        "id", "cpt_code", "modifier", F.when(F.col("id") % 2 == 0, F.col("description")).alias("description"),
        F.when(F.col("id") % 3 == 0, "n/a").otherwise((F.col("id") / 4).cast("string")).alias("work_rvu"), F.when(F.col("id") % 5 != 0, F.col("status_code")).alias("status_code"),
        none.alias("status_category"), "pc_tc", none.alias("modality"), none.alias("rvu_file_version"),
        F.when(F.col("id") % 4 == 0, "true").when(F.col("id") % 4 == 1, "0").alias("is_user_verified"),
    )
    return tables.to_local(remote).drop("cpt_code", "modifier")


@query(PRE + " SELECT profile_id, CAST(coalesce(practice_id, 0) AS BIGINT) AS practice_id FROM profiles")
def attached_profiles(spark, sf_dir):
    """Profiles where there is no practice yet: orphans go to the default one."""
    orgs = spark.createDataFrame([], "organization_id long, name string")
    places = spark.createDataFrame([], "practice_id long, name string, organization_id long")
    own = fx.profiles(spark, sf_dir).select("profile_id", F.col("practice_id").cast("long").alias("practice_id"))
    return tables.with_default_places(orgs, places, own)[2].select("profile_id", "practice_id")
