"""Queries over scans, filters, the fee schedule, review and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..functions import text as T
from ..operators import duplicates, explorer, imports, learning, matching, review, sessions, tables, totals
from ..operators.staging import cut
from ..sources import readers
from . import analytics, matchsql, sqltext
from . import fixtures as fx
from .analytics import _TITLES, _aliases, _schedule, _titles, query, rounded
from .fixtures import SQL as PRE


@query(PRE + " SELECT id, cpt_code, round(work_rvu, 8) AS work_rvu FROM study_logs WHERE log_date = DATE '2024-01-15' AND profile_id = 7")
def scan_day(spark, sf_dir):
    rows = fx.study_logs(spark, sf_dir).where((F.col("log_date") == F.lit("2024-01-15").cast("date")) & (F.col("profile_id") == 7))
    return rounded(rows.select("id", "cpt_code", "work_rvu"))


@query(
    PRE
    + """ SELECT id, CAST(log_date AS VARCHAR) AS log_date, exam_name_raw FROM study_logs
WHERE log_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' AND deleted_at IS NULL
  AND (contains(lower(exam_name_raw), 'chest') OR contains(cpt_code, '7012'))"""
)
def history_search(spark, sf_dir):
    rows = totals.live(fx.study_logs(spark, sf_dir)).where(F.col("log_date").between("2024-01-10", "2024-01-12"))
    hit = F.contains(F.lower("exam_name_raw"), F.lit("chest")) | F.contains(F.col("cpt_code"), F.lit("7012"))
    return rows.where(hit).orderBy(F.desc("log_date"), "study_datetime").select("id", "log_date", "exam_name_raw")


@query(PRE + " SELECT id, modality FROM study_logs WHERE cpt_code IN ('70010', '70020', '70030') ORDER BY id LIMIT 50 OFFSET 10")
def page_of_codes(spark, sf_dir):
    return fx.study_logs(spark, sf_dir).where(F.col("cpt_code").isin("70010", "70020", "70030")).orderBy("id").offset(10).limit(50).select("id", "modality")


@query(
    PRE
    + """ SELECT l.id FROM study_logs l WHERE l.profile_id IN (SELECT profile_id FROM profiles WHERE organization_id = 1)"""
)
def organization_scope(spark, sf_dir):
    own = fx.profiles(spark, sf_dir).where("organization_id = 1").select("profile_id")
    return totals.scope(fx.study_logs(spark, sf_dir), own).select("id")


@query(PRE + " SELECT profile_id FROM profiles WHERE practice_id IS NULL")
def orphan_profiles(spark, sf_dir):
    practices = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("practice_id"))
    return fx.profiles(spark, sf_dir).join(F.broadcast(practices), "practice_id", "left_anti").select("profile_id")


_FEES = """,
fees AS (
  SELECT c.*, CASE WHEN status_code = 'A' THEN 'active' ELSE 'other' END AS status,
    CASE pc_tc WHEN '3' THEN 'technical' ELSE 'no' END AS kind, TRY_CAST(cpt_code AS INT) AS num FROM cpt_rvu c
)"""


def _fees(spark, sf_dir):
    return fx.cpt_rvu(spark, sf_dir).select(
        "id", "cpt_code", "modifier", "description", "work_rvu", codes.status_category(F.col("status_code")).alias("status"),
        codes.pc_tc(F.col("pc_tc")).alias("pc_tc"), codes.classify_modality(F.col("cpt_code")).alias("modality"),
    )


def _ranges(ranges) -> str:
    return " OR ".join(f"num BETWEEN {lo} AND {hi}" for lo, hi in ranges)


_REGION_SQL = " UNION ALL ".join(f"SELECT '{name}' AS region, work_rvu FROM base WHERE {_ranges(r)}" for name, r in explorer.REGIONS)


@query(
    PRE + _FEES
    + f""", base AS (SELECT * FROM fees WHERE status = 'active' AND kind <> 'technical' AND work_rvu > 0), r AS ({_REGION_SQL}),
n AS (SELECT unnest([{", ".join(f"'{n}'" for n, _ in explorer.REGIONS)}]) AS region)
SELECT n.region, count(r.region) AS n, round(coalesce(sum(work_rvu), 0.0), 6) AS wrvu FROM n LEFT JOIN r USING (region) GROUP BY 1"""
)
def region_counts(spark, sf_dir):
    return rounded(explorer.region_counts(explorer.base_rows(_fees(spark, sf_dir))), 6)


@query(
    PRE + _FEES
    + """ SELECT cpt_code, id, coalesce(modifier, '-') AS modifier FROM fees WHERE kind <> 'technical' AND work_rvu > 0
QUALIFY row_number() OVER (PARTITION BY cpt_code ORDER BY CASE WHEN modifier = '26' THEN 0 WHEN modifier IS NULL THEN 1 ELSE 2 END, id) = 1"""
)
def professional_rows(spark, sf_dir):
    return explorer.professional_rows(_fees(spark, sf_dir)).select("cpt_code", "id", F.coalesce("modifier", F.lit("-")).alias("modifier"))


@query(
    PRE + analytics.FIXED_FEES
    + f""", f AS (SELECT *, {sqltext.modality('cpt_code')} AS modality FROM fees),
h AS (SELECT *, trim(regexp_replace(lower(concat_ws(' ', cpt_code, description, modality, modifier)), '[^a-z0-9]+', ' ', 'g')) AS hay FROM f),
s AS (SELECT cpt_code, description, {sqltext.search_score('stroke')} AS score FROM h)
SELECT cpt_code, description, CAST(score AS INT) AS score FROM s WHERE score > 0"""
)
def explorer_search(spark, sf_dir):
    rows = _schedule(spark, sf_dir).withColumn("modality", codes.classify_modality(F.col("cpt_code")))
    rows = rows.withColumn("status", codes.status_category(F.col("status_code"))).withColumn("pc_tc", codes.pc_tc(F.col("pc_tc")))
    return explorer.search(rows, "stroke").select("cpt_code", "description", "score")


@query(
    PRE
    + """, p AS (SELECT CASE WHEN id % 5 = 0 THEN cpt_code || 'N' ELSE cpt_code END AS cpt_code, modifier, description,
    work_rvu * CASE id % 4 WHEN 0 THEN 1.1 WHEN 1 THEN 1.01 ELSE 1 END AS work_rvu, status_code FROM cpt_rvu),
u AS (SELECT s.cpt_code AS sc, p.cpt_code AS pc, coalesce(p.cpt_code, s.cpt_code) AS cpt_code, CASE WHEN p.cpt_code IS NULL THEN s.modifier ELSE p.modifier END AS modifier,
  CASE WHEN p.cpt_code IS NULL THEN s.work_rvu ELSE p.work_rvu END AS work_rvu, s.work_rvu AS w, p.work_rvu AS v,
  s.description IS DISTINCT FROM p.description OR s.status_code IS DISTINCT FROM p.status_code OR s.work_rvu IS DISTINCT FROM p.work_rvu AS differs
  FROM cpt_rvu s FULL JOIN p ON s.cpt_code = p.cpt_code AND s.modifier IS NOT DISTINCT FROM p.modifier),
c AS (SELECT *, CASE WHEN sc IS NULL THEN 'added' WHEN pc IS NULL THEN 'kept' WHEN differs THEN 'updated' ELSE 'unchanged' END AS change FROM u)
SELECT cpt_code, modifier, round(work_rvu, 8) AS work_rvu, change, CASE WHEN change = 'updated' THEN round((v - w) / w * 100, 8) END AS percent_change FROM c"""
)
def fee_schedule_upsert(spark, sf_dir):
    """All parts, with other codes and work units in part, imported over all parts."""
    return rounded(_imported(spark, sf_dir).select("cpt_code", "modifier", "work_rvu", "change", "percent_change"))


def _imported(spark, sf_dir):
    cpt = fx.cpt_rvu(spark, sf_dir)
    factor = F.when(F.col("id") % 4 == 0, 1.1).when(F.col("id") % 4 == 1, 1.01).otherwise(1.0)
    code = F.when(F.col("id") % 5 == 0, F.concat("cpt_code", F.lit("N"))).otherwise(F.col("cpt_code"))
    parsed = cpt.withColumn("work_rvu", F.col("work_rvu") * factor).withColumn("cpt_code", code)
    return tables.upsert_fee_schedule(cpt, parsed)


@query(
    PRE
    + """, k AS (SELECT *, exam_name_raw || '|' || cpt_code AS fingerprint FROM study_logs),
live AS (SELECT DISTINCT fingerprint FROM k WHERE id % 3 = 0 AND deleted_at IS NULL)
SELECT min(id) AS id, fingerprint FROM k WHERE id % 3 <> 0 AND fingerprint NOT IN (SELECT fingerprint FROM live) GROUP BY fingerprint"""
)
def commit_new(spark, sf_dir):
    rows = fx.study_logs(spark, sf_dir).withColumn("fingerprint", F.concat_ws("|", "exam_name_raw", "cpt_code"))
    return tables.commit(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")).select("id", "fingerprint")


@query(
    PRE
    + """ SELECT profile_id, CAST(l.log_date AS VARCHAR) AS log_date, round(sum(coalesce(work_rvu, 0)), 8) AS total_wrvu, count(*) AS studies,
  string_agg(exam_name_raw, chr(10) ORDER BY id) AS raw_text FROM study_logs l GROUP BY profile_id, l.log_date"""
)
def upload_days(spark, sf_dir):
    return rounded(tables.upload_days(fx.study_logs(spark, sf_dir)))


@query(PRE + " SELECT id, CASE WHEN session_id = (SELECT session_id FROM study_logs WHERE id = 5) THEN 'new title' ELSE '-' END AS display_title FROM study_logs")
def rename_session(spark, sf_dir):
    now = tables.rename(fx.study_logs(spark, sf_dir), 5, "new title")
    return now.select("id", F.coalesce("display_title", F.lit("-")).alias("display_title"))


@query(
    PRE
    + """ SELECT id, CASE WHEN id IN (4, 5, 6) THEN TIMESTAMP '2024-02-01' ELSE deleted_at END IS NOT NULL AS deleted, needs_review AND id NOT IN (1, 2, 3) AS needs_review FROM study_logs"""
)
def edits(spark, sf_dir):
    now = tables.mark_reviewed(tables.soft_delete(fx.study_logs(spark, sf_dir), [4, 5, 6], "2024-02-01"), [1, 2, 3])
    return now.select("id", F.col("deleted_at").isNotNull().alias("deleted"), "needs_review")


@query(
    PRE
    + """ SELECT id, CASE WHEN modifier = '26' AND work_rvu > 0 THEN round(work_rvu, 8) ELSE 0.0 END AS remote_wrvu FROM study_logs"""
)
def remote_rows(spark, sf_dir):
    return rounded(fx.study_logs(spark, sf_dir).select("id", tables.remote_work_rvu().alias("remote_wrvu")))


def _review_rows(spark, sf_dir):
    logs = fx.study_logs(spark, sf_dir)
    candidate = F.struct(
        "cpt_code", "modifier", F.col("exam_name_raw").alias("description"), "work_rvu", F.coalesce("modality", F.lit("OTHER")).alias("modality"),
        F.col("match_confidence").alias("confidence"), F.col("match_method").alias("method"),
    )
    other = candidate.withField("cpt_code", F.lit("71260")).withField("confidence", F.lit(0.7)).withField("modifier", F.lit("26")).withField("work_rvu", F.lit(1.0))
    found = F.when(F.col("id") % 13 == 0, F.array().cast(logs.select(F.array(candidate)).schema[0].dataType)).when(F.col("id") % 4 == 0, F.array(candidate, other)).otherwise(F.array(candidate))
    status = F.when(F.col("id") % 11 == 0, "possible").when(F.col("id") % 17 == 0, "exact").when(F.col("id") % 19 == 0, "very_likely")
    return logs.select("id", F.col("exam_name_raw").alias("title"), found.alias("candidates"), status.alias("duplicate_status"))


_REVIEW = """, r AS (
  SELECT id, exam_name_raw AS title, coalesce(work_rvu, 0) AS work_rvu, id % 13 <> 0 AS has, id % 13 <> 0 AND id % 4 = 0 AS two, coalesce(modifier = '26' AND work_rvu > 0, false) AS counts, match_confidence AS c, match_method AS m,
    CASE WHEN id % 11 = 0 THEN 'possible' WHEN id % 17 = 0 THEN 'exact' WHEN id % 19 = 0 THEN 'very_likely' END AS dup FROM study_logs),
s AS (SELECT *, CASE WHEN NOT has THEN 'New or unknown exam' WHEN NOT counts THEN 'Not modifier 26 productivity RVU' WHEN dup = 'possible' THEN 'Possible duplicate'
    WHEN c < 0.95 THEN 'Low confidence match' WHEN two AND m <> 'alias_match' THEN 'Multiple possible CPT matches' END AS reason,
  CASE WHEN has AND m = 'alias_match' AND dup IS NULL AND c >= 0.95 THEN CASE WHEN c >= 0.99 THEN 'silent' ELSE 'learned' END END AS level FROM r)"""


@query(
    PRE + _REVIEW
    + """ SELECT id, coalesce(reason, '-') AS reason, coalesce(level, '-') AS level, level IS NOT NULL AND reason IS NULL AS approved,
  NOT (level IS NOT NULL AND reason IS NULL) AND (reason IS NOT NULL OR NOT has OR c < 0.75) AS needs_review,
  CASE WHEN dup IN ('exact', 'very_likely') THEN 'skipped' ELSE 'review' END AS route FROM s"""
)
def review_routes(spark, sf_dir):
    return review.classify(_review_rows(spark, sf_dir)).select(
        "id", F.coalesce("review_reason", F.lit("-")).alias("reason"), F.coalesce("approval_level", F.lit("-")).alias("level"),
        F.col("auto_approved").alias("approved"), "needs_review", "route",
    )


_LABELS = f""", k AS (
  SELECT *, has AND counts AND c >= 0.75 AS chosen, has AND counts AND c >= 0.65 AND two AS several,
    regexp_matches(lower(title), {sqltext.quoted(review.PROCEDURE_WORDS)}) AS procedure,
    CASE WHEN has AND counts THEN c WHEN two THEN 0.7 END AS one FROM s),
safe AS (SELECT *, coalesce(one >= 0.85, false) AND NOT several AND NOT procedure AS safe_one,
    CASE WHEN NOT has THEN 'No match' WHEN m = 'alias_match' AND c >= 0.95 THEN 'Exact alias match'
      WHEN c >= 0.85 AND m = 'radiology_match' THEN 'High-confidence normalized match' ELSE 'Fuzzy match needs review' END AS confidence_label FROM k)"""


@query(
    PRE + _REVIEW + _LABELS
    + """ SELECT id, confidence_label, safe_one AND dup IS DISTINCT FROM 'possible' AS safe, safe_one AND m = 'alias_match' AND one >= 0.95 AS prior FROM safe"""
)
def review_labels(spark, sf_dir):
    rows = review.classify(_review_rows(spark, sf_dir))
    return rows.select("id", "confidence_label", review.safe_approval().alias("safe"), review.prior_mapping().alias("prior"))


@query(
    PRE + _REVIEW + _LABELS
    + """, d AS (SELECT *, coalesce(dup IN ('exact', 'very_likely'), false) AS skip, level IS NOT NULL AND reason IS NULL AS approved FROM safe)
SELECT id % 7 AS day, count(*) FILTER (NOT skip) AS rows, count(*) FILTER (skip) AS skipped,
  count(*) FILTER (NOT approved AND (reason IS NOT NULL OR NOT has OR c < 0.75)) AS under_review, count(*) FILTER (level IS NOT NULL) AS auto_approved,
  round(sum(CASE WHEN NOT skip AND chosen THEN work_rvu ELSE 0.0 END), 6) AS wrvu, count(*) FILTER (NOT skip AND chosen) AS codes
FROM d GROUP BY 1"""
)
def session_summary(spark, sf_dir):
    return rounded(review.session_summary(review.classify(_review_rows(spark, sf_dir)).withColumn("day", F.col("id") % 7), "day"), 6)


@query(
    f"""{PRE}, titles AS (SELECT DISTINCT exam_name_raw AS title, exam_name_raw AS prev FROM study_logs), {sqltext.description_cte('titles', 'title', 'des')},
k AS (SELECT id AS ord, id % 2 AS side, coalesce(accession_number, '') || '|' || description_key || '|' || CAST(l.log_date AS VARCHAR) || '|' || strftime(l.study_datetime, '%H') AS key
  FROM study_logs l JOIN des ON des.title = l.exam_name_raw),
n AS (SELECT *, side = 1 AND row_number() OVER (PARTITION BY key ORDER BY side, ord) > 1 AS repeated FROM k)
SELECT ord, CASE WHEN repeated THEN 'skipped' ELSE 'review' END AS route, CASE WHEN repeated THEN 'very_likely' ELSE '-' END AS duplicate_status FROM n"""
)
def session_merge(spark, sf_dir):
    logs = fx.study_logs(spark, sf_dir).select(
        F.col("id").alias("ord"), "accession_number", F.col("exam_name_raw").alias("title"), F.col("log_date").alias("study_date"),
        F.date_format("study_datetime", "HH").alias("study_time"), F.lit("review").alias("route"), F.lit(None).cast("string").alias("duplicate_status"),
    )
    merged = sessions.merge_rows(logs.where("ord % 2 = 0"), logs.where("ord % 2 = 1"))
    return merged.select("ord", "route", F.coalesce("duplicate_status", F.lit("-")).alias("duplicate_status"))


@query(
    """
WITH lines AS (SELECT event_id AS line_no, CASE event_id % 3
    WHEN 0 THEN [CAST(70000 + event_id % 40 AS VARCHAR), CAST(70000 + event_id % 31 AS VARCHAR)]
    WHEN 1 THEN ['CT head', CAST(70000 + event_id % 9 AS VARCHAR)] ELSE ['MRI brain with contrast'] END AS parts FROM events),
e AS (SELECT line_no, unnest(range(0, len(parts))) AS place, unnest(parts) AS entry FROM lines)
SELECT line_no, CAST(place AS INT) AS place, entry FROM e QUALIFY row_number() OVER (PARTITION BY lower(entry) ORDER BY line_no, place) = 1"""
)
def bulk_text(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"),
        F.when(F.col("event_id") % 3 == 0, F.concat_ws(" ", (70000 + F.col("event_id") % 40).cast("string"), (70000 + F.col("event_id") % 31).cast("string")))
        .when(F.col("event_id") % 3 == 1, F.concat_ws(", ", F.lit("CT head"), (70000 + F.col("event_id") % 9).cast("string")))
        .otherwise("MRI brain with contrast").alias("value"),
    )
    return readers.bulk_entries(rows)


@query(
    PRE
    + """ SELECT exam_name_raw || ' ' || strftime(study_datetime, '%-m/%-d/%Y %-I:%M %p') || ' ACC: A' || lpad(CAST(id AS VARCHAR), 7, '0') AS raw_text,
  trim(regexp_replace(exam_name_raw, '  +', ' ', 'g')) AS exam_name, strftime(study_datetime, '%Y-%m-%d %H:%M') AS study_datetime, CAST(log_date AS VARCHAR) AS study_date,
  'A' || lpad(CAST(id AS VARCHAR), 7, '0') AS accession_number, CAST(1.0 AS DOUBLE) AS confidence FROM study_logs"""
)
def ocr_lines(spark, sf_dir):
    logs = fx.study_logs(spark, sf_dir)
    line = F.concat_ws(" ", "exam_name_raw", F.date_format("study_datetime", "M/d/yyyy h:mm a"), F.concat(F.lit("ACC: A"), F.lpad(F.col("id").cast("string"), 7, "0")))
    found = readers.ocr_studies(logs.select(line.alias("value")), "2024-02-01 00:00:00")
    return found.withColumn("study_datetime", F.date_format("study_datetime", "yyyy-MM-dd HH:mm"))


@query(
    PRE
    + """, r AS (SELECT lower(exam_name_raw) AS normalized_key, list_sort(list_distinct(list(exam_name_raw))) AS synonyms, min(cpt_code) AS code, count(*) AS times_used FROM study_logs GROUP BY 1),
e AS (SELECT * FROM r WHERE length(normalized_key) % 2 = 0),
goes AS (SELECT r.*, coalesce(e.normalized_key, (SELECT min(x.normalized_key) FROM e x WHERE x.code = r.code), r.normalized_key) AS target
  FROM r LEFT JOIN e ON e.normalized_key = r.normalized_key),
added AS (SELECT target, flatten(list(synonyms)) AS more, sum(times_used) AS used, arg_min(code, normalized_key) AS code FROM goes GROUP BY 1)
SELECT coalesce(e.normalized_key, target) AS normalized_key, array_to_string(list_sort(list_distinct(list_concat(coalesce(e.synonyms, []), coalesce(more, [])))), ';') AS synonyms,
  coalesce(e.code, added.code) AS cpt_codes, CAST(coalesce(e.times_used, 0) + coalesce(used, 0) AS BIGINT) AS times_used
FROM e FULL JOIN added ON e.normalized_key = added.target"""
)
def dictionary_merge(spark, sf_dir):
    rows = fx.study_logs(spark, sf_dir).groupBy(F.lower("exam_name_raw").alias("normalized_key")).agg(
        F.array_sort(F.collect_set("exam_name_raw")).alias("synonyms"), F.array(F.min("cpt_code")).alias("cpt_codes"), F.count("*").alias("times_used")
    )
    found = learning.merge_dictionary(rows.where(F.length("normalized_key") % 2 == 0), rows)
    return found.withColumn("synonyms", F.array_join("synonyms", ";")).withColumn("cpt_codes", F.array_join("cpt_codes", "|"))


@query(f"{PRE}, titles AS (SELECT DISTINCT exam_name_raw AS title, exam_name_raw AS prev FROM study_logs), {sqltext.description_cte('titles', 'title', 'des')} SELECT title, split_part(description_key, ' ', 1) AS lead FROM des")
def description_leads(spark, sf_dir):
    titles = fx.study_logs(spark, sf_dir).select(F.col("exam_name_raw").alias("title")).distinct()
    return titles.select("title", F.split(T.normalize_description(F.col("title")), " ")[0].alias("lead"))


_FOUND = "SELECT title, rank, cpt_code, modifier, description, round(work_rvu, 6) AS work_rvu, round(confidence, 6) AS confidence, source FROM found"


@query(matchsql.candidates(_TITLES, analytics.ALIASES, 5, analytics.ENTRIES) + _FOUND)
def match_candidates(spark, sf_dir):
    """Staged matching of all titles, all stages; the fee schedule is the fixed rows and the parts."""
    found = matching.candidates(_titles(spark, sf_dir), _schedule(spark, sf_dir), _aliases(spark), analytics._entries(spark))
    return rounded(found, 6)


@query(matchsql.library(_TITLES, 8))
def library_search(spark, sf_dir):
    return rounded(matching.library_search(_titles(spark, sf_dir), _schedule(spark, sf_dir)), 6)


_AGAIN = f"""
x AS MATERIALIZED (SELECT title, {sqltext.exam_text('title')} AS exam_key FROM titles),
one AS (SELECT title, cpt_code AS code, confidence AS one, source = 'alias' AS by_alias FROM found WHERE rank = 1),
l AS (SELECT id, l.log_date, l.study_datetime, accession_number, exam_name_raw AS title, exam_key, code FROM study_logs l JOIN x ON x.title = exam_name_raw LEFT JOIN one USING (title)),
w AS (SELECT * REPLACE (study_datetime + to_minutes(CAST(id % 40 AS INT)) AS study_datetime, CASE WHEN id % 3 <> 0 THEN accession_number END AS accession_number) FROM l),
printed AS (SELECT *, CASE WHEN accession_number IS NOT NULL THEN 'acc:' || upper(accession_number)
    ELSE 'fp:' || exam_key || '|' || coalesce(code, 'nocpt') || '|' || CAST(log_date AS VARCHAR) || '|' || strftime(study_datetime, '%H:%M') END AS fingerprint,
    hour(study_datetime) * 60 + minute(study_datetime) AS at
  FROM (SELECT 'g' AS side, * FROM l UNION ALL SELECT 'c', * FROM w)),
c AS MATERIALIZED (SELECT *, id <> min(id) OVER (PARTITION BY fingerprint) AS again FROM printed WHERE side = 'c'),
h AS MATERIALIZED (SELECT * FROM printed WHERE side = 'g'),
pp AS (SELECT c.id, g.id AS log_id, abs(c.at - g.at) AS apart, c.at = 0 OR g.at = 0 AS untimed, coalesce(c.accession_number = g.accession_number, false) AS same_number,
    c.fingerprint = g.fingerprint AS same_print, coalesce(c.code = g.code, false) AS same_code,
    CAST(len(list_filter(string_split(g.exam_key, ' '), lambda w: list_contains(string_split(c.exam_key, ' '), w))) AS DOUBLE)
      / greatest(1, least(len(list_distinct(string_split(c.exam_key, ' '))), len(string_split(g.exam_key, ' ')))) AS shared
  FROM c JOIN h AS g ON c.log_date = g.log_date AND (c.accession_number = g.accession_number OR c.fingerprint = g.fingerprint OR c.code = g.code)),
tt AS (SELECT id, log_id, CASE WHEN same_number OR same_print THEN 'exact' WHEN same_code AND apart <= 3 THEN 'very_likely'
    WHEN same_code AND apart <= 15 THEN 'possible' WHEN same_code AND untimed AND shared >= 0.7 THEN 'possible' END AS tier,
  CASE WHEN same_number THEN 'same accession number' WHEN same_print THEN 'identical fingerprint' WHEN same_code AND apart <= 3 THEN 'same code, close in time'
    WHEN same_code AND apart <= 15 THEN 'same code, near in time' WHEN same_code AND untimed AND shared >= 0.7 THEN 'same code, similar name' END AS reason FROM pp),
mm AS (SELECT id, min(log_id) AS log_id, arg_min(tier, log_id) AS tier, arg_min(reason, log_id) AS reason FROM tt WHERE tier IS NOT NULL GROUP BY 1),
nn AS (SELECT title, count(*) AS n, count(*) FILTER (confidence >= 0.65) AS good FROM found GROUP BY 1),
dd AS (SELECT c.id, c.title, again, CASE WHEN again THEN 'exact' ELSE tier END AS dup, CASE WHEN again THEN 'repeated in this batch' ELSE reason END AS dup_reason,
    CASE WHEN NOT again THEN log_id END AS duplicate_of, coalesce(n, 0) AS n, good, one, coalesce(by_alias, false) AS by_alias
  FROM c LEFT JOIN mm USING (id) LEFT JOIN nn ON nn.title = c.title LEFT JOIN one ON one.title = c.title),
rr AS (SELECT *, CASE WHEN n = 0 THEN 'New or unknown exam' WHEN dup = 'possible' THEN 'Possible duplicate' WHEN one < 0.95 THEN 'Low confidence match'
    WHEN good > 1 AND NOT by_alias THEN 'Multiple possible CPT matches' END AS review_reason,
  CASE WHEN by_alias AND dup IS NULL THEN CASE WHEN one >= 0.99 THEN 'silent' WHEN one >= 0.95 THEN 'learned' END END AS approval_level FROM dd)
SELECT id, title, dup AS duplicate_status, dup_reason AS duplicate_reason, duplicate_of, CAST(n AS INT) AS n_candidates, review_reason, approval_level,
  NOT (approval_level IS NOT NULL AND review_reason IS NULL) AND (review_reason IS NOT NULL OR one < 0.75) AS needs_review,
  CASE WHEN dup IN ('exact', 'very_likely') THEN 'skipped' ELSE 'review' END AS route FROM rr"""


@query(matchsql.candidates(_TITLES, analytics.IMPORT_ALIASES, 6, analytics.ENTRIES) + "," + _AGAIN)
def import_pipeline(spark, sf_dir):
    """All studies are imported a second time, some minutes later and in part without their numbers, into the logs of
    the first time: matching, duplicates, review and routing in one plan."""
    logs = fx.study_logs(spark, sf_dir)
    schedule, aliases, entries = _schedule(spark, sf_dir), _aliases(spark, analytics.IMPORT_ALIASES), analytics._entries(spark)
    studies = logs.select(
        "id", F.col("exam_name_raw").alias("exam_title"), F.lit(None).cast("string").alias("cpt"), "log_date", "study_datetime",
        F.lit(1.0).alias("date_time_confidence"), "accession_number", F.lit(None).cast("string").alias("modality"),
    )
    lists = cut(imports.candidate_lists(_titles(spark, sf_dir).withColumnRenamed("title", "asked"), schedule, aliases, entries))
    first = lists.select(F.col("asked").alias("exam_name_raw"), F.col("candidates")[0]["cpt_code"].alias("cpt_code"))
    before = cut(duplicates.with_fingerprint(logs.drop("cpt_code").join(first, "exam_name_raw", "left")))
    later = studies.withColumn("study_datetime", F.col("study_datetime") + F.make_dt_interval(mins=(F.col("id") % 40).cast("int")))
    later = later.withColumn("accession_number", F.when(F.col("id") % 3 != 0, F.col("accession_number")))
    rows = imports.import_rows(later, schedule, before, aliases, entries, lists=lists)
    return rows.select(
        "id", "title", "duplicate_status", "duplicate_reason", "duplicate_of", F.size("candidates").alias("n_candidates"), "review_reason", "approval_level", "needs_review", "route"
    )
