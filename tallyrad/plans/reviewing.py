"""Queries over edits of review rows, sessions, aliases in scope, exports and the parsing of files' cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import explorer, matching, migrations, records, review, sessions, tables
from ..sources import readers
from . import analytics, sqltext
from . import fixtures as fx
from .analytics import query, rounded
from .browsing import _FEES, _LABELS, _REVIEW, _fees, _ranges, _review_rows
from .fixtures import SQL as PRE

_ROWS = (
    PRE + _REVIEW + _LABELS
    + """, v AS (SELECT *, coalesce(dup IN ('exact', 'very_likely'), false) AS skip, NOT (level IS NOT NULL AND reason IS NULL) AND (reason IS NOT NULL OR NOT has OR c < 0.75) AS nr,
    CASE WHEN NOT has THEN 'No match' WHEN NOT counts THEN 'Not modifier 26 productivity RVU' WHEN c < 0.85 THEN 'Low confidence' WHEN several THEN 'Multiple possible CPT matches'
      WHEN procedure THEN 'Possible multi-CPT/procedure exam' WHEN dup = 'possible' THEN 'Possible duplicate' END AS manual, CASE WHEN chosen THEN '0' ELSE '' END AS picks FROM safe)"""
)


def _rows(spark, sf_dir):
    return review.classify(_review_rows(spark, sf_dir))


def _picks():
    return F.array_join(F.col("selected").cast("array<string>"), ",").alias("picks")


@query(_ROWS + " SELECT id, coalesce(manual, '-') AS manual, CASE WHEN chosen THEN title ELSE '' END AS descriptions FROM v")
def manual_reasons(spark, sf_dir):
    """The reviewer page's reason of every row, and its chosen descriptions."""
    return _rows(spark, sf_dir).select("id", F.coalesce(review.manual_reason(), F.lit("-")).alias("manual"), review.code_descriptions().alias("descriptions"))


@query(_ROWS + " SELECT id, CASE WHEN skip AND id IN (17, 19, 34, 38, 57, 68) THEN 'review' WHEN skip THEN 'skipped' ELSE 'review' END AS route, nr OR (skip AND id IN (17, 19, 34, 38, 57, 68)) AS needs_review, CASE WHEN skip AND id IN (17, 19, 34, 38, 57, 68) THEN '-' ELSE coalesce(dup, '-') END AS dup FROM v")
def forced_rows(spark, sf_dir):
    """All rows, of which some skipped ones are taken back."""
    rows = review.force_include(_rows(spark, sf_dir), [17, 19, 34, 38, 57, 68])
    return rows.select("id", "route", "needs_review", F.coalesce("duplicate_status", F.lit("-")).alias("dup"))


@query(_ROWS + " SELECT id, nr AND NOT (safe_one AND id % 2 = 0) AS needs_review, CASE WHEN safe_one AND id % 2 = 0 THEN '0' ELSE picks END AS picks FROM v")
def approved_rows(spark, sf_dir):
    """Rows of every second study approved where they are safe."""
    return review.approve(_rows(spark, sf_dir), F.col("id") % 2 == 0).select("id", "needs_review", _picks())


@query(
    _ROWS
    + """ SELECT id, CASE WHEN id % 2 = 1 THEN picks WHEN two THEN '0,1' WHEN has THEN '0' ELSE '' END AS picks,
  CASE WHEN id % 2 = 1 THEN nr ELSE NOT (has AND NOT two AND manual IS NULL) END AS needs_review FROM v"""
)
def chosen_rows(spark, sf_dir):
    """The first two candidates chosen for every second row; repeated and missing places don't count."""
    return review.select_candidates(_rows(spark, sf_dir), F.col("id") % 2 == 0, [0, 1, 1, 9, -1]).select("id", _picks(), "needs_review")


@query(_ROWS + " SELECT id, CASE WHEN two THEN '71260' WHEN has THEN CAST(70000 + id % 300 AS VARCHAR) ELSE '-' END AS first_code, nr AND NOT two AS needs_review FROM v")
def first_choices(spark, sf_dir):
    """A candidate moved to the front wherever a row has it."""
    rows = review.choose_first(_rows(spark, sf_dir), F.lit(True), "71260", "26")
    return rows.select("id", F.coalesce(F.get(F.col("candidates"), F.lit(0))["cpt_code"], F.lit("-")).alias("first_code"), "needs_review")


@query(
    _ROWS
    + """ SELECT id, CASE WHEN NOT has THEN 1 ELSE 2 END AS n, CASE WHEN chosen THEN '0,1' WHEN has THEN '1' ELSE '0' END AS picks,
  chosen OR two OR (has AND counts AND c >= 0.65) OR procedure OR coalesce(dup = 'possible', false) AS needs_review FROM v"""
)
def added_choices(spark, sf_dir):
    """A candidate selected too; rows that lack it get it."""
    rows = _rows(spark, sf_dir)
    value = {"cpt_code": "71260", "modifier": "26", "description": "Ct thorax", "work_rvu": 1.0, "modality": "CT", "confidence": 0.95, "method": "manual_cpt"}
    kind = rows.schema["candidates"].dataType.elementType
    wanted = F.array(F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]))
    now = review.add_selection(rows, F.lit(True), wanted)
    return now.select("id", F.size("candidates").alias("n"), _picks(), "needs_review")


@query(
    _ROWS
    + """ SELECT 'everything' AS mode, id FROM v UNION ALL SELECT 'auto', id FROM v WHERE level IS NOT NULL UNION ALL SELECT 'low', id FROM v WHERE has AND c < 0.95
UNION ALL SELECT 'unknown', id FROM v WHERE NOT has"""
)
def visible_rows(spark, sf_dir):
    """Rows of each mode of review."""
    rows, every = _rows(spark, sf_dir), None
    for mode in ("everything", "auto", "low", "unknown"):
        own = review.visible(rows, mode).select(F.lit(mode).alias("mode"), "id")
        every = own if every is None else every.unionByName(own)
    return every


@query(
    """WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS profile_id, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS site_id FROM customer)
SELECT id, CASE WHEN profile_id = 1 THEN 0 ELSE 4 END + CASE WHEN site_id = 2 THEN 0 ELSE 2 END AS scope FROM a WHERE (profile_id = 1 OR profile_id IS NULL) AND (site_id = 2 OR site_id IS NULL)"""
)
def alias_scope(spark, sf_dir):
    """Aliases of a profile and site or of all, with their rank."""
    null = lambda n: F.when(F.col("c_custkey") % n > 0, F.col("c_custkey") % n)
    aliases = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), null(3).alias("profile_id"), null(4).alias("site_id"))
    return matching.scoped_aliases(aliases, 1, 2).select("id", "scope")


_TITLE_KEYS = f"titles AS MATERIALIZED (SELECT DISTINCT exam_name_raw AS title FROM study_logs), x AS MATERIALIZED (SELECT title, {sqltext.exam_text('title')} AS exam_key FROM titles)"


@query(
    PRE + analytics.FIXED_FEES + f""", {_TITLE_KEYS},
e AS (SELECT title, exam_key, '7' || lpad(CAST(length(title) * 13 % 9000 AS VARCHAR), 4, '0') AS a, '71260' AS b FROM x WHERE length(title) % 2 = 0),
f AS (SELECT exam_key, arg_min(a, title) AS a, arg_min(b, title) AS b FROM e WHERE exam_key <> '' GROUP BY 1),
c AS (SELECT x.title, a AS cpt_code, '0' AS seq FROM x JOIN f USING (exam_key) UNION ALL SELECT x.title, b, '1' FROM x JOIN f USING (exam_key))
SELECT title, seq, cpt_code, description, CAST(0.94 AS DOUBLE) AS confidence FROM c JOIN fees USING (cpt_code) WHERE modifier = '26' AND work_rvu > 0"""
)
def dictionary_stage(spark, sf_dir):
    """Titles as dictionary entries of two codes; all titles with an entry's name get its rows of the schedule."""
    titles = fx.study_logs(spark, sf_dir).select(F.col("exam_name_raw").alias("title")).distinct()
    code = F.concat(F.lit("7"), F.lpad((F.length("title") * 13 % 9000).cast("string"), 4, "0"), F.lit("-26"))
    entries = titles.where(F.length("title") % 2 == 0).select(F.col("title").alias("id"), F.array("title").alias("names"), F.array(code, F.lit("71260")).alias("cpt_codes"))
    found = matching.dictionary(matching.title_keys(titles), entries, matching.fee_keys(analytics._schedule(spark, sf_dir)))
    return found.select("title", "seq", "cpt_code", "description", "confidence")


@query(PRE + " SELECT id, cpt_code, coalesce(modifier, '-') AS modifier FROM cpt_rvu a WHERE NOT EXISTS (SELECT 1 FROM cpt_rvu b WHERE b.id % 3 = 0 AND a.cpt_code = b.cpt_code AND a.modifier IS NOT DISTINCT FROM b.modifier)")
def missing_seed(spark, sf_dir):
    """All parts as a seed; those whose code and modifier the table (a third of them) lacks."""
    cpt = fx.cpt_rvu(spark, sf_dir)
    return tables.missing_only(cpt.where("id % 3 = 0"), cpt, "cpt_code", "modifier").select("id", "cpt_code", F.coalesce("modifier", F.lit("-")).alias("modifier"))


@query(
    PRE
    + """, s AS (SELECT DISTINCT session_id, profile_id, CAST(split_part(session_id, '/', 2) AS DATE) AS day FROM study_logs),
a AS (SELECT *, CASE WHEN day = DATE '2024-01-31' OR profile_id = 7 THEN 'finalized' ELSE 'active' END AS status FROM s)
SELECT p AS asked, session_id FROM a CROSS JOIN (VALUES (7), (8), (9)) AS v(p) WHERE status = 'active'
QUALIFY row_number() OVER (PARTITION BY p ORDER BY profile_id = p DESC, day DESC, session_id) = 1"""
)
def active_sessions(spark, sf_dir):
    """The session that three profiles go on with; one profile has none of its own that is active."""
    logs = fx.study_logs(spark, sf_dir)
    own = logs.select("session_id", "profile_id", F.split("session_id", "/")[1].cast("timestamp").alias("updated_at")).distinct()
    status = F.when((F.col("updated_at") == F.lit("2024-01-31").cast("timestamp")) | (F.col("profile_id") == 7), "finalized").otherwise("active")
    every, rows = None, own.withColumn("status", status)
    for p in (7, 8, 9):
        found = sessions.active_session(rows, p).select(F.lit(p).alias("asked"), "session_id")
        every = found if every is None else every.unionByName(found)
    return every


@query(PRE + " SELECT id, exam_name_raw AS title, 'finalized' AS status FROM study_logs WHERE session_id = (SELECT session_id FROM study_logs WHERE id = 5)")
def reloaded_session(spark, sf_dir):
    """A session saved as one record, finalized, and read again; a second record that isn't JSON gives no row."""
    logs = fx.study_logs(spark, sf_dir)
    own = logs.where(F.col("id") == 5).select("session_id")
    rows = logs.join(F.broadcast(own), "session_id").select("id", F.col("exam_name_raw").alias("title"))
    record = sessions.with_status(sessions.saved(rows, "s1", 7, "2024-01-20 10:00:00"), "s1", "finalized", "2024-01-20 11:00:00")
    broken = record.withColumn("rows_json", F.lit("{not json"))
    loaded = sessions.loaded(record.unionByName(broken), rows.schema)
    return loaded.select("id", "title", F.lit("finalized").alias("status")).where(F.col("id").isNotNull())


@query(
    PRE
    + """ SELECT CAST(log_date AS VARCHAR) AS log_date, exam_name_raw, cpt_code, coalesce(modifier, '-') AS modifier, needs_review, coalesce(accession_number, '-') AS accession_number
FROM study_logs WHERE log_date = DATE '2024-01-15'"""
)
def exported_day(spark, sf_dir):
    """A day's rows as they go to a file."""
    rows, _ = tables.export_day(fx.study_logs(spark, sf_dir).where(F.col("log_date") == F.lit("2024-01-15").cast("date")))
    return rows.select(
        "log_date", "exam_name_raw", "cpt_code", F.coalesce("modifier", F.lit("-")).alias("modifier"), "needs_review",
        F.coalesce("accession_number", F.lit("-")).alias("accession_number"),
    )


@query(PRE + " SELECT id, coalesce(modifier, 'none') AS modifier, 'v14' AS version, 'x_' || lower(cpt_code) || CASE WHEN modifier IS NULL THEN '' ELSE '_' || lower(modifier) END AS slug FROM cpt_rvu")
def migrated_rows(spark, sf_dir):
    """Parts with columns of a later version, filled where they are null, and stable ids."""
    now = tables.migrate(fx.cpt_rvu(spark, sf_dir), {"modifier": F.lit("none"), "version": F.lit("v14")})
    old = F.nullif(F.col("modifier"), F.lit("none"))
    return now.select("id", "modifier", "version", codes.stable_id("x", F.col("cpt_code"), old).alias("slug"))


@query(
    PRE + _FEES
    + f""", t AS (SELECT *, {sqltext.modality('cpt_code')} AS modality, CASE id % 5 WHEN 0 THEN description || ' without contrast' WHEN 1 THEN description || ' with contrast'
    WHEN 2 THEN description || ' without and with contrast' WHEN 3 THEN description || ' w/o' ELSE description END AS text FROM fees),
k AS (SELECT *, CASE WHEN id % 5 = 2 THEN 'both' WHEN id % 5 IN (0, 3) THEN 'without' WHEN id % 5 = 1 THEN 'with' ELSE 'unknown' END AS contrast FROM t)
SELECT id, contrast, modality = 'CT' AND contrast IN ('with', 'unknown') AND ({_ranges(dict(explorer.REGIONS)['CHEST'])}) AS hit FROM k"""
)
def explorer_filters(spark, sf_dir):
    """Contrast of all parts, and whether they pass filters on modality, region and contrast."""
    text = F.concat(
        "description",
        F.element_at(F.array(*[F.lit(t) for t in (" without contrast", " with contrast", " without and with contrast", " w/o", "")]), (F.col("id") % 5 + 1).cast("int")),
    )
    rows = _fees(spark, sf_dir).withColumn("description", text)
    hits = explorer.filtered(rows, "CT", "CHEST", "with").select("id", F.lit(True).alias("hit"))
    every = rows.select("id", explorer.contrast_of(F.col("description")).alias("contrast")).join(hits, "id", "left")
    return every.withColumn("hit", F.coalesce("hit", F.lit(False)))


_HEAD = [
    ["a file"], ["", "", "", "", "", "WORK", "", "", ""], ["HCPCS", "MOD", " Description ", "Code", "", "RVU", "", "", "", "", "", "", "", "IND", "Days"],
]


@query(
    PRE
    + """ SELECT cpt_code, modifier, description, CASE WHEN status_code = 'X' THEN 'A' ELSE status_code END AS status_code, CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(id AS DOUBLE) + 1000 END AS work_rvu,
  CASE pc_tc WHEN '0' THEN 'global' WHEN '1' THEN 'professional' WHEN '2' THEN 'professional' WHEN '3' THEN 'technical' ELSE 'na' END AS pc_tc FROM cpt_rvu WHERE id % 11 <> 0"""
)
def fee_file(spark, sf_dir):
    """All parts as cells of a fee schedule's file, parsed."""
    return readers.fee_rows(fee_cells(spark, sf_dir)).select("cpt_code", "modifier", "description", "status_code", "work_rvu", "pc_tc")


def fee_cells(spark, sf_dir):
    """Parts as cells of a file, behind its two header rows; a row in eleven has no valid code."""
    cpt = fx.cpt_rvu(spark, sf_dir)
    blank = F.lit("")
    number = F.when(F.col("id") % 9 == 0, " NA ").otherwise(F.format_number(F.col("id") + 1000, 0))
    cells = F.array(
        F.when(F.col("id") % 11 == 0, "sum").otherwise(F.col("cpt_code")), F.concat(F.lit(" "), F.lower(F.coalesce("modifier", blank))), F.concat("description", F.lit(" ")),
        F.when(F.col("status_code") == "X", " ").otherwise(F.lower("status_code")), blank, number, *[blank] * 7, F.col("pc_tc"), blank,
    )
    head = spark.createDataFrame([(k - 10, c) for k, c in enumerate(_HEAD)], "n long, c array<string>")
    return head.unionByName(cpt.select(F.col("id").cast("long").alias("n"), cells.alias("c")))


@query(
    PRE
    + """ SELECT CASE WHEN id % 8 = 0 THEN NULL ELSE exam_name_raw END AS exam_title, cpt_code || 'A' AS cpt, CAST(id AS DOUBLE) AS work_rvu, CAST(log_date AS VARCHAR) AS study_date,
  accession_number, modality, 'csv' AS source FROM study_logs"""
)
def study_list(spark, sf_dir):
    """All logs as cells of a study list with headers in any case and order."""
    logs = fx.study_logs(spark, sf_dir)
    headers = ["Acc#", "EXAM NAME", "CPT-Code", "wRVU", "Study Date", "Modality"]
    places = readers.study_places([h.replace("-", "") for h in headers])
    rows = logs.select(
        F.col("accession_number").alias("_c0"), F.when(F.col("id") % 8 == 0, " ").otherwise(F.col("exam_name_raw")).alias("_c1"),
        F.concat("cpt_code", F.lit("a ")).alias("_c2"), F.concat("id", F.lit(" units")).alias("_c3"), F.date_format("log_date", "M/d/yyyy").alias("_c4"),
        F.lower("modality").alias("_c5"),
    )
    return readers.study_rows(rows, places).select("exam_title", "cpt", "work_rvu", "study_date", "accession_number", "modality", "source")


@query(
    PRE
    + """ SELECT exam_name_raw AS exam_title, cpt_code, modifier, CASE WHEN id % 6 = 0 THEN 0.0 ELSE CAST(id AS DOUBLE) / 4 END AS work_rvu, CAST(greatest(1, id % 4) AS DOUBLE) AS quantity
FROM study_logs WHERE NOT contains(exam_name_raw, ',')"""
)
def hospital_list(spark, sf_dir):
    """All logs as lines of a hospital's list with a header."""
    logs = fx.study_logs(spark, sf_dir).where(~F.contains("exam_name_raw", F.lit(",")))
    units = F.when(F.col("id") % 6 == 0, "").otherwise((F.col("id") / 4).cast("string"))
    line = F.concat_ws(" , ", (F.col("id") % 4).cast("string"), "exam_name_raw", "cpt_code", F.coalesce("modifier", F.lit("")), units)
    head = spark.createDataFrame([("f", -1, "Qty,Exam Title,CPT Code,Mod,Work RVU")], "file string, line_no long, value string")
    lines = head.unionByName(logs.select(F.lit("f").alias("file"), F.col("id").cast("long").alias("line_no"), line.alias("value")))
    return readers.hospital_rows(lines).select("exam_title", "cpt_code", "modifier", "work_rvu", "quantity")


_PRESETS = {"7d": "2024-01-13", "30d": "2023-12-21", "90d": "2023-10-22", "all": "2000-01-01", "custom": "2024-01-05"}
_PRESETS_SQL = ", ".join(f"('{p}', DATE '{start}', DATE '{'2024-01-12' if p == 'custom' else '2024-01-20'}')" for p, start in _PRESETS.items())


@query(
    PRE + f""" SELECT preset, count(*) AS studies, round(sum(coalesce(work_rvu, 0)), 6) AS wrvu, CAST(min(l.log_date) AS VARCHAR) AS first_day, CAST(max(l.log_date) AS VARCHAR) AS last_day
FROM (VALUES {_PRESETS_SQL}) AS v(preset, a, b) JOIN study_logs l ON l.log_date BETWEEN a AND b GROUP BY preset"""
)
def history_presets(spark, sf_dir):
    """Logs of each preset of the history: 7, 30 and 90 days, all, and days of one's own."""
    logs, every = fx.study_logs(spark, sf_dir), None
    for preset in _PRESETS:
        start, end = records.date_range(preset, "2024-01-20") if preset != "custom" else records.date_range(preset, "2024-01-20", "2024-01-05", "2024-01-12")
        own = logs.where(F.col("log_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        own = own.agg(
            F.count("*").alias("studies"), F.sum(F.coalesce("work_rvu", F.lit(0.0))).alias("wrvu"), F.min("log_date").alias("first_day"), F.max("log_date").alias("last_day")
        ).where("studies > 0")
        every = own.withColumn("preset", F.lit(preset)) if every is None else every.unionByName(own.withColumn("preset", F.lit(preset)))
    return rounded(every, 6)


@query(_ROWS + " SELECT id, CASE WHEN two THEN title || ' + ' || title WHEN has THEN title ELSE '' END AS descriptions, CAST(two AS INT) + CAST(has AS INT) AS chosen FROM v")
def chosen_descriptions(spark, sf_dir):
    """All candidates of every row chosen: their descriptions as one text."""
    rows = _rows(spark, sf_dir).withColumn("selected", F.array(F.lit(0), F.lit(1), F.lit(7)))
    return rows.select("id", review.code_descriptions().alias("descriptions"), F.size(review.selected_candidates()).alias("chosen"))


@query(
    PRE + """, s AS (SELECT count(*) AS n, coalesce(sum(work_rvu), 0.0) AS total, count(*) FILTER (needs_review) AS r FROM study_logs WHERE log_date = DATE '2024-01-15')
SELECT 'Studies' AS measure, CAST(n AS VARCHAR) AS value FROM s UNION ALL SELECT 'Total wRVU', printf('%.2f', CAST(round(CAST(total AS DECIMAL(18, 8)), 2) AS DOUBLE)) FROM s UNION ALL SELECT 'Needs review', CAST(r AS VARCHAR) FROM s"""
)
def exported_summary(spark, sf_dir):
    """The three summary rows below a day's rows in a file."""
    _, summary = tables.export_day(fx.study_logs(spark, sf_dir).where(F.col("log_date") == F.lit("2024-01-15").cast("date")))
    return summary


@query(
    PRE + """, d AS (SELECT *, row_number() OVER (ORDER BY study_datetime, exam_name_raw, cpt_code) AS line FROM study_logs WHERE log_date = DATE '2024-01-15')
SELECT CAST(line AS INT) AS line, CAST(log_date AS VARCHAR) AS log_date, exam_name_raw, cpt_code, coalesce(modifier, '-') AS modifier, printf('%.2f', CAST(round(CAST(coalesce(work_rvu, 0) AS DECIMAL(18, 8)), 2) AS DOUBLE)) AS work_rvu,
  coalesce(modality, '-') AS modality, match_method, needs_review, coalesce(accession_number, '-') AS accession_number, strftime(study_datetime, '%H:%M') AS study_time FROM d"""
)
def exported_lines(spark, sf_dir):
    """All ten columns of a day's rows as they go to a file, in order."""
    rows, _ = tables.export_day(fx.study_logs(spark, sf_dir).where(F.col("log_date") == F.lit("2024-01-15").cast("date")))
    order = Window.partitionBy("log_date").orderBy("study_datetime", "exam_name_raw", "cpt_code")  # one day, which is what a file holds
    numbered = rows.withColumn("line", F.row_number().over(order))
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return numbered.select(
        "line", "log_date", "exam_name_raw", "cpt_code", dash("modifier"), "work_rvu", dash("modality"), "match_method", "needs_review", dash("accession_number"),
        F.date_format("study_datetime", "HH:mm").alias("study_time"),
    )


@query(
    PRE + """ SELECT id, exam_name_raw || ' ' || strftime(study_datetime, '%-m/%-d/%Y %-I:%M %p') AS raw_text, trim(regexp_replace(exam_name_raw, '  +', ' ', 'g')) AS exam_name
FROM study_logs WHERE id % 4 = 0"""
)
def mixed_lines(spark, sf_dir):
    """Recognised lines of which most say nothing of an exam: headers, labels, bare numbers; only exams stay."""
    logs = fx.study_logs(spark, sf_dir)
    line = (
        F.when(F.col("id") % 4 == 0, F.concat_ws(" ", "exam_name_raw", F.date_format("study_datetime", "M/d/yyyy h:mm a")))
        .when(F.col("id") % 4 == 1, "Accession Number")
        .when(F.col("id") % 4 == 2, F.date_format("study_datetime", "M/d/yyyy h:mm a"))
        .otherwise("ab")
    )
    return readers.ocr_studies(logs.select("id", line.alias("value")), "2024-02-01 00:00:00").select("id", "raw_text", "exam_name")


@query(
    f"""{PRE}, titles AS (SELECT DISTINCT exam_name_raw AS title, exam_name_raw AS prev FROM study_logs), {sqltext.description_cte('titles', 'title', 'des')}
SELECT id, CASE WHEN id % 4 < 2 OR id % 9 <> 0 THEN CAST(l.log_date AS VARCHAR) ELSE '-' END AS study_date, CASE WHEN id % 4 < 2 THEN 0.0 ELSE match_confidence END AS date_time_confidence,
  CASE WHEN id % 4 < 2 THEN 'import_default' ELSE 'ocr' END AS date_time_source, CASE WHEN id % 4 = 3 THEN 'own' ELSE description_key END AS exam_title_normalized,
  CASE WHEN id % 4 = 3 THEN 'shown' ELSE exam_name_raw END AS exam_title_display, CASE WHEN id % 4 = 3 THEN 'text' ELSE '-' END AS cms_description, 14 AS schema_version
FROM study_logs l JOIN des ON des.title = l.exam_name_raw"""
)
def migrated_logs(spark, sf_dir):
    """All logs, written under four versions of the schema, as one table of the newest."""
    logs = fx.study_logs(spark, sf_dir).select("id", "log_date", "exam_name_raw", "match_confidence")
    of = lambda k, version: logs.where(F.col("id") % 4 == k).withColumn(migrations.VERSION, F.lit(version))
    timed = {
        "study_date": F.when(F.col("id") % 9 != 0, F.col("log_date")), "date_time_confidence": F.col("match_confidence"), "date_time_source": F.lit("ocr"),
    }
    titled = {"exam_title_normalized": F.lit("own"), "exam_title_display": F.lit("shown"), "cms_description": F.lit("text")}
    parts = [of(0, 1), of(1, 6), of(2, 8).withColumns(timed), of(3, 12).withColumns(timed | titled)]
    found = migrations.as_one(parts, "study_logs")
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return found.select(
        "id", dash("study_date"), "date_time_confidence", "date_time_source", "exam_title_normalized", "exam_title_display", dash("cms_description"), "schema_version"
    )
