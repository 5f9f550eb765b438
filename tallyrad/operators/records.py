"""Records that people make: manual entries, decisions on suggestions, edits of aliases, reports, queues, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_description, normalize_exam_text
from .duplicates import duplicate_matches, fingerprint
from .tables import commit

#: Fixed value: confidence under which a manual entry goes to review.
SURE = 0.75


def code_list(cells: Column) -> Column:
    """Codes of candidates (array of structs with cpt_code and modifier), with their modifiers, joined by plus signs."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws("-", c["cpt_code"], F.nullif(c["modifier"], F.lit("")))), " + ")


def manual_logs(entries: DataFrame) -> DataFrame:
    """Study logs of entries that people typed: id, profile_id, log_date, exam_name_raw and the candidate they chose.
    There is no time and no accession number; under SURE an entry goes to review. Titles are normalised once each, not
    once a row."""
    exam = F.trim("exam_name_raw")
    nothing = F.lit(None).cast("string")
    titles = entries.select("exam_name_raw").distinct().withColumn("exam_key", normalize_exam_text(exam))
    entries = entries.drop("exam_key").join(titles, "exam_name_raw", "left")
    print_ = fingerprint(F.col("exam_key"), F.col("cpt_code"), F.col("log_date"), F.lit(None).cast("timestamp_ntz"), nothing, F.col("modality"))
    return entries.select(
        "id", "profile_id", "log_date", F.lit(None).cast("timestamp_ntz").alias("study_datetime"), exam.alias("exam_name_raw"),
        "exam_key", "cpt_code", "modifier", "work_rvu", "modality", F.col("method").alias("match_method"),
        F.col("confidence").alias("match_confidence"), (F.col("confidence") < SURE).alias("needs_review"),
        nothing.alias("accession_number"), nothing.alias("session_id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        F.nullif(F.trim("notes"), F.lit("")).alias("notes"), print_.alias("fingerprint"), "description",
    )


def manual_save(entries: DataFrame, stored: DataFrame, anyway: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manual entries saved: the logs to append, what they teach, and the entries held back as likely duplicates.

    An entry that is very likely or possibly a duplicate of a stored log (from with_fingerprint) is held back with
    its match, unless it is saved anyway. What is saved teaches its title, as an event for learn_aliases.
    """
    logs = manual_logs(entries)
    match = duplicate_matches(logs, stored).where(F.col("tier").isin("very_likely", "possible"))
    held = logs.limit(0).select("id", F.lit(0).cast("long").alias("log_id"), F.lit("").alias("tier")) if anyway else match.select("id", "log_id", "tier")
    saved = logs.join(held.select("id"), "id", "left_anti")
    return saved, manual_events(saved), held


def manual_events(saved: DataFrame) -> DataFrame:
    """What saved manual entries teach, and the line for the audit."""
    code = F.concat_ws("-", "cpt_code", F.nullif("modifier", F.lit("")))
    return saved.select(
        "profile_id", F.lit(None).cast("long").alias("site_id"), F.col("exam_key").alias("alias_key"), F.col("id").alias("seq"),
        F.lit("manual_add").alias("action"), code.alias("codes"), F.lit("manual_entry").alias("audit_action"),
        F.concat(F.lit("Manual entry "), "exam_name_raw", F.lit(" -> "), code).alias("summary"),
    )


def queue_logs(rows: DataFrame, stored: DataFrame, log_date: str, session_id: str, profile_id: int, notes: str = "") -> DataFrame:
    """Logs of queued rows of the fee schedule (id, description, cpt_code, modifier, work_rvu, modality), all of one
    session; rows whose fingerprint is stored already, and repeats in the queue, are skipped."""
    day = F.lit(log_date).cast("date")
    exam = normalize_exam_text(F.col("description"))
    none = F.lit(None).cast("string")
    print_ = fingerprint(exam, F.col("cpt_code"), day, F.lit(None).cast("timestamp_ntz"), none, F.col("modality"))
    logs = rows.select(
        "id", F.lit(profile_id).cast("long").alias("profile_id"), day.alias("log_date"), F.col("description").alias("exam_name_raw"), "cpt_code",
        "modifier", "work_rvu", "modality", F.lit("manual_cpt").alias("match_method"), F.lit(1.0).alias("match_confidence"),
        F.lit(False).alias("needs_review"), F.lit(session_id).alias("session_id"), F.nullif(F.trim(F.lit(notes)), F.lit("")).alias("notes"),
        print_.alias("fingerprint"),
    )
    return commit(logs, stored.withColumn("deleted_at", F.lit(None).cast("timestamp")))


def resolve_suggestions(suggestions: DataFrame, decisions: DataFrame, logs: DataFrame) -> DataFrame:
    """Suggestions (id, alias_key, codes as text with bars, status) after decisions (id, status).

    An approved one gets its source, the first log whose description key it is, and for each code the work units of
    the first log with that code; both are null where there is none. Every decided one has an audit action. Without a
    source nothing is learnt.
    """
    now = suggestions.drop("status").join(decisions.select("id", "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    titles = logs.select("exam_name_raw").distinct().withColumn("alias_key", normalize_description(F.col("exam_name_raw")))
    source = logs.join(titles, "exam_name_raw").groupBy("alias_key").agg(F.min_by("exam_name_raw", "id").alias("source"))
    units = logs.groupBy("cpt_code").agg(F.min_by("work_rvu", F.when(F.col("work_rvu").isNotNull(), F.col("id"))).alias("work_rvu"))
    each = now.where("status = 'approved'").select("id", F.posexplode(F.split("codes", r"\|")).alias("place", "code"))
    each = each.withColumn("cpt_code", F.split("code", "-")[0]).join(units, "cpt_code", "left")
    total = each.groupBy("id").agg(F.sum(F.coalesce("work_rvu", F.lit(0.0))).alias("work_rvu"))
    found = now.join(source, "alias_key", "left").join(total, "id", "left")
    approved = F.col("status") == "approved"
    return found.select(
        "id", "alias_key", "codes", "status", F.when(approved, F.col("source")).alias("source"),
        F.when(approved & F.col("source").isNotNull(), F.col("work_rvu")).alias("work_rvu"),
        (approved & F.col("source").isNotNull()).alias("learnt"),
        F.when(approved, "alias_learned").when(F.col("status") == "rejected", "cpt_changed").alias("audit_action"),
    )


def bulk_scope(scope: str, profile_id: int | None, site_id: int | None) -> tuple[int | None, int | None]:
    """Profile and site that a bulk correction is learnt for: future for all, site for the site, personal for one."""
    return (None if scope == "future" else profile_id, site_id if scope == "site" else None)


def bulk_correction(rows: DataFrame, key: str, chosen: Column) -> DataFrame:
    """Rows whose title's description key is `key` get the chosen candidate, in front if they lack it; it alone is
    selected and their review ends."""
    hit = normalize_description(F.col("title")) == key
    same = lambda c: (c["cpt_code"] == chosen["cpt_code"]) & c["modifier"].eqNullSafe(chosen["modifier"])
    with_it = F.when(F.exists("candidates", same), F.col("candidates")).otherwise(F.concat(F.array(chosen), F.col("candidates")))
    return rows.withColumns(
        {
            "candidates": F.when(hit, with_it).otherwise(F.col("candidates")),
            "selected": F.when(hit, F.array(F.lit(0))).otherwise(F.col("selected")),
            "needs_review": F.when(hit, False).otherwise(F.col("needs_review")),
            "review_reason": F.when(~hit, F.col("review_reason")),
        }
    )


def edit_aliases(aliases: DataFrame, edits: DataFrame, deleted: list) -> DataFrame:
    """Aliases (id, alias_text_raw, alias_text, ...) after new texts (edits: id, text) and deletions; blank texts
    change nothing."""
    new = edits.where(F.trim("text") != "").select("id", F.trim("text").alias("text"))
    now = aliases.where(~F.col("id").isin(deleted)).join(new, "id", "left")
    return now.withColumns(
        {
            "alias_text_raw": F.coalesce("text", "alias_text_raw"),
            "alias_text": F.when(F.col("text").isNotNull(), normalize_exam_text(F.col("text"))).otherwise(F.col("alias_text")),
        }
    ).drop("text")


def comparison_report(hospital: DataFrame, logs: DataFrame, discrepancies: DataFrame, report_date: str, filename: str) -> DataFrame:
    """One row that sums a hospital's list against the logs; the discrepancies go to a table of their own, by report."""
    h = hospital.agg(
        F.sum(F.coalesce("work_rvu", F.lit(0.0)) * F.col("quantity")).alias("hospital_wrvu"), F.sum("quantity").alias("hospital_exams")
    )
    own = logs.agg(F.sum(F.coalesce("work_rvu", F.lit(0.0))).alias("local_wrvu"), F.count("*").alias("local_exams"))
    d = discrepancies.agg(F.count("*").alias("discrepancies"))
    return h.crossJoin(own).crossJoin(d).select(  # one row each
        F.lit(report_date).alias("report_date"), F.lit(filename).alias("filename"), "hospital_wrvu", "local_wrvu", "hospital_exams",
        "local_exams", "discrepancies", F.format_string("Compared %s: %d discrepancies", F.lit(filename), "discrepancies").alias("summary"),
    )


def projection(logs: DataFrame, *keys: str, goal: float = 90.0, rate: float | None = None) -> DataFrame:
    """Confirmed and pending work units, what they add up to, what is missing to the goal, percent, and pay at a rate."""
    units = F.coalesce("work_rvu", F.lit(0.0))
    sums = logs.groupBy(*keys).agg(
        F.sum(F.when(~F.col("needs_review"), units).otherwise(0.0)).alias("confirmed"),
        F.sum(F.when(F.col("needs_review"), units).otherwise(0.0)).alias("pending"),
    )
    projected = F.col("confirmed") + F.col("pending")
    pay = lambda c: F.when(F.lit(rate is not None and rate > 0), c * (rate or 0.0))
    return sums.select(
        *keys, "confirmed", "pending", projected.alias("projected"), F.greatest(F.lit(0.0), goal - projected).alias("remaining"),
        F.least(F.lit(100.0), projected / max(1.0, goal) * 100).alias("percent"), pay(F.col("confirmed")).alias("confirmed_pay"),
        pay(projected).alias("projected_pay"),
    )


def hours_worked(manual: Column, start: Column, end: Column) -> Column:
    """Hours that were typed in, else from start to end, else null."""
    apart = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(manual > 0, manual).when(apart > 0, apart / 3.6e9)


def commit_counts(rows: DataFrame, committed: DataFrame) -> DataFrame:
    """Counters of a commit: imported, under review among them, and skipped."""
    done = committed.select("id", F.lit(True).alias("done"))
    return rows.join(done, "id", "left").agg(
        F.count_if("done").alias("imported"), F.count_if(F.col("done") & F.col("needs_review")).alias("review_needed"),
        F.count_if(F.col("done").isNull()).alias("skipped"),
    )


def distinct_values(rows: DataFrame) -> DataFrame:
    """How many sources and dates a batch has, and its first and last date."""
    return rows.agg(
        F.count_distinct("match_method").alias("sources"), F.count_distinct("log_date").alias("dates"),
        F.min("log_date").alias("first_date"), F.max("log_date").alias("last_date"),
    )


def best_moment(lines: DataFrame, *keys: str) -> DataFrame:
    """Of recognised lines (line_no, m from with_moment) the one whose moment is trusted most; the earliest in ties."""
    rank = F.struct(F.col("m.confidence").alias("trust"), (-F.col("line_no")).alias("early"))
    return lines.where(F.col("m").isNotNull()).groupBy(*keys).agg(F.max_by("m", rank).alias("m")).select(*keys, "m.*")


def display_title(override: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(override), F.lit("")), raw)


def initials(name: Column) -> Column:
    """First letters of the first two words."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")


def search_aliases(aliases: DataFrame, text: str) -> DataFrame:
    """Aliases whose text or exam holds a text in any case, or whose code holds it."""
    q = text.lower()
    if not q.strip():
        return aliases
    low = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    return aliases.where(low("alias_text_raw") | low("canonical_exam_name") | F.coalesce(F.contains("cpt_code", F.lit(q)), F.lit(False)))


def search_names(places: DataFrame, text: str) -> DataFrame:
    return places.where(F.contains(F.lower("name"), F.lit(text.lower())))


def date_range(preset: str, as_of: str, start: str | None = None, end: str | None = None) -> tuple[str, str]:
    """First and last day of 7d, 30d, 90d, all or custom."""
    from datetime import date, timedelta

    if preset == "custom":
        return start or "2000-01-01", end or as_of
    days = {"7d": 7, "30d": 30, "90d": 90}.get(preset)
    return ("2000-01-01" if days is None else str(date.fromisoformat(as_of) - timedelta(days=days)), as_of)


def search_logs(logs: DataFrame, text: str, title: str = "display_title") -> DataFrame:
    """Logs that hold a text in title, raw title, description or notes in any case, or in their code as it is."""
    q = text.lower()
    if not q.strip():
        return logs
    low = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    hits = [low(c) for c in (title, "exam_name_raw", "cms_description", "notes") if c in logs.columns]
    found = F.coalesce(F.contains("cpt_code", F.lit(q)), F.lit(False))
    for hit in hits:
        found = found | hit
    return logs.where(found)


def own_or_shared(logs: DataFrame, profile_id: int) -> DataFrame:
    """A profile's logs, and old ones that belong to none."""
    return logs.where((F.col("profile_id") == profile_id) | F.col("profile_id").isNull())


def newest(rows: DataFrame, n: int, by: str = "created_at", *keys: str) -> DataFrame:
    """The n newest rows (of each key); ties go to the greater id."""
    if not keys:
        return rows.orderBy(F.desc(by), F.desc("id")).limit(n)
    order = Window.partitionBy(*keys).orderBy(F.desc(by), F.desc("id"))
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def active_profile(profiles: DataFrame, *keys: str) -> DataFrame:
    """The active profile (of each key), else the one used last; ties go to the smaller id."""
    first = [F.desc("active"), F.desc_nulls_last("last_used"), F.asc("profile_id")]
    if not keys:
        return profiles.orderBy(*first).limit(1)
    order = Window.partitionBy(*keys).orderBy(*first)
    return profiles.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == 1).drop("nth")


def remove_practice(profiles: DataFrame, practice_id: int) -> DataFrame:
    """Profiles after a practice is gone: its profiles stay, without a practice."""
    return profiles.withColumn("practice_id", F.when(~F.col("practice_id").eqNullSafe(F.lit(practice_id)), F.col("practice_id")))


def remove_organization(profiles: DataFrame, practices: DataFrame, organization_id: int) -> tuple[DataFrame, DataFrame]:
    """Profiles and practices after an organization is gone with all its practices."""
    gone = practices.where(F.col("organization_id") == organization_id).select("practice_id", F.lit(True).alias("gone"))
    left = practices.where(~F.col("organization_id").eqNullSafe(F.lit(organization_id)))
    now = profiles.join(gone, "practice_id", "left")
    return now.withColumn("practice_id", F.when(F.col("gone").isNull(), F.col("practice_id"))).drop("gone"), left


def parsed_rows(parsed: DataFrame, stored: DataFrame, version: str, as_of: str) -> DataFrame:
    """Parsed fee rows as rows of the table: id, modality and creation of the stored row with the same code and
    modifier, else new ones (modality by the code)."""
    from ..functions.codes import classify_modality, status_category

    old = stored.groupBy("cpt_code", "modifier").agg(F.min_by(F.struct("id", "modality", "created_at"), "id").alias("old"))
    p, o = parsed.alias("p"), old.alias("o")
    same = (F.col("p.cpt_code") == F.col("o.cpt_code")) & F.col("p.modifier").eqNullSafe(F.col("o.modifier"))
    new_id = F.concat_ws("-", F.lit(version), "p.cpt_code", "p.modifier")
    return p.join(o, same, "left").select(
        F.coalesce(F.col("old.id").cast("string"), new_id).alias("id"), "p.cpt_code", "p.modifier", "p.description", "p.work_rvu", "p.status_code",
        status_category(F.col("p.status_code")).alias("status"),
        F.coalesce(F.col("old.modality"), classify_modality(F.col("p.cpt_code"))).alias("modality"), F.lit(version).alias("rvu_file_version"),
        F.coalesce(F.col("old.created_at"), F.lit(as_of).cast("timestamp_ntz")).alias("created_at"),
    )


def file_year(filename: Column, label: Column, as_of_year: int) -> Column:
    """The year that a file's name or label holds, else this one."""
    return F.coalesce(F.regexp_extract(F.concat_ws(" ", filename, label), r"20\d{2}", 0).try_cast("int"), F.lit(as_of_year))


def file_label(filename: Column) -> Column:
    return F.substring(F.regexp_replace(filename, r"(?i)\.(zip|csv|txt)$", ""), 1, 20)


def legacy_export(logs: DataFrame) -> DataFrame:
    """Lines of the older log file: time, quoted title, work units and running total by profile, two decimals, of
    which halves are rounded up.

    A profile's days are summed apart, and each begins with the sum of the days before it, so that a profile's whole
    life is never in one task.
    """
    cents = lambda c: F.format_string("%.2f", F.floor(c * 100 + 0.500001) / 100)
    units = F.coalesce("work_rvu", F.lit(0.0))
    # logs without a time come first, as a day of their own
    daily = logs.withColumns({"day": F.coalesce(F.to_date("study_datetime"), F.lit("0001-01-01").cast("date")), "owner": F.coalesce(F.col("profile_id").cast("string"), F.lit(""))})
    days = daily.groupBy("owner", "day").agg(F.sum(units).alias("of_day"))
    earlier = Window.partitionBy("owner").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("owner", "day", F.coalesce(F.sum("of_day").over(earlier), F.lit(0.0)).alias("before"))
    order = Window.partitionBy("owner", "day").orderBy("study_datetime", "id").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.col("before") + F.sum(units).over(order)
    quoted = F.concat(F.lit('"'), F.regexp_replace("exam_name_raw", '"', '""'), F.lit('"'))
    return daily.join(before, ["owner", "day"]).select(
        "id",
        F.concat_ws(
            ",", F.date_format("study_datetime", "M/d/yyyy h:mm:ss a"), quoted, cents(units), cents(so_far)
        ).alias("line"),
    )


def dashboard(logs: DataFrame, *keys: str, waiting: float = 0.0) -> DataFrame:
    """The strip of a dashboard: confirmed units, the same with those that wait in a session, the share of rows that
    a known alias approved, minutes that this saved (0.35 a row), and confirmed units an exam; halves are rounded up."""
    confirmed = ~F.col("needs_review")
    sums = logs.groupBy(*keys).agg(
        F.sum(F.when(confirmed, F.coalesce("work_rvu", F.lit(0.0))).otherwise(0.0)).alias("today"), F.count_if(confirmed).alias("exams"),
        F.count("*").alias("studies"), F.count_if((F.col("match_method") == "alias_match") & (F.col("match_confidence") >= 0.95)).alias("automatic"),
    )
    return sums.select(
        *keys, "today", (F.col("today") + waiting).alias("projected"),
        F.floor(F.col("automatic") / F.col("studies") * 100 + 0.5).alias("automatic_percent"),
        F.floor(F.col("automatic") * 0.35 + 0.5).alias("minutes_saved"),
        F.when(F.col("exams") > 0, F.col("today") / F.col("exams")).otherwise(0.0).alias("average"),
    )


def rename_events(logs: DataFrame, log_id, title: str) -> DataFrame:
    """What the rename of a log's session teaches: one correction that maps the log's raw title to the productive
    codes of the session's logs, with the line for the audit."""
    own = logs.where(F.col("id") == log_id).select("session_id", F.col("exam_name_raw").alias("raw"), F.col("profile_id").alias("owner")).limit(1)
    same = F.coalesce(F.col("s.session_id") == F.col("l.session_id"), F.lit(False)) | (F.col("l.id") == log_id)
    related = logs.alias("l").join(F.broadcast(own.alias("s")), same)
    good = (F.col("l.modifier") == "26") & (F.col("l.work_rvu") > 0) & F.col("l.cpt_code").isNotNull()
    codes = F.array_join(F.array_sort(F.collect_set(F.when(good, F.concat(F.col("l.cpt_code"), F.lit("-26"))))), "|")
    return related.groupBy(F.col("s.owner").alias("profile_id"), F.col("s.raw").alias("raw")).agg(codes.alias("codes"), F.count("*").alias("logs")).select(
        "profile_id", normalize_exam_text(F.col("raw")).alias("alias_key"), F.lit("correct").alias("action"), "codes", "logs",
        F.concat(F.lit("Renamed "), "raw", F.lit(f" to {title}")).alias("summary"),
    )


def learned_on(aliases: DataFrame, day: str) -> DataFrame:
    """How many aliases were made on a day, and logs of each kind of decision they rest on."""
    return aliases.where(F.to_date("created_at") == F.lit(day).cast("date")).agg(F.count("*").alias("learned"))


def import_fees(parsed: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An import from parsed rows to the new table: rows of the table, and the counters with significant changes."""
    from .tables import import_counts, upsert_fee_schedule

    changes = upsert_fee_schedule(stored, parsed)
    return changes.drop("change", "percent_change"), import_counts(changes)
