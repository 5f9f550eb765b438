"""Studies on their way into the log: matching, duplicates and review of a batch, and the logs that are committed.

The same functions serve a batch, a registered query and every micro-batch of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import normalize_description
from . import duplicates, matching, review
from .staging import cut

#: What a study is: no code means that its title is matched.
STUDY = (
    "id string, exam_title string, cpt string, log_date date, study_datetime timestamp_ntz, date_time_confidence double, "
    "accession_number string, modality string"
)
MOST = 6


def candidate_lists(
    asked: DataFrame, schedule: DataFrame, aliases: DataFrame | None, entries: DataFrame | None, k: int = MOST
) -> DataFrame:
    """Candidates of each distinct text (column asked) as an array in order of rank. Texts without any are left out."""
    found = matching.candidates(asked.select(F.col("asked").alias("title")), schedule, aliases, entries, k)
    method = (
        F.when(F.col("source") == "alias", "alias_match").when(F.col("source") == "direct code", "manual_cpt").otherwise("radiology_match")
    )
    one = F.struct(
        "rank", "cpt_code", "modifier", "description", "work_rvu", codes.classify_modality(F.col("cpt_code")).alias("modality"),
        "confidence", method.alias("method"), explanation(F.col("source"), F.col("description"), F.col("confidence")).alias("explanation"),
    )
    lists = found.groupBy(F.col("title").alias("asked")).agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    return lists.withColumn("candidates", F.transform("candidates", lambda c: c.dropFields("rank")))


def explanation(source: Column, description: Column, confidence: Column) -> Column:
    """Why a candidate was found, in words for a reviewer."""
    percent = F.concat(F.round(confidence * 100).cast("int").cast("string"), F.lit("%"))
    return F.concat(source, F.when(description != "", F.concat(F.lit(" to "), description)).otherwise(""), F.lit(", "), percent)


def import_rows(
    studies: DataFrame, schedule: DataFrame, stored: DataFrame, aliases: DataFrame | None = None, entries: DataFrame | None = None, k: int = MOST,
    lists: DataFrame | None = None,
) -> DataFrame:
    """Rows under review of a batch of studies, with their candidates, duplicates, review reason and route.

    studies: id, exam_title, cpt, log_date, study_datetime, accession_number, modality. A study's code, or else its
    title, is matched; duplicates are looked for under its code, or else its first candidate's, in the batch and in
    stored logs (id, exam_name_raw, cpt_code, log_date, study_datetime, accession_number, modality, fingerprint,
    exam_key) of its day. lists: candidate_lists of the studies' texts, if they are there already.
    """
    asked = F.coalesce(F.nullif(F.trim("cpt"), F.lit("")), F.col("exam_title"))
    rows = studies.withColumn("asked", asked)
    if lists is None:  # a row for each distinct text, asked for twice
        lists = cut(candidate_lists(rows, schedule, aliases, entries, k))
    first = lists.select("asked", F.col("candidates")[0]["cpt_code"].alias("first_code"), F.col("candidates")[0]["modality"].alias("first_modality"))
    keyed = rows.join(first, "asked", "left").withColumn("exam_name_raw", F.col("exam_title"))
    keyed = keyed.withColumn("cpt_code", F.coalesce(F.nullif(F.trim("cpt"), F.lit("")), F.col("first_code")))
    keyed = keyed.withColumn("modality", F.coalesce("modality", "first_modality")).drop("first_code", "first_modality")
    printed = cut(duplicates.with_fingerprint(keyed))  # every rule for duplicates asks for it
    checked = duplicates.check_batch(printed, stored)
    empty = F.array().cast(lists.schema["candidates"].dataType)
    listed = checked.join(lists, "asked", "left").withColumn("candidates", F.coalesce("candidates", empty))
    return review.classify(listed.withColumn("title", F.col("exam_title")))


def committed_logs(rows: DataFrame, import_id: str, profile_id: int | None) -> DataFrame:
    """Logs of rows on the review route: one for each selected candidate with professional work units.

    A row's logs share a session; a log is under review if its row is, if the row may be a duplicate or if the
    candidate isn't sure enough.
    """
    chosen = F.filter(review.selected_candidates(), review.counts)
    now = rows.where(F.col("route") == "review").withColumn("chosen", chosen).where(F.size("chosen") > 0)
    texts = F.array_join(F.filter(F.transform("chosen", lambda c: c["description"]), lambda t: t.isNotNull() & (t != "")), " + ")
    now = now.withColumn("texts", texts).select("*", F.posexplode("chosen").alias("place", "c"))
    unsure = (F.col("c.confidence") < review.SELECT) | F.col("needs_review") | F.coalesce(F.col("duplicate_status") == "possible", F.lit(False))
    several = F.size("chosen") > 1
    logs = now.select(
        F.concat_ws("/", F.lit(import_id), "id", F.col("place").cast("string")).alias("id"), F.lit(profile_id).cast("long").alias("profile_id"), "log_date", "study_datetime",
        F.col("exam_title").alias("exam_name_raw"), normalize_description(F.col("exam_title")).alias("exam_title_normalized"),
        F.coalesce(F.nullif(F.col("c.description"), F.lit("")), F.nullif(F.col("texts"), F.lit(""))).alias("cms_description"),
        F.col("c.cpt_code").alias("cpt_code"), F.lit("26").alias("modifier"), F.col("c.work_rvu").alias("work_rvu"), F.coalesce("modality", "c.modality").alias("modality"),
        F.col("c.method").alias("match_method"), F.col("c.confidence").alias("match_confidence"), unsure.alias("needs_review"), "accession_number",
        F.concat_ws("/", F.lit(import_id), "id").alias("session_id"), F.lit(import_id).alias("source_import_id"),
        F.when(several, F.concat(F.lit("Combined CPT study: "), F.col("texts"))).alias("notes"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )
    return duplicates.with_fingerprint(logs)
