"""Rules of review: reasons, labels, approval levels, routing and edits of candidate lists.

Rows under review have candidates (array of structs cpt_code, modifier, description, work_rvu, modality,
confidence, method), selected (array of places in it), duplicate_status, title and needs_review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds on confidence.
LOW, PLAUSIBLE, SELECT, SILENT, LEARNED, SAFE = 0.95, 0.65, 0.75, 0.99, 0.95, 0.85
PROCEDURE_WORDS = (
    r"\b(?:biopsy|lesion|drain|drainage|aspirat|injection|catheter|tube|port|line|needle|arthrogram|myelogram|guided"
    r"|guidance|stereo|procedure)\b"
)


def top(field: str) -> Column:
    return F.get(F.col("candidates"), F.lit(0))[field]


def selected_candidates() -> Column:
    """The chosen candidates in order of choice; places that don't exist are left out."""
    return F.array_compact(F.transform("selected", lambda i: F.get(F.col("candidates"), i)))


def selected_work_rvu() -> Column:
    return F.aggregate(selected_candidates(), F.lit(0.0), lambda s, c: s + F.coalesce(c["work_rvu"], F.lit(0.0)))


def code_descriptions() -> Column:
    texts = F.filter(F.transform(selected_candidates(), lambda c: c["description"]), lambda t: t.isNotNull() & (t != ""))
    return F.array_join(texts, " + ")


def radiology_code(code: Column) -> Column:
    return code.rlike(r"^7\d{4}$")


def procedure_signal() -> Column:
    text = F.concat_ws(" ", F.col("title"), F.array_join(F.transform("candidates", lambda c: c["description"]), " "))
    return F.lower(text).rlike(PROCEDURE_WORDS) | F.exists("candidates", lambda c: c["modality"] == "PROCEDURE")


def counts(c: Column) -> Column:
    """A candidate with professional work units."""
    return F.coalesce((c["modifier"] == "26") & (c["work_rvu"] > 0), F.lit(False))


def several_plausible() -> Column:
    good = F.filter("candidates", lambda c: counts(c) & (c["confidence"] >= PLAUSIBLE))
    return (F.size(good) > 1) | (F.size(selected_candidates()) > 1)


def safe_candidate() -> Column:
    """The one candidate that may be approved without a look, or null."""
    chosen = F.filter(selected_candidates(), counts)
    one = F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0))).otherwise(F.get(F.filter("candidates", counts), F.lit(0)))
    good = radiology_code(one["cpt_code"]) & (one["confidence"] >= SAFE) & ~several_plausible() & ~procedure_signal()
    return F.when(good, one)


def safe_approval() -> Column:
    possible = F.coalesce(F.col("duplicate_status") == "possible", F.lit(False))
    return safe_candidate().isNotNull() & ~possible


def prior_mapping() -> Column:
    one = safe_candidate()
    return F.coalesce((one["method"] == "alias_match") & (one["confidence"] >= LEARNED), F.lit(False))


def review_reason() -> Column:
    """The first rule of the pipeline that holds, or null. The reasons are fixed values."""
    first = F.get(F.col("candidates"), F.lit(0))
    plausible = F.filter("candidates", lambda c: counts(c) & (c["confidence"] >= PLAUSIBLE))
    return (
        F.when(first.isNull(), "New or unknown exam")
        .when(~counts(first), "Not modifier 26 productivity RVU")
        .when(F.col("duplicate_status") == "possible", "Possible duplicate")
        .when(first["confidence"] < LOW, "Low confidence match")
        .when((F.size(plausible) > 1) & (first["method"] != "alias_match"), "Multiple possible CPT matches")
    )


def manual_reason() -> Column:
    """The first rule of the reviewer's page that holds, or null. The reasons are fixed values."""
    chosen = selected_candidates()
    one = F.coalesce(F.get(chosen, F.lit(0)), F.get(F.col("candidates"), F.lit(0)))
    return (
        F.when(one.isNull(), "No match")
        .when(F.size(chosen) > 1, "Multiple CPTs selected")
        .when(~counts(one), "Not modifier 26 productivity RVU")
        .when(~radiology_code(one["cpt_code"]), "Non-7xxxx CPT requires explicit selection")
        .when(one["confidence"] < SAFE, "Low confidence")
        .when(several_plausible(), "Multiple possible CPT matches")
        .when(procedure_signal(), "Possible multi-CPT/procedure exam")
        .when(F.col("duplicate_status") == "possible", "Possible duplicate")
    )


def confidence_label() -> Column:
    """What a reviewer is told of a match. The labels are fixed values."""
    one = F.coalesce(F.get(selected_candidates(), F.lit(0)), F.get(F.col("candidates"), F.lit(0)))
    return (
        F.when(one.isNull(), "No match")
        .when((one["method"] == "alias_match") & (one["confidence"] >= LEARNED), "Exact alias match")
        .when((one["confidence"] >= SAFE) & (one["method"] == "radiology_match"), "High-confidence normalized match")
        .otherwise("Fuzzy match needs review")
    )


def approval_level() -> Column:
    alias = (top("method") == "alias_match") & F.col("duplicate_status").isNull()
    return F.when(alias & (top("confidence") >= SILENT), "silent").when(alias & (top("confidence") >= LEARNED), "learned")


def default_selection() -> Column:
    first = F.get(F.col("candidates"), F.lit(0))
    return F.when((first["confidence"] >= SELECT) & counts(first), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def classify(rows: DataFrame) -> DataFrame:
    """Adds what the pipeline decides about rows with id, title, candidates and duplicate_status.

    Exact and very likely duplicates are skipped. A row needs no review if it was approved, or if nothing
    speaks against it and its first candidate is good enough to be selected.
    """
    now = rows.withColumn("selected", default_selection()).withColumn("review_reason", review_reason())
    now = now.withColumn("approval_level", approval_level()).withColumn("confidence_label", confidence_label())
    skipped = F.coalesce(F.col("duplicate_status").isin("exact", "very_likely"), F.lit(False))
    approved = F.col("approval_level").isNotNull() & F.col("review_reason").isNull()
    weak = F.coalesce(top("confidence") < SELECT, F.lit(True))
    return now.select(
        "*",
        approved.alias("auto_approved"),
        (~approved & (F.col("review_reason").isNotNull() | weak)).alias("needs_review"),
        F.when(skipped, "skipped").otherwise("review").alias("route"),
    )


def visible(rows: DataFrame, mode: str) -> DataFrame:
    """Rows of a review mode: everything, auto, low or unknown."""
    rules = {
        "everything": F.lit(True),
        "auto": F.col("approval_level").isNotNull(),
        "low": top("confidence") < LOW,
        "unknown": F.size("candidates") == 0,
    }
    return rows.where(rules[mode])


def force_include(rows: DataFrame, ids: list) -> DataFrame:
    """Skipped rows taken back: no duplicate any more, and under review."""
    hit = F.col("id").isin(ids) & (F.col("route") == "skipped")
    return rows.select(
        *[
            F.when(hit, v).otherwise(F.col(c)).alias(c) if (v := {"route": F.lit("review"), "needs_review": F.lit(True), "duplicate_status": F.lit(None).cast("string")}.get(c)) is not None else F.col(c)
            for c in rows.columns
        ]
    )


def select_candidates(rows: DataFrame, key: Column, places: list[int]) -> DataFrame:
    """Chooses places for all rows for which key holds; review ends if just one is chosen and nothing speaks
    against it."""
    wanted = F.filter(F.array_distinct(F.array(*[F.lit(p) for p in places])), lambda i: (i >= 0) & (i < F.size("candidates")))
    now = rows.withColumn("selected", F.when(key, wanted).otherwise(F.col("selected")))
    settled = (F.size("selected") == 1) & manual_reason().isNull()
    return now.withColumn("needs_review", F.when(key, ~settled).otherwise(F.col("needs_review")))


def choose_first(rows: DataFrame, key: Column, code: str, modifier: str) -> DataFrame:
    """Moves a candidate to the front, without its copies, and ends the review."""
    is_it = lambda c: (c["cpt_code"] == code) & c["modifier"].eqNullSafe(F.lit(modifier))
    moved = F.concat(F.slice(F.filter("candidates", is_it), 1, 1), F.filter("candidates", lambda c: ~is_it(c)))
    hit = key & F.exists("candidates", is_it)
    return rows.withColumn("candidates", F.when(hit, moved).otherwise(F.col("candidates"))).withColumn(
        "needs_review", F.when(hit, False).otherwise(F.col("needs_review"))
    )


def add_selection(rows: DataFrame, key: Column, wanted: Column) -> DataFrame:
    """Selects the candidates in `wanted` (array of candidate structs) too; those a row lacks are appended."""
    code = lambda c: F.concat_ws("-", c["cpt_code"], F.coalesce(c["modifier"], F.lit("")))
    have = F.transform("candidates", code)
    every = F.concat("candidates", F.filter(wanted, lambda c: ~F.array_contains(have, code(c))))
    keys = F.array_union(F.transform(selected_candidates(), code), F.transform(wanted, code))
    places = F.filter(
        F.transform(F.col("every"), lambda c, i: F.when(F.array_contains(F.col("chosen"), code(c)), i)), lambda i: i.isNotNull()
    )
    now = rows.withColumn("every", every).withColumn("chosen", keys)
    now = now.withColumn("selected", F.when(key, places).otherwise(F.col("selected")))
    now = now.withColumn("candidates", F.when(key, F.col("every")).otherwise(F.col("candidates"))).drop("every", "chosen")
    return now.withColumn("needs_review", F.when(key, manual_reason().isNotNull()).otherwise(F.col("needs_review")))


def approve(rows: DataFrame, key: Column) -> DataFrame:
    """Approves rows for which key holds and that are safe: the safe candidate alone, no review."""
    one = safe_candidate()
    place = (F.array_position("candidates", one) - 1).cast("int")
    hit = key & one.isNotNull()
    return rows.select(
        *[
            F.when(hit, F.array(place)).otherwise(F.col(c)).alias(c) if c == "selected"
            else F.when(hit, False).otherwise(F.col(c)).alias(c) if c == "needs_review" else F.col(c)
            for c in rows.columns
        ]
    )


def direct_code_allowed(text: Column, context: Column | None = None) -> Column:
    """A bare code may count as a match; from OCR only with words of an exam and none of an identifier near."""
    is_code = F.trim(text).rlike(r"^\d{5}$")
    if context is None:
        return is_code
    return is_code & (F.trim(context) != F.trim(text)) & context.rlike(EXAM_CONTEXT) & ~context.rlike(IDENTIFIER_CONTEXT)


# Words around codes.
EXAM_CONTEXT = (
    r"(?i)\b(?:ct|cta|mri?|mra|x-?ray|xr|ultrasound|u/s|us|nm|pet|fluoro|mammogram|mammo|angiogram|abdomen|pelvis|chest"
    r"|head|neck|brain|spine|lumbar|thoracic|cervical|knee|shoulder|hip|ankle|wrist|contrast|with|without|w/o|w/)\b"
)
IDENTIFIER_CONTEXT = (
    r"(?i)\b(?:\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?|dob|date of birth|age|mrn"
    r"|medical record|accession|acc|patient(?:\s+id)?|account|acct|encounter|order|csn|fin|har)\b"
)


def session_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Measures of a review session."""
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("route") == "review").alias("rows"),
        F.count_if(F.col("route") == "skipped").alias("skipped"),
        F.count_if(F.col("needs_review")).alias("under_review"),
        F.count_if(F.col("approval_level").isNotNull()).alias("auto_approved"),
        F.sum(F.when(F.col("route") == "review", selected_work_rvu()).otherwise(0.0)).alias("wrvu"),
        F.sum(F.when(F.col("route") == "review", F.size(selected_candidates())).otherwise(0)).alias("codes"),
    )


def import_counters(rows: DataFrame, *keys: str) -> DataFrame:
    """Counters of the import page: rows that aren't skipped, with a choice, codes chosen, possible duplicates, safe
    ones, coded without review, their share and the minutes saved (0.35 a row, halves up)."""
    own = F.col("route") == "review"
    chosen = F.size(selected_candidates())
    sums = rows.groupBy(*keys).agg(
        F.count_if(own).alias("included"), F.count_if(own & (chosen > 0)).alias("matched"), F.sum(F.when(own, chosen).otherwise(0)).alias("codes"),
        F.count_if(own & F.coalesce(F.col("duplicate_status") == "possible", F.lit(False))).alias("possible_duplicates"),
        F.count_if(safe_approval()).alias("safe"), F.count_if(own & ~F.col("needs_review")).alias("coded"),
        F.count_if(own & F.col("needs_review")).alias("under_review"),
    )
    return sums.select(
        "*", F.when(F.col("included") > 0, F.col("coded") / F.col("included") * 100).otherwise(0.0).alias("coded_percent"),
        F.floor(F.col("coded") * 0.35 + 0.5).alias("minutes_saved"),
    )
