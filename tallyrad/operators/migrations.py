"""Tables whose rows were written under different versions of the schema, read as one table of the newest.

A step belongs to a version and a table: the columns that the version brought, each with the value that older rows
get. Steps run in order, so a later one may use what an earlier one filled in. Rows keep the version they were
written under until they are migrated; then they carry the newest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_description

NEWEST = 14
VERSION = "schema_version"

#: What a column is filled with, from the columns that a row has: its type, and a value or a function of the row.
Fill = tuple[str, object]


def _or_null(name: str) -> Callable[[DataFrame], Column]:
    return lambda df: F.col(name) if name in df.columns else F.lit(None)


class OfText:
    """A fill that a text decides alone: each distinct text is normalised once, not each row."""

    def __init__(self, column: str, function: Callable[[Column], Column]):
        self.column, self.function = column, function

    def added(self, rows: DataFrame, asked: Column, name: str) -> DataFrame:
        """`rows` with column `name`: in rows that are asked for what the function makes of the column (missing: empty), else null."""
        text = F.coalesce(self.column, F.lit(""))
        key = f"{name}:text"
        keyed = rows.withColumn(key, F.when(asked, text))
        each = keyed.select(key).where(F.col(key).isNotNull()).distinct().withColumn(name, self.function(F.col(key)))
        return keyed.join(each, key, "left").drop(key)


#: What each version brought, and what older rows get.
STEPS: list[tuple[int, str, dict[str, Fill]]] = [
    (3, "study_logs", {"profile_id": ("long", None)}),
    (3, "exam_aliases", {"profile_id": ("long", None)}),
    (4, "profiles", {"practice_id": ("long", None)}),
    (4, "practices", {"organization_id": ("long", None)}),
    (5, "exam_aliases", {"cpt_codes": ("array<string>", lambda df: F.array()), "total_work_rvu": ("double", None), "canonical_exam_name": ("string", None)}),
    (6, "settings", {"watch_folder_path": ("string", None), "auto_delete_processed": ("boolean", False)}),
    (7, "study_logs", {"study_date": ("date", _or_null("log_date")), "date_time_confidence": ("double", 0.0), "date_time_source": ("string", "import_default")}),
    (8, "settings", {"require_crop_before_ocr": ("boolean", True)}),
    (
        10, "study_logs",
        {
            "exam_title_normalized": ("string", OfText("exam_name_raw", normalize_description)),
            "exam_title_display": ("string", lambda df: F.coalesce("exam_name_raw", F.lit(""))), "cms_description": ("string", None),
        },
    ),
    (
        11, "exam_aliases",
        {
            "confirmations": ("long", lambda df: F.coalesce(_or_null("times_used")(df), F.lit(1))), "corrections": ("long", 0), "rejections": ("long", 0),
            "auto_approved_count": ("long", 0), "last_adjusted_at": ("timestamp", _or_null("last_used_at")),
        },
    ),
    (
        11, "settings",
        {
            "unknowns_only_review": ("boolean", True), "review_auto_approved_exams": ("boolean", False), "review_only_low_confidence": ("boolean", False),
            "auto_import_clipboard_screenshots": ("boolean", False), "always_process_dictation_clipboard": ("boolean", False), "clear_clipboard_after_import": ("boolean", False),
        },
    ),
    (13, "settings", {"estimated_comp_per_wrvu": ("double", None)}),
    (14, "exam_aliases", {"site_id": ("long", None)}),
    (14, "audit_log", {"site_id": ("long", None)}),
    (14, "hospital_reports", {"site_id": ("long", None)}),
]


def migrate(rows: DataFrame, table: str, to: int = NEWEST) -> DataFrame:
    """Rows of a table (with schema_version; null: the first) as rows of version `to`.

    A row older than a step gets the step's values where it has none; rows as new as the step keep their nulls.
    Rows that are newer than `to` are left as they are. Running it again changes nothing.
    """
    if VERSION not in rows.columns:
        rows = rows.withColumn(VERSION, F.lit(1))
    now = rows.withColumn(VERSION, F.coalesce(VERSION, F.lit(1)))
    for version, of, fills in STEPS:
        if of != table or version > to:
            continue
        older = F.col(VERSION) < version
        for name, (kind, value) in fills.items():
            if isinstance(value, OfText):
                asked = older if name in now.columns else F.lit(True)
                now, value = value.added(now, asked, f"{name}:new"), lambda df, name=name: F.col(f"`{name}:new`")
            new = (value(now) if callable(value) else F.lit(value)).cast(kind)
            now = now.withColumn(name, F.when(older, F.coalesce(name, new)).otherwise(F.col(name)) if name in now.columns else new)
            now = now.drop(f"{name}:new")
    return now.withColumn(VERSION, F.greatest(F.col(VERSION), F.lit(to)))


def as_one(parts: list[DataFrame], table: str, to: int = NEWEST) -> DataFrame:
    """Files of several versions, each read with its own columns, as one table of version `to`."""
    every = None
    for part in parts:
        now = migrate(part, table, to)
        every = now if every is None else every.unionByName(now, allowMissingColumns=True)
    return every
