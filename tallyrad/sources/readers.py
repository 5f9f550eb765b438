"""Readers of the engine's inputs. Headers are looked at on the driver; rows are read and parsed by Spark."""

from __future__ import annotations

import csv
import io
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, dates
from ..functions.rows import once, spread
from ..functions.text import collapsed, trimmed

# Columns of a fee schedule by place, and other names of their headers.
FEE_PLACES = {
    "hcpcs": 0, "modifier": 1, "description": 2, "status_code": 3, "work_rvu": 5, "nonfacility_pe_rvu": 6,
    "facility_pe_rvu": 8, "malpractice_rvu": 10, "nonfacility_total": 11, "facility_total": 12, "pc_tc": 13, "global_days": 14,
}
FEE_HEADERS = {
    "hcpcs": ["hcpcs", "cpt", "cpt/hcpcs code", "hcpcs code"],
    "modifier": ["mod", "modifier"],
    "description": ["description", "short description", "descriptor"],
    "status_code": ["status code", "status", "stat"],
    "work_rvu": ["work rvu", "wrvu", "work_rvu"],
    "nonfacility_pe_rvu": ["non-fac pe rvu", "non facility pe rvu", "pe rvu (non-fac)", "nonfac pe rvu"],
    "facility_pe_rvu": ["fac pe rvu", "facility pe rvu", "pe rvu (fac)"],
    "malpractice_rvu": ["mp rvu", "malpractice rvu"],
    "nonfacility_total": ["non-fac total", "non facility total", "total (non-fac)", "nonfac total"],
    "facility_total": ["fac total", "facility total", "total (fac)"],
    "pc_tc": ["pctc ind", "pctc indicator", "pc/tc indicator"],
    "global_days": ["glob days", "global days", "globalperiod"],
}

# Names of a study list's headers.
STUDY_HEADERS = {
    "exam_title": ["examtitle", "exam", "exam name", "examname", "study", "description"],
    "cpt": ["cpt", "cptcode", "cpt code", "hcpcs"],
    "work_rvu": ["wrvu", "work rvu", "workrvu", "rvu"],
    "study_date": ["studydate", "study date", "date", "logdate", "log date"],
    "study_time": ["studytime", "study time", "datetime", "study datetime"],
    "accession_number": ["accession", "accessionnumber", "accession number", "acc", "acc#"],
    "modality": ["modality", "mod"],
    "patient_mrn": ["mrn", "patientmrn", "patient mrn", "patient id"],
}

STUDY = "exam_title string, cpt string, work_rvu double, study_date date, study_time string, accession_number string, modality string, patient_mrn string, source string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their places: file, line_no, value. Carriage returns and marks of order go."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n")).alias("line_no", "value")
    return whole.select("file", lines)


def zip_member(names: list[str]) -> str | None:
    """Which member of a fee schedule's archive to read."""
    good = [n for n in names if "pprrvu" in n.lower() and n.lower().endswith((".csv", ".txt"))]
    return min(good, key=lambda n: ("nonqpp" not in n.lower(), not n.lower().endswith(".csv")), default=None)


def header_of(rows: list[list[str]]) -> tuple[int, dict[str, int], str | None]:
    """Where the header is in a fee schedule's first rows, columns by name, and a warning."""
    tidy = lambda c: re.sub(r"\s+", " ", (c or "").strip().lower())
    for i, row in enumerate(rows):
        cells = [tidy(c) for c in row]
        above = [tidy(c) for c in rows[i - 1]] if i else []
        if len(cells) > 2 and cells[0] == "hcpcs" and cells[2] == "description" and len(above) > 5 and above[5] == "work":
            return i, FEE_PLACES, None
    for i, row in enumerate(rows):
        cells = [tidy(c) for c in row]
        found = {f: next(cells.index(a) for a in names if a in cells) for f, names in FEE_HEADERS.items() if any(a in cells for a in names)}
        if {"hcpcs", "work_rvu"} <= set(found):
            return i, found, "columns were found by their headers"
    raise ValueError("no fee schedule header in the first rows")


def fee_schedule(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a fee schedule, CSV or a zip that holds one. A schedule is one file of some thousand rows; an
    archive's member is unpacked by one task and parsed by all."""
    if path.lower().endswith(".zip"):

        def unpack(batches):
            for batch in batches:
                for content in batch["content"]:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        if (name := zip_member(z.namelist())) is not None:
                            text = z.read(name).decode("utf-8-sig", "replace")
                            yield _frame(list(csv.reader(io.StringIO(text))))

        rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "n long, c array<string>")
    else:
        lines = spark.read.option("header", False).option("quote", '"').option("escape", '"').schema(
            T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(32)])
        ).csv(path)
        rows = lines.select(F.monotonically_increasing_id().alias("n"), F.array(*lines.columns).alias("c"))
    return fee_rows(rows)


def fee_rows(rows: DataFrame) -> DataFrame:
    """Rows of a fee schedule from its cells: n (place) and c (array). The header is looked for in the first 20."""
    rows = rows.where(F.exists("c", lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")).withColumn(
        "c", F.transform("c", lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "^\ufeff", ""))
    )
    head = [(r.n, r.c) for r in rows.orderBy("n").limit(20).collect()]
    at, places, warning = header_of([c for _, c in head])
    body = rows.where(F.col("n") > head[at][0])
    cell = lambda f: F.trim(F.get(F.col("c"), F.lit(places[f]))) if f in places else F.lit(None).cast("string")
    numbers = [f for f in FEE_PLACES if f.endswith(("rvu", "total"))]
    return body.where(cell("hcpcs").rlike("(?i)^[0-9A-Z]{4,5}$")).select(
        F.upper(cell("hcpcs")).alias("cpt_code"),
        F.upper(F.nullif(cell("modifier"), F.lit(""))).alias("modifier"),
        F.coalesce(cell("description"), F.lit("")).alias("description"),
        F.upper(F.coalesce(F.nullif(cell("status_code"), F.lit("")), F.lit("A"))).alias("status_code"),
        *[codes.numeric_cell(cell(f)).alias(f) for f in numbers],
        codes.pc_tc(cell("pc_tc")).alias("pc_tc"),
        F.nullif(cell("global_days"), F.lit("")).alias("global_days"),
        F.lit(warning).cast("string").alias("warning"),
    )


def _frame(rows: list[list[str]]):
    import pandas as pd

    return pd.DataFrame({"n": range(len(rows)), "c": rows})


def bulk_entries(lines: DataFrame) -> DataFrame:
    """Entries of pasted text: lines with commas are lists, lines of codes too, others are one entry each.

    lines: line_no, value. Order stays; of entries that differ in case only the first stays.
    """
    text = trimmed(F.col("value"))
    listed = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    tokens = F.filter(F.split(text, r"\s+"), lambda p: p != "")
    all_codes = (F.size(tokens) > 1) & F.forall(tokens, lambda t: t.rlike(r"^[0-9]{4,5}[A-Za-z]?$"))
    parts = F.when(F.contains(text, F.lit(",")), listed).when(all_codes, tokens).otherwise(F.array(text))
    every = lines.where(text != "").select("line_no", F.posexplode(parts).alias("place", "entry"))
    first = F.row_number().over(Window.partitionBy(F.lower("entry")).orderBy("line_no", "place"))
    return every.withColumn("copy", first).where(F.col("copy") == 1).select("line_no", "place", "entry")


def studies_of_text(lines: DataFrame) -> DataFrame:
    """Studies of pasted text: five digits are a code, anything else a title."""
    code = F.col("entry").rlike(r"^\d{5}$")
    return bulk_entries(lines).select(
        "entry", F.when(~code, F.col("entry")).alias("exam_title"), F.when(code, F.col("entry")).alias("cpt"), F.lit("csv").alias("source")
    )


def _csv_date(cell: Column) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(cell), f) for f in ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "MMM d, yyyy", "d MMM yyyy")])


def study_places(headers: list[str]) -> dict[str, int]:
    """Which columns of a study list have which fields, by the names of their headers."""
    tidy = [re.sub(r"[^a-z0-9 ]", "", h.lower()).strip() for h in headers]
    return {f: next(tidy.index(a) for a in names if a in tidy) for f, names in STUDY_HEADERS.items() if any(a in tidy for a in names)}


def studies_csv(spark: SparkSession, path: str) -> DataFrame:
    """A study list. Without any known header the file is taken as pasted text."""
    first = spark.read.text(path).limit(1).collect()
    headers = next(csv.reader([first[0].value.lstrip("\ufeff")])) if first else []
    places = study_places(headers)
    if not places:
        found = studies_of_text(_lines(spark, path))
        rest = {f: F.lit(None).cast(t) for f, t in (x.split() for x in STUDY.split(", ")) if f not in ("exam_title", "cpt", "source")}
        return found.withColumns(rest).select(*[x.split()[0] for x in STUDY.split(", ")])
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(headers))])
    rows = spark.read.option("header", True).option("escape", '"').option("enforceSchema", True).schema(schema).csv(path)
    return study_rows(rows, places)


def study_rows(rows: DataFrame, places: dict[str, int]) -> DataFrame:
    """Studies of a list's cells (columns _c0, _c1, ...), fields by place."""
    cell = lambda f: F.nullif(F.trim(F.col(f"_c{places[f]}")), F.lit("")) if f in places else F.lit(None).cast("string")
    return rows.select(
        cell("exam_title").alias("exam_title"),
        F.upper(cell("cpt")).alias("cpt"),
        F.regexp_extract(cell("work_rvu"), r"^[+-]?\d*\.?\d+", 0).try_cast("double").alias("work_rvu"),
        _csv_date(cell("study_date")).alias("study_date"),
        cell("study_time").alias("study_time"),
        cell("accession_number").alias("accession_number"),
        codes.parse_modality(cell("modality")).alias("modality"),
        cell("patient_mrn").alias("patient_mrn"),
        F.lit("csv").alias("source"),
    ).where(F.col("exam_title").isNotNull() | F.col("cpt").isNotNull())


# What OCR lines hold besides the exam.
ACCESSION = r"(?i)\b(?:ACC|ACCESSION)[#:\s]*([A-Z0-9-]{5,})\b"
LONG_NUMBER = r"\b(\d{7,12})\b"
LABELS = (
    r"(?i)\b(?:dob|date of birth|birth date|age|mrn|medical record|patient(?:\s+(?:id|name))?|accession|acc|account|acct"
    r"|encounter|order(?:\s+(?:id|number))?|csn|fin|har)\b"
)
HEADERS = (
    r"(?i)^(?:page \d+|status|completed|study list|patient name|patient id|mrn|dob|date of birth|age|accession|account"
    r"|encounter|order|signed|finalized|dictated|performed|provider|radiologist|facility)\b"
)
STAMPS = [
    r"(?i)\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?", r"(?i)\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}(?::\d{2})?",
    r"(?i)\d{1,2}-\d{1,2}-\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?", r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}-\d{1,2}-\d{2}",
    r"(?i)\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?Z?\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b",
]


def _replace_first(text: Column, pattern: str) -> Column:
    """`text` with a space in place of the first match: what stands before it, and the rest."""

    def put(t: Column) -> Column:
        found = F.regexp_extract(t, pattern, 0)
        before = F.element_at(F.split(t, pattern, 2), 1)
        rest = F.substring(t, F.length(before) + F.length(found) + 1, F.length(t))
        return F.when(found == "", t).otherwise(F.concat(before, F.lit(" "), rest))

    return codes.let(text, put)


def ocr_studies(lines: DataFrame, as_of: str) -> DataFrame:
    """Studies of recognised lines (column value): exam name, moment, date, accession number, confidence, and what
    other columns the lines have.

    Lines that hold nothing but labels, headers or numbers are left out.
    """
    from ..operators.review import EXAM_CONTEXT

    bare = F.col("raw_text")
    for pattern in STAMPS:
        bare = F.regexp_replace(bare, pattern, " ")
    # each step is a column of its own, as the next ones use it several times
    more = [c for c in lines.columns if c != "value"]
    now = spread(lines).select(trimmed(F.col("value")).alias("raw_text"), *more).where(F.length("raw_text") >= 3)
    now = once(now, "bare", bare).withColumn("labelled", F.col("bare").rlike(ACCESSION))
    now = now.withColumn("unlabelled", _replace_first(F.col("bare"), ACCESSION))
    now = now.withColumn("rest", _replace_first(F.col("unlabelled"), LONG_NUMBER))
    now = now.withColumn("rest", _replace_first(F.col("rest"), LABELS))
    rest = trimmed(F.regexp_replace(F.regexp_replace("rest", "[#:_-]+", " "), r"\s{2,}", " "))
    raw, exam = F.col("raw_text"), F.col("raw_text").rlike(EXAM_CONTEXT)
    metadata = (raw.rlike(HEADERS) & ~exam) | (raw.rlike(LABELS) & (~exam | (F.length(rest) < 3)))
    now = now.where(~metadata)
    number = F.when(F.col("labelled"), F.regexp_extract("bare", ACCESSION, 1)).otherwise(
        F.nullif(F.regexp_extract("bare", LONG_NUMBER, 1), F.lit(""))
    )
    name = F.when(F.col("labelled"), F.col("unlabelled")).otherwise(_replace_first(F.col("bare"), LONG_NUMBER))
    now = once(now, "exam_name", trimmed(F.regexp_replace(name, r"\s{2,}", " "))).select("raw_text", "exam_name", number.alias("accession_number"), *more)
    return dates.with_moment(now, "raw_text", F.lit(as_of).cast("timestamp_ntz"), "m").where(F.length("exam_name") >= 2).select(
        "raw_text", "exam_name", F.col("m.study_datetime").alias("study_datetime"), F.col("m.study_date").alias("study_date"),
        "accession_number", F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"), *more,
    )


def ocr_images(images: DataFrame, recognise) -> DataFrame:
    """Lines of images (binaryFile rows). recognise: bytes to a list of lines; any OCR library can be put in."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            found = [(p, i, line) for p, c in zip(batch["path"], batch["content"]) for i, line in enumerate(recognise(bytes(c)))]
            yield pd.DataFrame(found, columns=["path", "line_no", "value"])

    return images.select("path", "content").mapInPandas(run, "path string, line_no int, value string")


def hospital_report(spark: SparkSession, path: str) -> DataFrame:
    """A hospital's list: split at commas, no quotes; with or without a header. A blank number is 0, a missing
    one null; the quantity is 1 at least."""
    return hospital_rows(_lines(spark, path))


def hospital_rows(lines: DataFrame) -> DataFrame:
    """The same from lines: file, line_no, value."""
    rows = lines.withColumn("value", F.trim("value")).where(F.col("value") != "")
    first = rows.orderBy("file", "line_no").limit(1).collect()
    head = [re.sub(r"\s+", "", c.strip().lower()) for c in first[0].value.split(",")] if first else []
    known = bool(set(head) & {"exam", "examtitle", "cpt", "cptcode", "wrvu", "workrvu"})
    names = [["exam", "examtitle", "description", "study"], ["cpt", "cptcode"], ["modifier", "mod"], ["wrvu", "workrvu", "workrvus"], ["quantity", "qty", "count"]]
    at = [next((k for k, c in enumerate(head) if c in own), place) if known else place for place, own in enumerate(names)]
    if known:
        rows = rows.where(F.col("line_no") > first[0].line_no)
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    cell = lambda k: F.get(cells, F.lit(at[k]))
    number = lambda k: F.when(cell(k) == "", 0.0).otherwise(cell(k).try_cast("double"))
    return rows.select(
        F.coalesce(F.nullif(cell(0), F.lit("")), F.nullif(F.get(cells, F.lit(0)), F.lit("")), F.lit("Untitled exam")).alias("exam_title"),
        F.nullif(cell(1), F.lit("")).alias("cpt_code"),
        F.nullif(cell(2), F.lit("")).alias("modifier"),
        number(3).alias("work_rvu"),
        F.greatest(F.lit(1.0), F.coalesce(number(4), F.lit(1.0))).alias("quantity"),
    )


def dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Curated entries that are active and have codes; lists are JSON or divided by bars."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    many = lambda c: F.filter(
        F.transform(F.coalesce(F.from_json(c, "array<string>"), F.split(F.coalesce(c, F.lit("")), r"\|")), lambda x: F.trim(x)), lambda x: x != ""
    )
    lists = ["cpt_codes", "common_aliases", "powerscribe_aliases", "hospital_site_aliases", "typical_combinations"]
    return (
        rows.where(F.lower(F.coalesce("active", F.lit("true"))) != "false")
        .withColumns({c: many(F.col(c)) for c in lists if c in rows.columns})
        .where(F.size("cpt_codes") > 0)
        .withColumn("modality", F.coalesce(codes.parse_modality(F.col("modality")), F.lit("OTHER")))
        .withColumn("modifier_26_wrvu", F.col("modifier_26_wrvu").try_cast("double"))
        .withColumn("id", codes.stable_id("dict", F.col("friendly_exam_name"), F.array_join("cpt_codes", "_")))
    )


def manual_study(spark: SparkSession, exam_title: str | None = None, cpt: str | None = None, **more) -> DataFrame:
    """One study that was typed in; blank ones give no row."""
    row = ((exam_title or "").strip() or None, (cpt or "").strip() or None, more.get("work_rvu"), more.get("study_date"), more.get("study_time"), more.get("accession_number"), more.get("modality"), more.get("patient_mrn"), "manual")
    return spark.createDataFrame([row] if row[0] or row[1] else [], STUDY)


def no_studies(spark: SparkSession) -> DataFrame:
    """The live dictation source, which gives nothing."""
    return spark.createDataFrame([], STUDY)


def jdbc_pages(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, pages: int, **options) -> DataFrame:
    """A remote table read in ranges of a key, a range for each partition."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=pages)
    return reader.options(**options).load()
