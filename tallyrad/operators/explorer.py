"""Browsing a fee schedule: filters, regions of the body, search scores, the professional row of a code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import let

# Regions as ranges of codes; a code can be in several.
REGIONS = [
    ("HEAD_NECK", [(70010, 70110), (70450, 70498), (70540, 70559), (76506, 76536)]),
    ("CHEST", [(71045, 71048), (71250, 71275), (71550, 71555), (76604, 76642)]),
    ("ABDOMEN", [(74150, 74183), (76700, 76776), (78226, 78227)]),
    ("PELVIS", [(72191, 72198), (74176, 74178), (76830, 76857)]),
    ("SPINE", [(72125, 72159), (72200, 72220)]),
    ("UPPER_EXT", [(73000, 73225), (76881, 76882)]),
    ("LOWER_EXT", [(73501, 73725), (76881, 76882)]),
    ("BREAST", [(77046, 77067), (19081, 19086), (76641, 76642)]),
]

# Queries that also ask for other terms.
EXPANSIONS = {
    "stroke": ["ct head", "cta head neck", "code stroke", "head without contrast", "70450", "70496", "70498"],
    "pe": ["pulmonary embolism", "cta chest", "ct angiography chest", "71275"],
    "mrcp": ["mri abdomen", "mr cholangiopancreatography", "bile duct", "74181", "74183"],
    "cta head neck": ["cta head", "cta neck", "ct angiography head neck", "70496", "70498"],
    "liver mri": ["mri abdomen liver", "abdomen mri with contrast", "74183"],
    "rectal mri": ["mri pelvis rectum", "pelvis mri", "72195", "72197"],
    "thyroid ultrasound": ["ultrasound thyroid", "soft tissue head neck", "76536"],
    "breast biopsy": ["mammography biopsy", "breast bx", "stereotactic biopsy", "ultrasound breast biopsy", "19081", "19083"],
}


def code_number(code: Column) -> Column:
    return F.regexp_extract(code, r"^\d+", 0).try_cast("int")


def regions_of(code: Column) -> Column:
    """Regions of a code, in order."""
    number = code_number(code)
    found = []
    for name, ranges in REGIONS:
        inside = F.lit(False)
        for lo, hi in ranges:
            inside = inside | number.between(lo, hi)
        found.append(F.when(inside, name))
    return F.array_compact(F.array(*found))


def region_counts(rows: DataFrame) -> DataFrame:
    every = rows.sparkSession.createDataFrame([(n,) for n, _ in REGIONS], "region string")
    sums = rows.select(F.explode(regions_of(F.col("cpt_code"))).alias("region"), "work_rvu").groupBy("region").agg(
        F.count("*").alias("n"), F.sum("work_rvu").alias("wrvu")
    )
    return F.broadcast(every).join(sums, "region", "left").select(
        "region", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wrvu", F.lit(0.0)).alias("wrvu")
    )


def contrast_of(text: Column) -> Column:
    d = F.lower(text)
    has = lambda t: F.contains(d, F.lit(t))
    return (
        F.when(has("without and with") | has("w/o and w/") | has("w & w/o"), "both")
        .when(has("without contrast") | has("w/o contrast") | d.endswith(" w/o"), "without")
        .when(has("with contrast") | has("w/ contrast") | d.rlike(r"\bw/\s") | d.endswith(" w/"), "with")
        .otherwise("unknown")
    )


def base_rows(cpt: DataFrame) -> DataFrame:
    """Active rows that aren't technical and have work units."""
    return cpt.where((F.col("status") == "active") & (F.col("pc_tc") != "technical") & (F.col("work_rvu") > 0))


def filtered(rows: DataFrame, modality: str | None = None, region: str | None = None, contrast: str | None = None) -> DataFrame:
    """Rows of unknown contrast pass every filter on contrast."""
    if modality:
        rows = rows.where(F.col("modality") == modality)
    if region:
        rows = rows.where(F.array_contains(regions_of(F.col("cpt_code")), region))
    if contrast:
        rows = rows.where(contrast_of(F.col("description")).isin(contrast, "unknown"))
    return rows


def professional_rows(cpt: DataFrame) -> DataFrame:
    """Of each code the row with modifier 26, else the one without, else the first; technical rows don't count."""
    rank = F.when(F.col("modifier") == "26", 0).when(F.col("modifier").isNull(), 1).otherwise(2)
    order = F.row_number().over(Window.partitionBy("cpt_code").orderBy(rank, "id"))
    rows = cpt.where((F.col("pc_tc") != "technical") & (F.col("work_rvu") > 0))
    return rows.withColumn("place", order).where(F.col("place") == 1).drop("place")


def plain(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def search_terms(query: str) -> list[str]:
    own = plain(query)
    if not own:
        return []
    terms = [own, re.sub(r"\bct\s*a\b", "cta", own), re.sub(r"\bmr\s*cp\b", "mrcp", own), re.sub(r"\bultra\s*sound\b", "ultrasound", own)]
    for key, more in EXPANSIONS.items():
        if key in own:
            terms += [plain(t) for t in more]
    return [t for t in dict.fromkeys(terms) if t]


def search_score(query: str, hay: Column) -> Column:
    """200 for the code, 170 for its start, 130 and more for the text, 24 for each word and 30 for all words.
    hay: what a row says, in plain words."""
    code, scores = F.lower("cpt_code"), [F.lit(0)]
    for term in search_terms(query):
        words = term.split()
        hits = sum((F.contains(hay, F.lit(w)).cast("int") for w in words), F.lit(0))
        scores += [
            F.when(code == term, 200).when(code.startswith(term), 170).otherwise(0),
            F.when(F.contains(hay, F.lit(term)), 130 + len(term)).otherwise(0),
            hits * 24 + F.when(hits == len(words), 30).otherwise(0),
        ]
    return F.greatest(*scores, F.lit(0))


def search(rows: DataFrame, query: str) -> DataFrame:
    """Rows that match, best first, then by work units."""
    hay = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "cpt_code", "description", "modality", "modifier")), "[^a-z0-9]+", " "))
    return rows.withColumn("score", let(hay, lambda h: search_score(query, h))).where(F.col("score") > 0).orderBy(F.desc("score"), F.desc("work_rvu"), "cpt_code")
