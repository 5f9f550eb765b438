"""A corpus made ready for training in five stages, each written as Parquet and read again by the next.

Stages judge texts, not ids: rows whose doc_id is null or repeated are kept or dropped by their own text. Columns of
documents pass unchanged, whatever else is in the table; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrad.llm import bpe, decontamination, quality, secrets, simhash
from tallyrad.llm.common import stored, table
from tallyrad.llm.queries import QUALITY_THRESHOLD, learnable, ledger_path

#: Columns that stages add and take away again; no table has columns of such names.
_SCORE, _KEY = "pipeline: score", "pipeline: key"


def _blob() -> Column:
    """The digest of a row's text; null and empty texts count as one."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field finds good enough; all columns of documents.

    Null and empty texts score as one empty line, repeated rows alike; a score that equals the threshold is kept.
    """
    model = quality.learn(table(spark, sf_dir, "documents"), learnable(spark, sf_dir, "quality"))
    scored = quality.classify(docs, model, _SCORE)
    return scored.where(F.col(_SCORE) >= QUALITY_THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; all columns of documents.

    The one with the smallest doc_id stays (none: after all others); of different texts under that id the one with the
    smallest digest, and of rows equal in both any one. Null and empty texts are one group.
    """
    number = F.col("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
    key = F.concat(F.coalesce(F.lpad(number.cast("string"), 20, "0"), F.lit("~")), F.lit(":"), F.md5(_blob()))
    keyed = docs.withColumn(_KEY, key)
    groups = simhash.near_duplicates(keyed.select(F.col(_KEY).alias("doc_id"), "text"))
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(_KEY)).distinct()
    return keyed.join(kept, _KEY, "left_semi").dropDuplicates([_KEY]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; all columns of documents. Null and empty texts hold none; repeated
    rows go or stay together."""
    keyed = docs.withColumn(_KEY, _blob())
    leaks = decontamination.overlaps(keyed.select(F.col(_KEY).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = leaks.select(F.col("doc_id").alias(_KEY)).distinct()
    return keyed.join(leaks, _KEY, "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; all columns of documents, n_chars counted anew (null: 0).

    Findings come from the ledger of secret scans, which gets the blobs that it lacked. Null texts stay null.
    """
    clean = secrets.redact(docs, ledger_path(spark))
    if "n_chars" not in docs.columns:
        return clean
    kind = dict(docs.dtypes)["n_chars"]
    changed = F.coalesce(F.length("text"), F.lit(0)).cast(kind)
    return clean.withColumn("n_chars", changed).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, token_ids (little-endian unsigned 32-bit integers), and the
    digest of the text that decoding them gives back. Null and empty texts have no ids; repeated rows stay."""
    return bpe.encode(docs, decoded=True).select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as long)").alias("n_tokens"),
        "token_ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("BPE encoding and decoding", encoded),
]

#: No SQL: the field, the fingerprints and the merges can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
