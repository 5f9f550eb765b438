"""Secret scans over a ledger of blobs, all in DataFrame functions.

A blob is a text's content, named by its SHA-256. The ledger is a table in a folder; it says which blob was scanned
under which version of the rules, and what was found. A scan takes every historical version of every document, keeps
one row of each blob, scans only those that the ledger lacks under the present version, adds them to the ledger, and
joins the findings back to all rows with that content. The next run with the same folder scans only what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder

#: Kind, pattern (group 2 or 0 is the secret), least length of that group, cheap test that a match needs.
#: Fixed values; letters that stand for both cases are written as classes, which no engine folds further.
RULES = [
    (
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", "(AKIA[A-Z0-9]+)", 0, 20),
    ("hex", "([0-9a-f]{24,})", 0, 24),
]
RULES_VERSION = "2"

SPAN = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules_version string, findings {SPAN}"
#: Matches of a text that are added up together, so that the work grows with their number and not its square.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of a rule's matches in code points: what stands between the matches says where they are."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    pieces = F.transform(
        F.filter(F.arrays_zip(whole.alias("whole"), secret.alias("secret"), between.alias("gap")), lambda x: x["whole"].isNotNull()),
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("width"), (F.length(x["secret"]) >= least).alias("good")
        ),
    )

    def chunks(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(p, i * CHUNK + 1, F.lit(CHUNK)))

    def starts(c: Column) -> Column:
        """Where each chunk begins."""
        sums = F.transform(c, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x["gap"] + x["width"]))
        return F.aggregate(
            sums,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen")),
        )["seen"]

    def spans(p: Column, at: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(at.alias("at"), F.array().cast(SPAN).alias("found")),
            lambda s, x: let(
                s["at"] + x["gap"],
                lambda start: F.struct(
                    (start + x["width"]).alias("at"),
                    F.when(
                        x["good"],
                        F.concat(
                            s["found"],
                            F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["width"]).alias("end"))),
                        ),
                    )
                    .otherwise(s["found"])
                    .alias("found"),
                ),
            ),
        )["found"]

    found = let(
        pieces, lambda p: let(chunks(p), lambda c: let(starts(c), lambda at: F.flatten(F.transform(c, lambda x, i: spans(x, at[i])))))
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, text: str = "text", into: str = "findings") -> DataFrame:
    """Adds the findings of each row's text (not null), all rules together, by start and then by rule."""
    order = {kind: n for n, (kind, *_) in enumerate(RULES)}
    ranked = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    found = F.concat(*[spans_of(F.col(text), *rule) for rule in RULES])
    keyed = F.transform(
        found, lambda s: F.struct(s["start"], F.element_at(ranked, s["kind"]).alias("rank"), s["end"], s["kind"])
    )
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return blobs.withColumn(into, ordered)


def versions(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """Each row as a version of a path: path, blob, text. Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def unseen(history: DataFrame, ledger: DataFrame | None = None, version: str = RULES_VERSION) -> DataFrame:
    """One row (blob, text) of each blob that the ledger (blob, rules_version, ...) lacks under this version.

    Digests are compared first, without texts; then only texts of unseen blobs are dealt out by content, one of each
    from every partition.
    """
    if ledger is not None:
        done = ledger.where(F.col("rules_version") == version).select("blob")
        fresh = history.select("blob").distinct().join(done, "blob", "left_anti")
        history = history.join(fresh, "blob", "left_semi")
    return history.select("blob", "text").dropDuplicates(["blob"])


def update(history: DataFrame, ledger: DataFrame | None = None, version: str = RULES_VERSION) -> DataFrame:
    """New ledger rows: blob, rules_version, findings."""
    return scan(unseen(history, ledger, version)).select("blob", F.lit(version).alias("rules_version"), "findings")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in a folder, None if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def brought_up_to_date(history: DataFrame, path: str | None = None, version: str = RULES_VERSION) -> DataFrame:
    """blob and findings of all blobs of a history, after the ledger in the folder `path` got the rows it lacked.

    Without a path the ledger begins empty, in a new folder of the shared one. New rows are written before they are
    used, so blobs are scanned once. Two runs at a time may both add a blob; one row of it is used.
    """
    spark = history.sparkSession
    path = path or shared_folder(spark)
    update(history, read_ledger(spark, path), version).write.mode("append").parquet(path)
    ledger = read_ledger(spark, path)
    return ledger.where(F.col("rules_version") == version).select("blob", "findings").dropDuplicates(["blob"])


def secret_scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, blob and findings (array of kind, start, end in code points, end exclusive) for every row.

    Null and empty texts have no findings; texts of any length are scanned whole; repeated rows and copies are
    scanned once and each keep their row, rows without a doc_id too; an empty table gives none. Matches of one kind
    never overlap; of kinds that start together the first rule's comes first. Other columns, whatever their names,
    are neither read nor returned. Both sides of the last join are plain shuffles, so that Spark can split the rows
    of a blob that very many rows share.
    """
    history = versions(docs.select("doc_id", "text"))
    known = brought_up_to_date(history, path)
    return history.select("path", "blob").join(known, "blob", "left").withColumnRenamed("path", "doc_id")


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every finding in `text` replaced by a mark; all columns stay, in order.

    Findings come from the ledger (see secret_scan), by blob. Those that overlap are replaced by one mark. Null texts
    stay null; repeated rows stay; an empty table gives none; columns with the names used here aren't touched.
    """
    blob, spans = "redact: blob", "redact: findings"
    known = brought_up_to_date(versions(docs.withColumn("redact: no id", F.lit(None)), "redact: no id"), path)
    known = known.where(F.size("findings") > 0).select(F.col("blob").alias(blob), F.col("findings").alias(spans))
    found = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).join(known, blob, "left")
    text = F.col("text")
    pieces = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda seen, s: F.when(
            s["start"] >= seen["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    seen["out"], F.array(F.substring(text, seen["at"] + 1, s["start"] - seen["at"]), F.lit(mark))
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(seen["at"], s["end"]).alias("at"), seen["out"].alias("out"))),
    )
    clean = let(pieces, lambda p: F.concat(F.array_join(p["out"], ""), F.substring(text, p["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.col(spans).isNotNull(), clean).otherwise(text)).select(*docs.columns)
