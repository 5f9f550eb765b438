"""Duplicate studies: fingerprints, repeats within a batch, and tiers against logs of the same day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import minutes_of_day
from ..functions.text import normalize_exam_text, words


def fingerprint(exam: Column, code: Column, date: Column, moment: Column, accession: Column, modality: Column) -> Column:
    """exam: a title that went through normalize_exam_text."""
    own, code = F.nullif(F.trim(accession), F.lit("")), F.coalesce(F.trim(code), F.lit("nocpt"))
    day = date.cast("string")
    named = F.concat_ws("|", F.concat(F.lit("fp:"), exam), code, day)
    return (
        F.when(own.isNotNull(), F.concat(F.lit("acc:"), F.upper(own)))
        .when(moment.isNotNull(), F.concat_ws("|", named, F.date_format(moment, "HH:mm")))
        .when((exam != "") & (code != "nocpt"), named)
        .otherwise(F.concat_ws("|", F.concat(F.lit("fp:"), F.coalesce(modality, F.lit("nomod"))), code, day))
    )


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """Adds exam_key and fingerprint. Titles are normalised once each, not once a row."""
    titles = rows.select("exam_name_raw").distinct().withColumn("exam_key", normalize_exam_text(F.col("exam_name_raw")))
    keyed = rows.join(titles, "exam_name_raw", "left")
    return keyed.withColumn(
        "fingerprint",
        fingerprint(
            F.coalesce("exam_key", F.lit("")), F.col("cpt_code"), F.col("log_date"), F.col("study_datetime"),
            F.col("accession_number"), F.col("modality"),
        ),
    )


def repeats_in_batch(rows: DataFrame, order: str = "id") -> DataFrame:
    """Marks all but the first row of each fingerprint as exact duplicates."""
    first = F.min(order).over(Window.partitionBy("fingerprint"))
    return rows.withColumn("batch_duplicate", F.col(order) != first)


#: Minutes up to which studies of one code are very likely and possibly the same, and the share of a
#: name's words that counts where there is no time.
VERY_LIKELY, POSSIBLE, NAMES_ALIKE = 3, 15, 0.7
#: What each rule says: equal number, equal fingerprint, close, near, similar name.
TIERS = ("exact", "exact", "very_likely", "possible", "possible")
REASONS = ("same accession number", "identical fingerprint", "same code, close in time", "same code, near in time", "same code, similar name")


def duplicate_matches(candidates: DataFrame, logs: DataFrame) -> DataFrame:
    """For each candidate the first log of its day, by id, that any tier holds for: id, log_id, tier, reason.

    Both sides come from with_fingerprint. As the first log is wanted, logs are summed up to the smallest id of each
    accession number, fingerprint, minute and name before they are joined; a candidate looks up its keys and the
    quarters of an hour around its own, once for all candidates of a minute. So a code that is very frequent in a day
    gives no pairs of rows. What is found is kept as numbers until each candidate has one row.
    """
    number = F.nullif(F.upper(F.trim("accession_number")), F.lit(""))
    minute = minutes_of_day(F.col("study_datetime"))
    untimed = F.coalesce(minute, F.lit(0)) == 0  # midnight counts as no time
    columns = ["id", "log_date", number.alias("number"), "fingerprint", "cpt_code", minute.alias("minute"), untimed.alias("untimed"), "exam_key"]
    c, g = candidates.select(*columns), logs.select(*columns)
    lowest = F.min("id").alias("log_id")

    def found(df: DataFrame, rule) -> DataFrame:
        return df.select("id", "log_id", rule.cast("int").alias("rule"))

    lit = F.lit
    by_number = c.join(g.where(F.col("number").isNotNull()).groupBy("log_date", "number").agg(lowest), ["log_date", "number"])
    by_print = c.join(g.groupBy("log_date", "fingerprint").agg(lowest), ["log_date", "fingerprint"])
    # quarters of an hour: a candidate asks its own and both neighbours, and in each of at most that many minutes
    width = POSSIBLE + 1
    by_minute = g.where(F.col("minute").isNotNull()).groupBy("log_date", "cpt_code", "minute").agg(lowest)
    quarters = by_minute.groupBy("log_date", "cpt_code", F.floor(F.col("minute") / width).alias("quarter")).agg(
        F.collect_list(F.struct("log_id", "minute")).alias("there")
    )
    asks = F.explode(F.sequence(F.floor(F.col("minute") / width) - 1, F.floor(F.col("minute") / width) + 1)).alias("quarter")
    timed = c.where(F.col("minute").isNotNull()).select("id", "log_date", "cpt_code", "minute")
    asked = timed.select("log_date", "cpt_code", "minute").distinct()
    near = asked.select("log_date", "cpt_code", F.col("minute").alias("own"), asks)
    by_time = near.join(quarters, ["log_date", "cpt_code", "quarter"])
    by_time = by_time.withColumn("met", F.array_min(F.filter("there", lambda x: F.abs(x["minute"] - F.col("own")) <= POSSIBLE)))
    by_time = by_time.where(F.col("met").isNotNull()).select("log_date", "cpt_code", "own", "met.log_id", F.abs(F.col("met.minute") - F.col("own")).alias("apart"))
    # the first log of all quarters, and how near it is
    of_minute = [F.min(F.when(hit, F.col("log_id"))).alias(n) for n, hit in (("close", F.col("apart") <= VERY_LIKELY), ("near", F.col("apart") > VERY_LIKELY))]
    first = by_time.groupBy("log_date", "cpt_code", F.col("own").alias("minute")).agg(*of_minute)
    first = first.select("log_date", "cpt_code", "minute", F.least("close", "near").alias("log_id"), (F.coalesce(F.col("close") <= F.col("near"), F.col("close").isNotNull())).alias("is_close"))
    by_time = timed.join(first, ["log_date", "cpt_code", "minute"])

    names = c.select("log_date", "cpt_code", "exam_key", "untimed").distinct()
    had = g.groupBy("log_date", "cpt_code", F.col("exam_key").alias("name")).agg(lowest, F.min(F.when(F.col("untimed"), F.col("id"))).alias("untimed_id"))
    mine, theirs = words(F.col("exam_key")), words(F.col("name"))
    shared = F.size(F.filter(theirs, lambda w: F.array_contains(mine, w)))
    overlap = shared / F.greatest(lit(1), F.least(F.size(F.array_distinct(mine)), F.size(theirs)))
    alike = names.join(had, ["log_date", "cpt_code"]).where(overlap >= NAMES_ALIKE)
    alike = alike.withColumn("log_id", F.when(F.col("untimed"), F.col("log_id")).otherwise(F.col("untimed_id")))
    alike = alike.groupBy("log_date", "cpt_code", "exam_key", "untimed").agg(F.min("log_id").alias("log_id")).where(F.col("log_id").isNotNull())
    by_name = c.join(alike, ["log_date", "cpt_code", "exam_key", "untimed"])

    every = found(by_number, lit(1)).unionByName(found(by_print, lit(2))).unionByName(found(by_time, F.when(F.col("is_close"), 3).otherwise(4)))
    every = every.unionByName(found(by_name, lit(5)))
    rules = range(1, 6)
    firsts = every.groupBy("id").agg(*[F.min(F.when(F.col("rule") == r, F.col("log_id"))).alias(f"of_{r}") for r in rules])
    log_id = F.least(*[f"of_{r}" for r in rules])
    best = firsts.select("id", log_id.alias("log_id"), F.coalesce(*[F.when(F.col(f"of_{r}") == log_id, r) for r in rules]).alias("rule"))
    named = lambda names: F.element_at(F.array(*[lit(n) for n in names]), F.col("rule"))
    return best.select("id", "log_id", named(TIERS).alias("tier"), named(REASONS).alias("reason"))


def check_batch(candidates: DataFrame, logs: DataFrame) -> DataFrame:
    """Duplicate status of every candidate; a repeat within the batch comes before logs."""
    found = duplicate_matches(candidates, logs)
    return repeats_in_batch(candidates).join(found, "id", "left").select(
        *candidates.columns,
        F.when(F.col("batch_duplicate"), "exact").otherwise(F.col("tier")).alias("duplicate_status"),
        F.when(F.col("batch_duplicate"), "repeated in this batch").otherwise(F.col("reason")).alias("duplicate_reason"),
        F.when(~F.col("batch_duplicate"), F.col("log_id")).alias("duplicate_of"),
    )
