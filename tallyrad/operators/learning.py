"""What reviewers' decisions teach: confidence of aliases, groups of unknown titles, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import confidence_shift


#: Events of an alias that are folded in one array.
SEGMENT = 512


def _after(x, lo, hi, shift):
    """What a step makes of a confidence: moved by shift, kept between lo and hi."""
    return F.least(hi, F.greatest(lo, x + shift))


def learn_aliases(events: DataFrame) -> DataFrame:
    """Confidence of each alias after its events, folded in order.

    events: profile_id, site_id, alias_key, seq, action (confirm, correct, reject, manual_add), codes (the
    mapping as text, sorted). The first event makes the alias; each later one counts, and a changed mapping
    lowers the confidence where the same one raises it. Counts are running sums. A step moves the confidence and
    keeps it within bounds, and two such steps are one such step, so segments of an alias's events are folded
    apart and then their results in order; no alias is gathered in one place.
    """
    keys = ["profile_id", "site_id", "alias_key"]
    order = Window.partitionBy(*keys).orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    now = events.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("codes").over(order))
    new, reject = F.col("place") == 1, F.col("action") == "reject"
    changed = ~new & (F.col("before") != F.col("codes"))
    tally = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(so_far).cast("int")
    now = now.withColumns(
        {
            "changed": changed, "confirmations": tally(new | ~reject),
            "corrections": tally(changed | (F.col("action") == "correct")), "rejections": tally(reject),
        }
    )
    # where the alias begins the step forgets what was before: its bounds are one value
    first = F.when(F.col("action").isin("manual_add", "correct"), 0.95).otherwise(0.90)
    moved = confidence_shift(F.col("confirmations"), F.col("corrections"), F.col("rejections"))
    step = F.struct(
        F.when(new, first).otherwise(0.5).alias("lo"), F.when(new, first).otherwise(1.0).alias("hi"),
        F.when(new, 0.0).otherwise(moved).alias("shift"), F.when(new, 0.0).when(F.col("changed"), -0.08).otherwise(0.015).alias("then"),
        new.alias("new"),
    )
    now = now.withColumn("step", step).withColumn("segment", F.floor((F.col("place") - 1) / SEGMENT))

    def joined(s, lo, hi, shift):
        return F.struct(_after(s["lo"], lo, hi, shift).alias("lo"), _after(s["hi"], lo, hi, shift).alias("hi"), (s["shift"] + shift).alias("shift"))

    def both(s, e):
        """A step is two: the moved confidence, and the bonus or malus of the mapping; the first event has just one."""
        one = joined(s, e["lo"], e["hi"], e["shift"])
        return F.when(e["new"], one).otherwise(F.transform(F.array(one), lambda x: joined(x, F.lit(0.5), F.lit(1.0), e["then"]))[0])

    same = F.struct(F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"), F.lit(0.0).alias("shift"))
    inside = F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda x: x["step"])
    last = F.max(F.struct("place", "codes", "confirmations", "corrections", "rejections")).alias("last")
    parts = now.groupBy(*keys, "segment").agg(F.aggregate(inside, same, both).alias("fold"), last)
    folds = F.transform(F.array_sort(F.collect_list(F.struct("segment", "fold"))), lambda x: x["fold"])
    whole = parts.groupBy(*keys).agg(
        F.aggregate(folds, same, lambda s, e: joined(s, e["lo"], e["hi"], e["shift"])).alias("fold"), F.max("last").alias("last")
    )
    return whole.select(
        *keys, F.col("fold.lo").alias("confidence"), "last.codes", "last.confirmations", "last.corrections", "last.rejections",
        F.col("last.place").alias("used"),
    )


def unknown_groups(logs: DataFrame, key: str) -> DataFrame:
    """Titles under review that come more than once, the most frequent first, with their first row."""
    return (
        logs.where(F.col("needs_review"))
        .groupBy(F.col(key).alias("key"))
        .agg(F.count("*").alias("n"), F.min_by("exam_name_raw", "id").alias("sample"), F.min("id").alias("first_id"))
        .where(F.col("n") > 1)
        .orderBy(F.desc("n"), "key")
    )


def suggestions(logs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Mappings that came at least twice and aren't known yet (column alias_key), with their codes."""
    codes = F.array_sort(F.collect_set(F.when(F.col("modifier") == "26", F.concat("cpt_code", F.lit("-26")))))
    found = logs.where(~F.col("needs_review")).groupBy(F.col(key).alias("alias_key")).agg(F.count("*").alias("n"), codes.alias("codes"))
    found = found.where((F.col("n") >= 2) & (F.size("codes") > 0)).join(known.select("alias_key"), "alias_key", "left_anti")
    return found.select("alias_key", "n", F.array_join("codes", "|").alias("codes"), (F.size("codes") > 1).alias("is_combination"))


def merge_dictionary(entries: DataFrame, learnt: DataFrame) -> DataFrame:
    """Entries after learning. Both: normalized_key, synonyms (array), cpt_codes (array), times_used.

    A learnt row joins the entry with its key, or else the first with the same set of codes; its synonyms are
    added. Others become entries of their own.
    """
    codes = F.array_join(F.array_sort("cpt_codes"), "|")
    e = entries.withColumn("codes_key", codes)
    n = learnt.withColumn("codes_key", codes)
    by_key = e.select("normalized_key").withColumn("entry", F.col("normalized_key"))
    by_codes = e.groupBy("codes_key").agg(F.min("normalized_key").alias("same_codes"))
    goes = n.join(by_key, "normalized_key", "left").join(by_codes, "codes_key", "left")
    goes = goes.withColumn("target", F.coalesce("entry", "same_codes", "normalized_key"))
    added = goes.groupBy("target").agg(
        F.array_distinct(F.flatten(F.collect_list("synonyms"))).alias("new_synonyms"),
        F.sum("times_used").alias("new_used"),
        F.min_by("cpt_codes", "normalized_key").alias("new_codes"),
    )
    return e.join(added, e["normalized_key"] == added["target"], "full_outer").select(
        F.coalesce("normalized_key", "target").alias("normalized_key"),
        F.array_sort(F.array_union(F.coalesce("synonyms", F.array().cast("array<string>")), F.coalesce("new_synonyms", F.array().cast("array<string>")))).alias("synonyms"),
        F.coalesce("cpt_codes", "new_codes").alias("cpt_codes"),
        (F.coalesce("times_used", F.lit(0)) + F.coalesce("new_used", F.lit(0))).alias("times_used"),
    )
