"""Normalisation and similarity of exam titles, as Column expressions built once for a plan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms

#: White space as the producers of titles mean it, which is wider than Java's.
WS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapsed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, f"{WS}+", " "))


def longest_first(keys: list[str]) -> list[str]:
    return sorted(keys, key=len, reverse=True)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def normalize_exam_text(text: Column) -> Column:
    """Lower case, abbreviations written out, noise left out."""
    now = F.regexp_replace(trimmed(F.lower(text)), "_+", " ")
    now = F.regexp_replace(now, r"[.,;:()\[\]{}]", " ")
    for phrase in longest_first([k for k in terms.ABBREVIATIONS if "/" in k]):
        now = F.regexp_replace(
            now, f"(?<=^|{WS}){re.escape(phrase)}(?={WS}|$)", f" {terms.ABBREVIATIONS[phrase]} "
        )
    now = collapsed(F.regexp_replace(now, "/", " "))
    known = literal_map(terms.ABBREVIATIONS)
    full = F.flatten(F.transform(words(now), lambda w: F.split(F.coalesce(known[w], w), " ")))
    return F.array_join(F.filter(full, lambda w: ~w.isin(terms.TITLE_NOISE) & (w != "")), " ")


def _phrases(text: Column) -> Column:
    rules = sorted(terms.PHRASES, key=lambda r: -len(r[0]))
    return reduce(
        lambda now, r: F.regexp_replace(now, f"(^|{WS}){re.escape(r[0])}(?={WS}|$)", f"$1{r[1]}"),
        rules,
        F.concat(F.lit(" "), text, F.lit(" ")),
    )


def normalize_description(text: Column) -> Column:
    """Upper case and the short forms of fee schedules."""
    now = trimmed(F.upper(text))
    for pattern, put in (
        ("[\\u2010-\\u2015]", "-"), ("&", " AND "), (r"[_.,;:()\[\]{}+]", " "), ("-", " "), (f"{WS}*/{WS}*", " / "),
    ):
        now = F.regexp_replace(now, pattern, put)
    now = _phrases(collapsed(now))
    for pattern, put in terms.REWRITES:
        now = F.regexp_replace(now, pattern, put)
    now = _phrases(collapsed(now))
    for pattern, put in terms.LAST_REWRITES:
        now = F.regexp_replace(now, pattern, put)
    return collapsed(now)


def title_case(text: Column) -> Column:
    parts = F.split(text, f"{WS}+")
    return F.array_join(
        F.transform(
            parts,
            lambda w, i: F.when(F.upper(w).isin(terms.UPPER_WORDS), F.upper(w))
            .when((i > 0) & F.lower(w).isin(terms.LOWER_WORDS), F.lower(w))
            .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10**6)))),
        ),
        " ",
    )


def first_match(text: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for p, v in rules], F.lit(None).cast("string"))


def parts_in(text: Column, parts: list[str]) -> Column:
    """The listed parts that a lower-case text holds, in the list's order."""
    return F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))


def radiology_title(text: Column) -> Column:
    """Title without protocol names and abbreviations, as a struct of title and was_protocol."""
    now = trimmed(F.lower(text))
    for pattern, put in (("[_\\-]+", " "), (r"[.,;:()\[\]{}@#]", " ")):
        now = F.regexp_replace(now, pattern, put)
    now = collapsed(now)
    protocol = F.coalesce(
        *[F.when(F.contains(now, F.lit(k)), F.lit(terms.PROTOCOLS[k])) for k in longest_first(list(terms.PROTOCOLS))],
        F.lit(None).cast("string"),
    )
    spelt = now
    for key in longest_first([k for k in terms.EXPANSIONS if " " in k or "/" in k]):
        spelt = F.regexp_replace(spelt, f"(?i)(?<![a-z]){re.escape(key)}(?![a-z])", terms.EXPANSIONS[key])
    known = literal_map(terms.EXPANSIONS)
    kept = F.filter(words(collapsed(spelt)), lambda w: ~F.lower(w).isin(terms.RADIOLOGY_NOISE))
    full = collapsed(F.array_join(F.transform(kept, lambda w: F.coalesce(known[F.lower(w)], w)), " "))
    return F.struct(title_case(F.coalesce(protocol, full)).alias("title"), protocol.isNotNull().alias("was_protocol"))


def radiology_facts(title: Column) -> Column:
    """What a normalised title says: modality, parts and contrast."""
    contrast = (
        F.when(title.rlike("(?i)with and without|without and with"), "with_and_without")
        .when(title.rlike(r"(?i)\bwithout\b"), "without")
        .when(title.rlike(r"(?i)\bwith\b"), "with")
    )
    return F.struct(
        first_match(title, terms.TITLE_MODALITY).alias("modality"),
        parts_in(F.lower(title), terms.BODY_PARTS).alias("body_parts"),
        contrast.alias("contrast"),
    )


def description_facts(text: Column) -> Column:
    """What a fee schedule's description says: modality, parts and contrast."""
    contrast = (
        F.when(text.rlike(r"(?i)with(?:out)?\s+and\s+with(?:out)?|without\s+and\s+with"), "with_and_without")
        .when(text.rlike(r"(?i)\bwithout\b"), "without")
        .when(text.rlike(r"(?i)\bwith\s+contrast\b|\bw/\s*c\b|\bpost.?contrast\b"), "with")
    )
    return F.struct(
        first_match(text, terms.DESCRIPTION_MODALITY).alias("modality"),
        parts_in(F.lower(text), longest_first(terms.BODY_PARTS + terms.BODY_PHRASES)).alias("body_parts"),
        contrast.alias("contrast"),
    )


def long_words(text: Column) -> Column:
    """Different words longer than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), f"{WS}+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of the words longer than two characters."""
    x, y = long_words(a), long_words(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(
        F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))
    )


def facts_score(query: Column, facts: Column) -> Column:
    """0.40 modality, 0.30 parts, 0.20 contrast."""
    modality = (
        F.when(query["modality"].isNull() | facts["modality"].isNull(), 0.5)
        .when(query["modality"] == facts["modality"], 1.0)
        .otherwise(0.05)
    )
    asked, has = F.array_distinct(query["body_parts"]), facts["body_parts"]
    hits = F.filter(asked, lambda p: F.exists(has, lambda d: F.contains(d, p) | F.contains(p, d)))
    parts = (
        F.when(F.size(asked) == 0, 0.5)
        .when(F.size(has) == 0, 0.2)
        .otherwise(F.try_divide(F.size(hits).cast("double"), F.size(asked)))
    )
    both = F.lit("with_and_without")
    contrast = (
        F.when(query["contrast"].isNull() | facts["contrast"].isNull(), 0.5)
        .when(query["contrast"] == facts["contrast"], 1.0)
        .when((query["contrast"] == both) | (facts["contrast"] == both), 0.7)
        .otherwise(0.1)
    )
    return modality * 0.40 + parts * 0.30 + contrast * 0.20


def radiology_score(title: Column, query: Column, description: Column, facts: Column) -> Column:
    """What both say, and 0.10 for their words."""
    total = facts_score(query, facts) + jaccard(title, description) * 0.10
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def string_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longest))


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the shorter list's words, repeats counted, that the other has; the first is shorter in ties."""
    few = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    many = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    hits = F.size(F.filter(few, lambda w: F.array_contains(many, w)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(few)), F.lit(0.0))


def contrast_penalty(a: Column, b: Column) -> Column:
    """0.3 if one side is with and the other without contrast."""
    without = lambda w: F.array_contains(w, "without")
    with_ = lambda w: F.array_contains(w, "with") & ~F.array_contains(w, "without")
    return F.when((without(a) & with_(b)) | (without(b) & with_(a)), 0.3).otherwise(1.0)


def combined_similarity(a: Column, b: Column) -> Column:
    """Of two texts that went through normalize_exam_text."""
    x, y = words(a), words(b)
    return (token_overlap(x, y) * 0.8 + string_similarity(a, b) * 0.2) * contrast_penalty(x, y)
