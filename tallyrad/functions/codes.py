"""Billing codes, numbers and categories."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def classify_modality(code: Column) -> Column:
    """Default modality of a billing code, by ranges in order."""

    def named(own: Column, number: Column) -> Column:
        plain = (number % 2 == 0) | (number < 73200)
        inside = lambda ranges: reduce(lambda a, b: a | b, [number.between(lo, hi) for lo, hi in ranges])
        mammo = reduce(lambda a, b: a | b, [own.startswith(p) for p in terms.MAMMO_PREFIXES])
        found = F.when(mammo, "MAMMO").when(own.rlike("^[A-Z]") | number.isNull(), "OTHER")
        for name, ranges in terms.CODE_RANGES:
            modality, _, only_plain = name.partition(" ")
            found = found.when(inside(ranges) & plain if only_plain else inside(ranges), modality)
        return found.otherwise("OTHER")

    own = F.upper(F.trim(code))
    both = F.struct(own.alias("own"), F.regexp_extract(own, "^[0-9]+", 0).try_cast("int").alias("number"))
    return let(both, lambda x: named(x["own"], x["number"]))


def numeric_cell(cell: Column) -> Column:
    """A fee schedule's number: blank and NA are null, commas go, what follows a number is ignored."""
    plain = F.regexp_replace(F.trim(cell), ",", "")
    number = F.regexp_extract(plain, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return F.when(F.upper(plain) != "NA", F.nullif(number, F.lit(""))).try_cast("double")


def pc_tc(indicator: Column) -> Column:
    value = F.trim(indicator)
    return (
        F.when(value == "0", "global").when(value.isin("1", "2"), "professional").when(value == "3", "technical").otherwise("na")
    )


def status_category(code: Column) -> Column:
    value = F.upper(F.trim(code))
    return (
        F.when(value == "A", "active")
        .when(value.isin("R", "T"), "restricted")
        .when(value.isin("B", "C", "N", "X"), "excluded")
        .otherwise("unknown")
    )


def parse_modality(text: Column) -> Column:
    value = F.upper(F.trim(text))
    return F.when(value.isin(terms.MODALITIES), value)


def code_label(code: Column, modifier: Column) -> Column:
    """CODE or CODE-MODIFIER."""
    return F.concat_ws("-", code, F.nullif(modifier, F.lit("")))


def productive(modifier: Column, work_rvu: Column) -> Column:
    """Counts towards productivity: professional component with work units."""
    return F.coalesce((modifier == "26") & (work_rvu > 0), F.lit(False))


def percent_change(old: Column, new: Column) -> Column:
    return F.try_divide(new - old, old) * 100


def js_round(x: Column) -> Column:
    """Half goes up, for negative numbers too."""
    return F.floor(x + 0.5)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Lower-case slug of the parts that are not empty, behind a prefix."""
    joined = F.concat_ws("_", *[F.nullif(p, F.lit("")) for p in parts])
    slug = F.regexp_replace(F.regexp_replace(joined, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit(prefix + "_"), F.lower(slug))


def confidence_shift(confirmed: Column, corrected: Column, rejected: Column) -> Column:
    """How far an alias's counts move its confidence."""
    up = F.least(F.lit(0.09), F.log10(confirmed + 1) * 0.035)
    return up - F.least(F.lit(0.25), corrected * 0.06 + rejected * 0.10)


def alias_confidence(base: Column, confirmed: Column, corrected: Column, rejected: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.5), base + confidence_shift(confirmed, corrected, rejected)))
