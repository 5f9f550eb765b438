"""Text rules as SQL expressions for DuckDB, written apart from the Column expressions that they check."""

from __future__ import annotations

import re

from ..functions import terms
from ..operators.explorer import search_terms


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replace(expr: str, pattern: str, put: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(put)}, 'g')"


def _whole(expr: str, phrase: str, put: str) -> str:
    """Replaces a phrase between white space; spaces are doubled first, as this engine can't look ahead."""
    doubled = f"(' ' || replace({expr}, ' ', '  ') || ' ')"
    return "trim(" + _replace(_replace(doubled, r"(^|\s)" + re.escape(phrase).replace(r"\ ", "  ") + r"(\s|$)", r"\1" + put + r"\2"), r"\s+", " ") + ")"


def exam_text(expr: str) -> str:
    now = _replace(_replace(f"trim(lower({expr}))", "_+", " "), r"[.,;:()\[\]{}]", " ")
    for phrase in sorted([k for k in terms.ABBREVIATIONS if "/" in k], key=len, reverse=True):
        now = _whole(now, phrase, terms.ABBREVIATIONS[phrase])
    now = f"string_split({_replace(now, r'[/ ]+', ' ')}, ' ')"
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in terms.ABBREVIATIONS.items())
    full = f"string_split(array_to_string(list_transform({now}, lambda w: CASE w {cases} ELSE w END), ' '), ' ')"
    noise = ", ".join(quoted(w) for w in terms.TITLE_NOISE)
    return f"array_to_string(list_filter({full}, lambda w: w <> '' AND w NOT IN ({noise})), ' ')"


def _phrases(expr: str) -> str:
    for phrase, put in sorted(terms.PHRASES, key=lambda r: -len(r[0])):
        expr = _whole(expr, phrase, put)
    return expr


def description_steps() -> list[tuple[str, str]]:
    """Named steps of the description's normalisation, each of the one before it, called prev."""
    first = "trim(upper(prev))"
    for pattern, put in (("[‐-―]", "-"), ("&", " AND "), (r"[_.,;:()\[\]{}+]", " "), ("-", " "), (r"\s*/\s*", " / "), (r"\s+", " ")):
        first = _replace(first, pattern, put)
    middle = "prev"
    for pattern, put in terms.REWRITES:
        middle = _replace(middle, pattern, put)
    last = "prev"
    for pattern, put in terms.LAST_REWRITES:
        last = _replace(last, pattern, put)
    tidy = lambda e: "trim(" + _replace(e, r"\s+", " ") + ")"
    steps = [f"trim({first})"]
    rules = sorted(terms.PHRASES, key=lambda r: -len(r[0]))
    for _ in range(2):
        for at in range(0, len(rules), 8):
            step = "prev"
            for phrase, put in rules[at : at + 8]:
                step = _whole(step, phrase, put)
            steps.append(step)
        steps.append(tidy(middle) if _ == 0 else tidy(last))
    return steps


def description_cte(source: str, key: str, name: str) -> str:
    """A chain of tables that ends in `name` (key, description_key), from source (key, prev)."""
    tables, before = [], source
    steps = description_steps()
    for k, step in enumerate(steps):
        own = name if k == len(steps) - 1 else f"{name}_{k}"
        column = "description_key" if k == len(steps) - 1 else "prev"
        tables.append(f"{own} AS MATERIALIZED (SELECT {key}, {step} AS {column} FROM {before})")
        before = own
    return ",\n".join(tables)


def modality(expr: str) -> str:
    number = f"TRY_CAST(nullif(regexp_extract(upper(trim({expr})), '^[0-9]+'), '') AS INT)"
    mammo = " OR ".join(f"starts_with(upper(trim({expr})), '{p}')" for p in terms.MAMMO_PREFIXES)
    cases = [f"WHEN {mammo} THEN 'MAMMO'", f"WHEN regexp_matches(upper(trim({expr})), '^[A-Z]') OR {number} IS NULL THEN 'OTHER'"]
    for name, ranges in terms.CODE_RANGES:
        label, _, plain = name.partition(" ")
        inside = " OR ".join(f"{number} BETWEEN {lo} AND {hi}" for lo, hi in ranges)
        also = f" AND ({number} % 2 = 0 OR {number} < 73200)" if plain else ""
        cases.append(f"WHEN ({inside}){also} THEN '{label}'")
    return "CASE " + " ".join(cases) + " ELSE 'OTHER' END"


def overlap(few: str, many: str) -> str:
    """Words of one list, repeats counted, that the other has, by the shorter list's length."""
    return (
        f"CASE WHEN len({few}) = 0 OR len({many}) = 0 THEN 0.0 WHEN len({few}) <= len({many}) "
        f"THEN CAST(len(list_filter({few}, lambda w: list_contains({many}, w))) AS DOUBLE) / len({few}) "
        f"ELSE CAST(len(list_filter({many}, lambda w: list_contains({few}, w))) AS DOUBLE) / len({many}) END"
    )


def combined(a: str, b: str) -> str:
    """Similarity of two normalised titles; a and b are column names."""
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    x, y = f"list_filter({x}, lambda w: w <> '')", f"list_filter({y}, lambda w: w <> '')"
    text = f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"
    out = lambda w: f"list_contains({w}, 'without')"
    with_ = lambda w: f"(list_contains({w}, 'with') AND NOT list_contains({w}, 'without'))"
    penalty = f"CASE WHEN ({out(x)} AND {with_(y)}) OR ({out(y)} AND {with_(x)}) THEN 0.3 ELSE 1.0 END"
    return f"(({overlap(x, y)}) * 0.8 + ({text}) * 0.2) * ({penalty})"


def search_score(query: str) -> str:
    """Score of a row (cpt_code, hay) for a query, of which the terms are known."""
    scores = ["0"]
    for term in search_terms(query):
        hits = " + ".join(f"CAST(contains(hay, {quoted(w)}) AS INT)" for w in term.split())
        scores += [
            f"CASE WHEN lower(cpt_code) = {quoted(term)} THEN 200 WHEN starts_with(lower(cpt_code), {quoted(term)}) THEN 170 ELSE 0 END",
            f"CASE WHEN contains(hay, {quoted(term)}) THEN {130 + len(term)} ELSE 0 END",
            f"({hits}) * 24 + CASE WHEN {hits} = {len(term.split())} THEN 30 ELSE 0 END",
        ]
    return f"greatest({', '.join(scores)})"
