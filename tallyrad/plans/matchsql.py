"""The staged matcher and the library search as SQL for DuckDB, written apart from the operators that it checks."""

from __future__ import annotations

import re

from ..functions import terms
from ..operators import matching as m
from . import sqltext
from .analytics import FIXED_FEES
from .fixtures import SQL as PRE
from .sqltext import quoted

_COLLAPSED = lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
_WORDS = lambda e: f"list_filter(string_split({e}, ' '), lambda w: w <> '')"
_FEE = "cpt_code, modifier, description, work_rvu"


def _list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _spelt(expr: str) -> str:
    """Abbreviations of several words or with a bar written out; twice, as neighbours share the space between them."""
    keys = sorted([k for k in terms.EXPANSIONS if " " in k or "/" in k], key=len, reverse=True)
    for key in keys:
        pattern = "(^|[^a-zA-Z])" + re.escape(key).replace("\\ ", " ").replace("\\/", "/") + "($|[^a-zA-Z])"
        for _ in range(2):
            expr = f"regexp_replace({expr}, {quoted('(?i)' + pattern)}, {quoted(chr(92) + '1' + terms.EXPANSIONS[key] + chr(92) + '2')}, 'g')"
    return expr


def _title_case(expr: str) -> str:
    upper, lower = _list(terms.UPPER_WORDS), _list(terms.LOWER_WORDS)
    return (
        f"array_to_string(list_transform(string_split_regex({expr}, '\\s+'), lambda w, i: CASE WHEN list_contains({upper}, upper(w)) THEN upper(w) "
        f"WHEN i > 1 AND list_contains({lower}, lower(w)) THEN lower(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"
    )


def _modality(expr: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {quoted(p)}) THEN {quoted(v)}" for p, v in rules) + " END"


def _parts(expr: str, parts) -> str:
    return f"list_filter({_list(parts)}, lambda p: contains(lower({expr}), p))"


def _contrast(expr: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {quoted('(?i)' + p)}) THEN '{v}'" for p, v in rules) + " END"


_TITLE_CONTRAST = [("with and without|without and with", "with_and_without"), (r"\bwithout\b", "without"), (r"\bwith\b", "with")]
_TEXT_CONTRAST = [
    (r"with(?:out)?\s+and\s+with(?:out)?|without\s+and\s+with", "with_and_without"), (r"\bwithout\b", "without"),
    (r"\bwith\s+contrast\b|\bw/\s*c\b|\bpost.?contrast\b", "with"),
]


def title_ctes(source: str) -> str:
    """tk: what is derived from each title of `source` (title, prev)."""
    protocols = " ".join(
        f"WHEN contains(now, {quoted(k)}) THEN {quoted(terms.PROTOCOLS[k])}" for k in sorted(terms.PROTOCOLS, key=len, reverse=True)
    )
    known = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in terms.EXPANSIONS.items())
    noise = _list(terms.RADIOLOGY_NOISE)
    return f"""
{sqltext.description_cte(source, 'title', 'tdes')},
r0 AS MATERIALIZED (SELECT title, {_COLLAPSED("regexp_replace(regexp_replace(trim(lower(title)), '[_-]+', ' ', 'g'), '[.,;:()\\[\\]{}@#]', ' ', 'g')")} AS now FROM {source}),
r1 AS MATERIALIZED (SELECT title, CASE {protocols} END AS protocol, {_spelt('now')} AS spelt FROM r0),
r2 AS MATERIALIZED (SELECT title, coalesce(protocol, {_COLLAPSED(f"array_to_string(list_transform(list_filter({_WORDS(_COLLAPSED('spelt'))}, lambda w: NOT list_contains({noise}, lower(w))), lambda w: CASE lower(w) {known} ELSE w END), ' ')")}) AS full FROM r1),
r3 AS MATERIALIZED (SELECT title, {_title_case('"full"')} AS radiology_title FROM r2),
tk AS MATERIALIZED (SELECT title, radiology_title, description_key, {sqltext.exam_text('title')} AS exam_key, {sqltext.exam_text('description_key')} AS description_exam_key,
  {sqltext.exam_text('radiology_title')} AS radiology_key, {_modality('radiology_title', terms.TITLE_MODALITY)} AS modality,
  {_parts('radiology_title', terms.BODY_PARTS)} AS parts, {_contrast('radiology_title', _TITLE_CONTRAST)} AS contrast
  FROM r3 JOIN tdes USING (title))"""


def fee_ctes() -> str:
    """own: professional rows; fk: what is derived from each of their descriptions."""
    parts = sorted(terms.BODY_PARTS + terms.BODY_PHRASES, key=len, reverse=True)
    return f"""
own AS MATERIALIZED (SELECT * FROM fees WHERE modifier = '26' AND work_rvu > 0),
fsrc AS MATERIALIZED (SELECT DISTINCT description, description AS prev FROM own),
{sqltext.description_cte('fsrc', 'description', 'fdes')},
fk AS MATERIALIZED (SELECT description, description_key AS f_key, {sqltext.exam_text('description_key')} AS f_exam, {sqltext.exam_text('description')} AS f_raw,
  {_modality('description', terms.DESCRIPTION_MODALITY)} AS f_modality, {_parts('description', parts)} AS f_parts, {_contrast('description', _TEXT_CONTRAST)} AS f_contrast FROM fdes)"""


def _jaccard(a: str, b: str) -> str:
    long = lambda e: f"list_distinct(list_filter(string_split_regex(lower({e}), '\\s+'), lambda w: length(w) > 2))"
    x, y = long(a), long(b)
    return (
        f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0 ELSE coalesce(CAST(len(list_intersect({x}, {y})) AS DOUBLE) "
        f"/ nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0.0) END"
    )


def pair_cte() -> str:
    """p: scores of every title with every description."""
    hits = "len(list_filter(parts, lambda a: len(list_filter(f_parts, lambda d: contains(d, a) OR contains(a, d))) > 0))"
    return f"""
p0 AS MATERIALIZED (SELECT tk.*, fk.* FROM tk CROSS JOIN fk),
p AS MATERIALIZED (SELECT *, least(1.0, greatest(0.0,
    CASE WHEN modality IS NULL OR f_modality IS NULL THEN 0.5 WHEN modality = f_modality THEN 1.0 ELSE 0.05 END * 0.40
    + CASE WHEN len(parts) = 0 THEN 0.5 WHEN len(f_parts) = 0 THEN 0.2 ELSE CAST({hits} AS DOUBLE) / len(parts) END * 0.30
    + CASE WHEN contrast IS NULL OR f_contrast IS NULL THEN 0.5 WHEN contrast = f_contrast THEN 1.0
        WHEN contrast = 'with_and_without' OR f_contrast = 'with_and_without' THEN 0.7 ELSE 0.1 END * 0.20
    + ({_jaccard('radiology_title', 'description')}) * 0.10)) AS radiology_score,
  {sqltext.combined('description_exam_key', 'f_exam')} AS text_score FROM p0)"""


def _certain() -> str:
    """Stages that are sure: direct code, common mapping, exact description."""
    rows = ", ".join(f"({quoted(t)}, {k}, {quoted(c)})" for t, codes in terms.COMMON_CODES for k, c in enumerate(codes))
    return f"""
csrc AS MATERIALIZED (SELECT DISTINCT t AS text, t AS prev FROM (VALUES {rows}) AS v(t, place, code)),
{sqltext.description_cte('csrc', 'text', 'cdes')},
s0 AS (SELECT title, 0 AS stage, cpt_code AS seq, {_FEE}, 1.0 AS confidence, 'direct code' AS source FROM tk JOIN own ON regexp_matches(trim(title), '^[0-9]{{5}}$') AND cpt_code = trim(title)),
s3 AS (SELECT title, 3 AS stage, CAST(place AS VARCHAR) AS seq, {_FEE}, {m.COMMON} AS confidence, 'common mapping' AS source
  FROM (VALUES {rows}) AS v(t, place, code) JOIN cdes ON cdes.text = t JOIN tk USING (description_key) JOIN own ON own.cpt_code = code),
s4 AS (SELECT title, 4 AS stage, cpt_code AS seq, {_FEE}, {m.EXACT} AS confidence, 'exact description' AS source FROM tk JOIN fk ON f_key = description_key AND f_key <> '' JOIN own USING (description))"""


def candidates(titles: str, aliases: list[tuple] | None, k: int, entries: list[tuple] | None = None) -> str:
    """Common tables that end in `found`, from a table named titles (title, prev) made by `titles`."""
    parts = [PRE + FIXED_FEES, f" {titles}", title_ctes("titles"), fee_ctes(), pair_cte(), _certain()]
    parts.append(
        f"""
q AS (SELECT title, {_FEE}, greatest(CASE WHEN f_key = description_key THEN {m.EXACT} ELSE 0.0 END, radiology_score, text_score * {m.FUZZY_TEXT}) AS confidence FROM p JOIN own USING (description)),
s6 AS (SELECT title, 6 AS stage, lpad(CAST(place AS VARCHAR), 6, '0') AS seq, {_FEE}, confidence, 'fuzzy description' AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY confidence DESC, cpt_code, description, work_rvu) AS place FROM q WHERE confidence >= {m.LEAST_DESCRIPTION}) WHERE place <= {3 * k})"""
    )
    stages = ["s0", "s3", "s4", "s6"]
    if aliases:
        rows = ", ".join(f"({i}, {scope}, {quoted(text)}, {_list(c)}, {base!r}, {a}, {b}, {r})" for i, scope, text, c, base, a, b, r in aliases)
        sure = "least(1.0, greatest(0.5, base + least(0.09, log10(confirmed + 1) * 0.035) - least(0.25, corrected * 0.06 + rejected * 0.10)))"
        parts.append(
            f"""
av AS MATERIALIZED (SELECT * FROM (VALUES {rows}) AS v(id, scope, alias_text, codes, base, confirmed, corrected, rejected)),
asrc AS MATERIALIZED (SELECT DISTINCT alias_text, alias_text AS prev FROM av),
{sqltext.description_cte('asrc', 'alias_text', 'ades')},
ak AS MATERIALIZED (SELECT id, scope, alias_text, codes, {sure} AS sure, {sqltext.exam_text('alias_text')} AS a_exam, {sqltext.exam_text('description_key')} AS a_description,
  [alias_text, {sqltext.exam_text('alias_text')}, description_key] AS keys FROM av JOIN ades USING (alias_text)),
e0 AS (SELECT title, codes, sure, 0 AS place FROM tk JOIN ak ON len(list_filter(keys, lambda k: k <> '' AND list_contains([exam_key, radiology_key, description_key], k))) > 0
  QUALIFY row_number() OVER (PARTITION BY title ORDER BY scope, id) = 1),
e1 AS (SELECT title, codes, sure, greatest({sqltext.combined('exam_key', 'a_exam')}, {sqltext.combined('description_exam_key', 'a_description')}) AS score, id FROM tk CROSS JOIN ak),
e2 AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, id) AS place FROM e1 WHERE score >= {m.LEAST_ALIAS}),
au AS (SELECT title, 1 AS stage, place, sure AS confidence, 'alias' AS source, unnest(codes) AS code, unnest(range(0, len(codes))) AS part FROM e0
  UNION ALL SELECT title, 5, place, least(sure, score * {m.FUZZY_ALIAS}), 'fuzzy alias', unnest(codes), unnest(range(0, len(codes))) FROM e2 WHERE place <= {k}),
s1 AS (SELECT title, stage, lpad(CAST(place AS VARCHAR), 6, '0') || '.' || lpad(CAST(part AS VARCHAR), 3, '0') AS seq, {_FEE}, confidence, source FROM au JOIN own ON cpt_code = split_part(code, '-', 1))"""
        )
        stages.append("s1")
    if entries:
        rows = ", ".join(f"({i}, {_list(names)}, {_list(c)})" for i, names, c in entries)
        parts.append(
            f"""
dv AS (SELECT id, unnest(names) AS name, codes FROM (VALUES {rows}) AS v(id, names, codes)),
dk AS (SELECT {sqltext.exam_text('name')} AS exam_key, id, codes FROM dv),
df AS (SELECT exam_key, arg_min(codes, id) AS codes FROM dk WHERE exam_key <> '' GROUP BY 1),
du AS (SELECT title, unnest(codes) AS code, unnest(range(0, len(codes))) AS place FROM tk JOIN df USING (exam_key)),
s2 AS (SELECT title, 2 AS stage, CAST(place AS VARCHAR) AS seq, {_FEE}, {m.DICTIONARY} AS confidence, 'dictionary' AS source FROM du JOIN own ON cpt_code = split_part(code, '-', 1))"""
        )
        stages.append("s2")
    union = " UNION ALL ".join(f"SELECT title, stage, seq, {_FEE}, confidence, source FROM {s}" for s in stages)
    parts.append(
        f"""
every AS MATERIALIZED ({union}),
g AS (SELECT *, (SELECT count(*) FROM every b WHERE b.title = a.title AND b.stage < a.stage) AS earlier, min(stage) OVER (PARTITION BY title) AS starts FROM every a),
d AS (SELECT * FROM g WHERE earlier < {k} AND (starts > 0 OR stage = 0)
  QUALIFY row_number() OVER (PARTITION BY title, cpt_code, modifier ORDER BY stage, seq, description, work_rvu) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY confidence DESC, stage, seq, cpt_code) AS rank, max(confidence) OVER (PARTITION BY title) AS top FROM d),
found AS MATERIALIZED (SELECT title, CAST(rank AS INT) AS rank, {_FEE}, confidence, source FROM ranked WHERE top >= {m.LEAST_TOP} AND rank <= {k})"""
    )
    return ",".join(parts)


def library(titles: str, k: int) -> str:
    parts = [PRE + FIXED_FEES, f" {titles}", title_ctes("titles"), fee_ctes(), pair_cte(), _certain()]
    raw = sqltext.combined("exam_key", "f_raw")
    parts.append(
        f"""
b AS (SELECT *, {raw} AS raw_score, len(string_split_regex(trim(title), '\\s+')) > 3 AS many FROM p),
q AS (SELECT title, {_FEE}, greatest(CASE WHEN f_key = description_key THEN {m.EXACT} ELSE 0.0 END,
  CASE WHEN many THEN radiology_score * 0.70 + raw_score * 0.15 + text_score * 0.15 ELSE radiology_score * 0.40 + raw_score * 0.35 + text_score * 0.25 END) AS confidence
  FROM b JOIN own USING (description)),
s6 AS (SELECT title, 6 AS stage, lpad(CAST(place AS VARCHAR), 6, '0') AS seq, {_FEE}, confidence, 'fuzzy description' AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY confidence DESC, work_rvu DESC, cpt_code, description) AS place FROM q WHERE confidence >= {m.LEAST_LIBRARY}) WHERE place <= {2 * k}),
every AS MATERIALIZED ({" UNION ALL ".join(f"SELECT title, stage, seq, {_FEE}, confidence, source FROM {s}" for s in ("s0", "s3", "s4", "s6"))}),
d AS (SELECT * FROM (SELECT *, min(stage) OVER (PARTITION BY title) AS starts FROM every) WHERE starts > 0 OR stage = 0
  QUALIFY row_number() OVER (PARTITION BY title, cpt_code, modifier ORDER BY stage, seq, description, work_rvu) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY stage, seq, cpt_code) AS rank FROM d)
SELECT title, CAST(rank AS INT) AS rank, {_FEE}, round(confidence, 6) AS confidence, source, round(work_rvu, 6) AS work_rvu FROM ranked WHERE rank <= {k}"""
    )
    return ",".join(parts).replace(f"SELECT title, CAST(rank AS INT) AS rank, {_FEE}, round", "SELECT title, CAST(rank AS INT) AS rank, cpt_code, modifier, description, round")
