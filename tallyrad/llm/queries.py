"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, langid, licences, merkle, mixing, quality, repeats, resampling, secrets, simhash, topk, toxicity
from .common import documents, fold, table

#: Folds that models don't learn from.
LABEL_FOLDS, LANGUAGE_FOLDS, LANGUAGE_HELD = 5, 3, 1
MODEL_FOLDS, MODEL_HELD = 5, 1
#: One fold of so many is tampered with before the manifest is verified.
TAMPERED_FOLDS = 5
TOXICITY_THRESHOLD, QUALITY_THRESHOLD = 0.5, 0.3


def learnable(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """doc_id and a label of the documents that models may learn it from."""
    return table(spark, sf_dir, "labels").select("doc_id", label).where(fold("doc_id", LABEL_FOLDS) != 0)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", LABEL_FOLDS) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(documents(spark, sf_dir, "doc_id", "text"))
    return found.withColumn("dice", F.round("dice", 9))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.learn(docs, learnable(spark, sf_dir, "toxic"))
    return _judged(toxicity.score(docs, model), TOXICITY_THRESHOLD)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality.learn(docs, learnable(spark, sf_dir, "quality"))
    return _judged(quality.classify(docs, model), QUALITY_THRESHOLD)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir, "doc_id", "text"), decoded=True)
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as long)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def ledger_path(spark: SparkSession) -> str | None:
    """The folder of the ledger of secret scans, from the session's setting spark.tallyrad.secrets.ledger; without
    it a scan begins with an empty ledger."""
    return spark.conf.get("spark.tallyrad.secrets.ledger", None)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(documents(spark, sf_dir, "doc_id", "text"), ledger_path(spark))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    spans = secrets.joined(F.col("findings"))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind, *_ in secrets.RULES],
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(
        documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    )


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", LANGUAGE_FOLDS) == LANGUAGE_HELD
    model = langid.learn(documents(spark, sf_dir, "doc_id", "text", "lang").where(~held))
    return langid.identify(documents(spark, sf_dir, "doc_id", "text"), model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, and what proofs say of texts that were tampered with: those of a fold, in lower case."""
    docs = documents(spark, sf_dir, *merkle.COLUMNS)
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.coalesce(fold("doc_id", TAMPERED_FOLDS) == 0, F.lit(False))
    found = merkle.manifest(docs, keep={"changed": F.when(hit, merkle.leaf(text=lower))})
    folded = found.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", MODEL_FOLDS) == MODEL_HELD
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = mixing.score(docs, ~held, F.col("lang"))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), *found.columns[1:])


QUERIES = {
    "op1_licences": op1_licences,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_langid": op8_langid,
    "op9_repeats": op9_repeats,
    "op10_topk": op10_topk,
    "op11_merkle": op11_merkle,
    "op12_resampling": op12_resampling,
    "op13_mixing": op13_mixing,
}

#: Matches of a pattern (whole and one group) with what stands between them, which gives their places.
_MATCHES = """
{kind} AS (
  SELECT doc_id, n, text,
    regexp_extract_all(text, '{pattern}', 0) AS whole,
    regexp_extract_all(text, '{pattern}', {group}) AS secret,
    string_split_regex(text, '{pattern}') AS gap
  FROM d
),
{kind}_spans AS (
  SELECT n, {rank} AS rank, '{kind}' AS kind, length(secret) AS size,
    sum(length(g) + coalesce(length(lag_w), 0)) OVER (PARTITION BY n ORDER BY i) AS begins, length(w) AS width
  FROM (
    SELECT n, i, whole[i] AS w, secret[i] AS secret, gap[i] AS g, CASE WHEN i > 1 THEN whole[i - 1] END AS lag_w
    FROM (SELECT n, whole, secret, gap, unnest(range(1, len(whole) + 1)) AS i FROM {kind})
  )
)"""


def _secrets_sql() -> str:
    parts = [
        _MATCHES.format(kind=kind, pattern=pattern.replace("'", "''"), group=group, rank=rank)
        for rank, (kind, pattern, group, _) in enumerate(secrets.RULES)
    ]
    spans = " UNION ALL ".join(
        f"SELECT n, rank, kind, begins, begins + width AS ends FROM {kind}_spans WHERE size >= {least}"
        for kind, _, _, least in secrets.RULES
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, *_ in secrets.RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
{",".join(parts)},
s AS ({spans}),
g AS (
  SELECT n, {counts},
    string_agg(kind || ':' || CAST(begins AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY begins, rank) AS spans
  FROM s GROUP BY n
)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in secrets.RULES)},
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)"""


#: The checksum of a string (unsigned crc32 of its UTF-8 bytes): its bytes from pairs of hexadecimal digits, folded
#: over the table of the reflected polynomial.
_CRC = """
crc_table AS (SELECT list(c ORDER BY b) AS steps FROM (
  SELECT b, list_reduce(list_prepend(b, [CAST(x AS BIGINT) FOR x IN range(8)]),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)))"""


def _crc_sql(value: str) -> str:
    """Of a value whose row also holds the steps of crc_table."""
    hexed = f"hex(encode({value}))"
    listed = f"[CAST('0x' || substr({hexed}, CAST(2 * i + 1 AS INT), 2) AS BIGINT) FOR i IN range(length({hexed}) // 2)]"
    start = "CAST(4294967295 AS BIGINT)"
    folded = f"list_reduce(list_prepend({start}, {listed}), lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INT) + 1]))"
    return f"xor({folded}, {start})"


def _resampling_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    buckets = resampling.BUCKETS
    return f"""
WITH {_CRC.strip()},
d AS (SELECT row_number() OVER () AS n, doc_id, {words} AS words FROM documents),
dw AS (SELECT n, unnest(words) AS word FROM d),
bw AS (SELECT unnest({words}) AS word FROM benchmark),
w AS (SELECT word, {_crc_sql("word")} % {buckets} AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN w USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN w USING (word) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + {buckets})
  / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + {buckets})))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM w) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
f AS (SELECT n, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN w USING (word) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT n, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
    + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (n)),
r AS (SELECT *, n_features >= {resampling.LEAST_WORDS} AS fit,
  row_number() OVER (PARTITION BY n_features >= {resampling.LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS place FROM x)
SELECT doc_id, n_features, weight, score,
  CASE WHEN fit AND place <= {resampling.PERCENT} * (SELECT count(*) FROM r WHERE fit) // 100 THEN place END AS rank FROM r"""


#: Levels that the SQL of the manifest goes up within a source and above the sources: 16 to that power rows at most.
_LEVELS, _TOP_LEVELS = 5, 3


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in merkle.COLUMNS) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts, fan = [], merkle.FAN

    def levels(name: str, of: str, n: int) -> None:
        parts.append(f"{name}0 AS (SELECT tree, r, node FROM {of})")
        for k in range(1, n + 1):
            parts.append(
                f"{name}{k} AS (SELECT tree, b AS r, kids, b = 0 AND len(kids) = 1 AS alone, CASE WHEN b = 0 AND len(kids) = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS node"
                f" FROM (SELECT tree, r // {fan} AS b, list(node ORDER BY r) AS kids FROM {name}{k - 1} GROUP BY tree, r // {fan}))"
            )

    def climbed(name: str, of: str, n: int) -> str:
        """Adds proof and folded root, level by level; a row holds its place in the tree (tree, r)."""
        for k in range(1, n + 1):
            at = f"CAST(x.r // {fan ** (k - 1)} % {fan} AS INT)"
            parts.append(
                f"{of}_{name}{k} AS (SELECT x.* EXCLUDE (proof, folded), x.proof || CASE WHEN y.alone THEN '' ELSE array_to_string(y.kids[1:{at}], '') || array_to_string(y.kids[{at} + 2:], '') END AS proof,"
                f" CASE WHEN y.alone THEN x.folded ELSE sha256(array_to_string(y.kids[1:{at}], '') || x.folded || array_to_string(y.kids[{at} + 2:], '')) END AS folded"
                f" FROM {of if k == 1 else f'{of}_{name}{k - 1}'} x JOIN {name}{k} y ON x.tree = y.tree AND x.r // {fan**k} = y.r)"
            )
        return f"{of}_{name}{n}"

    levels("n", "d", _LEVELS)
    parts.append(f"subs AS (SELECT '' AS tree, tree AS source_tree, node AS node, row_number() OVER (ORDER BY tree) - 1 AS r FROM n{_LEVELS})")
    levels("t", "subs", _TOP_LEVELS)
    inner = climbed("n", "d", _LEVELS)
    parts.append(f"e AS (SELECT x.* EXCLUDE (tree, r), s.node AS subroot, s.tree, s.r FROM {inner} x JOIN subs s ON x.tree = s.source_tree)")
    outer = climbed("t", "e", _TOP_LEVELS)
    return f"""
WITH {_CRC.strip()},
c AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {leaf("text")} AS leaf, {leaf(lower)} AS low,
  coalesce({_crc_sql("CAST(doc_id AS VARCHAR)")} % {TAMPERED_FOLDS} = 0, false) AS hit FROM documents, crc_table),
d AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, '' AS proof,
  CASE WHEN hit THEN low ELSE leaf END AS folded FROM c),
{", ".join(parts)}
SELECT doc_id, leaf, subroot, (SELECT node FROM t{_TOP_LEVELS}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
  folded = (SELECT node FROM t{_TOP_LEVELS}) AS verified FROM {outer}"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle": _merkle_sql(),
    "op12_resampling": _resampling_sql(),
    "op6_secrets": _secrets_sql(),
    "op10_topk": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
s AS (
  SELECT q.n, q.vec_id AS query_id, v.vec_id, CAST(CASE WHEN len(q.x) = 0 THEN 0 ELSE list_inner_product(q.x, v.x) END AS BIGINT) AS score
  FROM v AS q JOIN v ON q.n <> v.n AND len(q.x) = len(v.x) WHERE q.vec_id % 100 = 0
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
