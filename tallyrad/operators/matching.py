"""Exam titles to billing codes, in stages from certain to fuzzy.

Titles are matched once each and joined back to their rows. Every stage is a join; the later stages count only
where the earlier ones found fewer than k candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import terms
from ..functions.codes import alias_confidence, productive
from .staging import cut

#: Confidence of each stage, and least scores.
DIRECT, COMMON, EXACT, DICTIONARY, FUZZY_ALIAS, FUZZY_TEXT = 1.0, 0.99, 0.96, 0.94, 0.9, 0.92
LEAST_ALIAS, LEAST_DESCRIPTION, LEAST_LIBRARY, LEAST_TOP = 0.5, 0.35, 0.20, 0.50
#: Descriptions of one word in one piece of its list.
HELD = 4096
#: Bounds are loosened by this much, since scores are sums of doubles.
SLACK = 1e-7
FOUND = ["title", "stage", "seq", "cpt_code", "modifier", "description", "work_rvu", "confidence", "source"]


def title_keys(titles: DataFrame) -> DataFrame:
    """Everything that is derived from a title (column title), once for each distinct one."""
    now = titles.select("title").distinct().withColumn("radiology", T.radiology_title(F.col("title")))
    now = now.select(
        "title",
        T.normalize_exam_text(F.col("title")).alias("exam_key"),
        T.normalize_description(F.col("title")).alias("description_key"),
        F.col("radiology.title").alias("radiology_title"),
    )
    now = now.withColumn("radiology_key", T.normalize_exam_text(F.col("radiology_title")))
    now = now.withColumn("description_exam_key", T.normalize_exam_text(F.col("description_key")))
    return now.withColumn("facts", T.radiology_facts(F.col("radiology_title"))).withColumn(
        "keys", F.array_distinct(F.filter(F.array("exam_key", "radiology_key", "description_key"), lambda k: k != ""))
    )


def fee_keys(cpt: DataFrame) -> DataFrame:
    """Professional rows of the fee schedule with work units, and what their descriptions (missing: empty) say, which
    is derived once for each distinct one."""
    cpt = cpt.withColumn("description", F.coalesce("description", F.lit("")))
    own = cpt.where(productive(F.col("modifier"), F.col("work_rvu"))).withColumn("row", F.monotonically_increasing_id())
    said = own.select("description").distinct().withColumn("description_key", T.normalize_description(F.col("description")))
    said = said.withColumn("description_exam_key", T.normalize_exam_text(F.col("description_key")))
    return own.join(said.withColumn("facts", T.description_facts(F.col("description"))), "description")


def _rows(found: DataFrame, stage: int, source: str, confidence, seq="cpt_code") -> DataFrame:
    return found.select(
        "title", F.lit(stage).alias("stage"), F.col(seq).cast("string").alias("seq"), "cpt_code", "modifier",
        "description", "work_rvu", F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"),
        F.lit(source).alias("source"),
    )


def direct(titles: DataFrame, fees: DataFrame) -> DataFrame:
    """A title that is a code."""
    own = titles.select("title", F.trim("title").alias("cpt_code")).where(F.col("cpt_code").rlike(r"^\d{5}$"))
    return _rows(own.join(fees, "cpt_code"), 0, "direct code", F.lit(DIRECT))


def common(titles: DataFrame, fees: DataFrame) -> DataFrame:
    """Descriptions with fixed codes."""
    known = titles.sparkSession.createDataFrame(terms.COMMON_CODES, "text string, codes array<string>")
    known = known.select(T.normalize_description(F.col("text")).alias("description_key"), F.posexplode("codes").alias("place", "cpt_code"))
    own = titles.select("title", "description_key").join(F.broadcast(known), "description_key")
    return _rows(own.join(fees.drop("description_key"), "cpt_code"), 3, "common mapping", F.lit(COMMON), "place")


def exact_description(titles: DataFrame, fees: DataFrame) -> DataFrame:
    own = titles.select("title", "description_key").where(F.col("description_key") != "")
    return _rows(own.join(fees, "description_key"), 4, "exact description", F.lit(EXACT))


def dictionary(titles: DataFrame, entries: DataFrame, fees: DataFrame) -> DataFrame:
    """entries: id, names (array), cpt_codes (array). The first entry with an equal name wins."""
    names = entries.select("id", "cpt_codes", F.explode("names").alias("name"))
    names = names.withColumn("exam_key", T.normalize_exam_text(F.col("name"))).where(F.col("exam_key") != "")
    first = names.groupBy("exam_key").agg(F.min_by("cpt_codes", "id").alias("cpt_codes"))
    own = titles.select("title", "exam_key").join(first, "exam_key")
    own = own.select("title", F.posexplode("cpt_codes").alias("place", "code"))
    own = own.select("title", "place", F.split("code", "-")[0].alias("cpt_code"))
    return _rows(own.join(fees, "cpt_code"), 2, "dictionary", F.lit(DICTIONARY), "place")


def scoped_aliases(aliases: DataFrame, profile_id: int | None, site_id: int | None) -> DataFrame:
    """Aliases of the profile and site or of all, with their rank: the profile's and site's own come first."""
    profile = F.col("profile_id").eqNullSafe(F.lit(profile_id))
    site = F.col("site_id").eqNullSafe(F.lit(site_id))
    rank = F.when(profile, 0).otherwise(4) + F.when(site, 0).when(F.col("site_id").isNull(), 2).otherwise(6)
    return aliases.where((profile | F.col("profile_id").isNull()) & (site | F.col("site_id").isNull())).withColumn("scope", rank)


def alias_keys(aliases: DataFrame) -> DataFrame:
    """aliases: id, scope, alias_text, cpt_codes, match_confidence, confirmations, corrections, rejections."""
    now = aliases.withColumn("exam_key", T.normalize_exam_text(F.col("alias_text")))
    now = now.withColumn("description_key", T.normalize_description(F.col("alias_text")))
    now = now.withColumn("description_exam_key", T.normalize_exam_text(F.col("description_key")))
    counts = [F.coalesce(c, F.lit(0)) for c in ("confirmations", "corrections", "rejections")]
    return now.withColumn("alias_confidence", alias_confidence(F.col("match_confidence"), *counts)).withColumn(
        "keys", F.array_distinct(F.filter(F.array("alias_text", "exam_key", "description_key"), lambda k: k != ""))
    )


def _alias_codes(found: DataFrame, fees: DataFrame, stage: int, source: str) -> DataFrame:
    own = found.select("title", "confidence", "place", F.posexplode("cpt_codes").alias("part", "code"))
    own = own.select(
        "title", "confidence", F.format_string("%06d.%03d", "place", "part").alias("place"), F.split("code", "-")[0].alias("cpt_code")
    )
    return _rows(own.join(fees, "cpt_code"), stage, source, F.col("confidence"), "place")


def exact_alias(titles: DataFrame, aliases: DataFrame, fees: DataFrame) -> DataFrame:
    """The best-ranked alias that shares a key."""
    left = titles.select("title", F.explode("keys").alias("key"))
    right = aliases.select(F.explode("keys").alias("key"), "scope", "id", "cpt_codes", "alias_confidence")
    best = F.min(F.struct("scope", "id", "cpt_codes", "alias_confidence")).alias("b")
    own = left.join(right, "key").groupBy("title").agg(best)
    own = own.select("title", F.lit(0).alias("place"), "b.cpt_codes", F.col("b.alias_confidence").alias("confidence"))
    return _alias_codes(own, fees, 1, "alias")


def fuzzy_alias(titles: DataFrame, aliases: DataFrame, fees: DataFrame, k: int) -> DataFrame:
    """Aliases by similarity. A score of 0.5 needs a shared word (without one it is 0.2 at most), so pairs are
    found by words of either key."""
    tokens = lambda: F.explode(
        F.array_distinct(F.concat(T.words(F.col("exam_key")), T.words(F.col("description_exam_key"))))
    ).alias("word")
    pairs = (
        titles.select("title", tokens()).join(aliases.select("id", tokens()), "word").select("title", "id").distinct()
    )
    both = pairs.join(titles.select("title", "exam_key", "description_exam_key"), "title").join(
        aliases.select(
            "id", "scope", "cpt_codes", "alias_confidence", F.col("exam_key").alias("a_exam"),
            F.col("description_exam_key").alias("a_description"),
        ), "id",
    )
    score = F.greatest(
        T.combined_similarity(F.col("exam_key"), F.col("a_exam")),
        T.combined_similarity(F.col("description_exam_key"), F.col("a_description")),
    )
    order = Window.partitionBy("title").orderBy(F.desc("score"), "id")
    best = both.withColumn("score", score).where(F.col("score") >= LEAST_ALIAS)
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    best = best.withColumn("confidence", F.least("alias_confidence", F.col("score") * FUZZY_ALIAS))
    return _alias_codes(best, fees, 5, "fuzzy alias")


def _texts(fees: DataFrame) -> DataFrame:
    """Distinct descriptions with what is derived from them."""
    return fees.dropDuplicates(["description"]).select(
        "description", F.col("description_key").alias("f_key"), F.col("description_exam_key").alias("f_exam"), F.col("facts").alias("f_facts")
    )


def _long(text: str):
    """Long words; a text without any has the empty one, as two such texts count as equal."""
    long = T.long_words(F.col(text))
    return F.when(F.size(long) == 0, F.array(F.lit(""))).otherwise(long)


def _frequencies(texts: DataFrame, words) -> DataFrame:
    """How many descriptions hold a word, and into how many pieces those of a frequent word are dealt."""
    df = texts.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("held"))
    return df.withColumn("pieces", F.ceil(F.col("held") / HELD).cast("int"))


def _postings(texts: DataFrame, words, frequent: DataFrame, *more) -> DataFrame:
    """word, piece, description, the word's place in it (from 1, the rarest first) and more columns. A description is
    in one piece of each of its words."""
    own = texts.select("description", *more, F.explode(F.array_distinct(words)).alias("word")).join(frequent, "word")
    rare = F.row_number().over(Window.partitionBy("description").orderBy("held", "word"))
    own = own.withColumn("held_place", rare)
    return own.withColumn("piece", F.pmod(F.xxhash64("description"), F.col("pieces")).cast("int")).drop("held", "pieces")


def _probes(titles: DataFrame, words, frequent: DataFrame, *more) -> DataFrame:
    """title, word and more columns, with the word's place (from 1, the rarest first; words that no description
    holds are counted and left out), and the pieces to look it up in."""
    own = titles.select("title", *more, F.explode(F.array_distinct(words)).alias("word")).join(frequent, "word", "left")
    rare = Window.partitionBy("title").orderBy(F.coalesce("held", F.lit(0)), "word")
    own = own.withColumn("place", F.row_number().over(rare)).where("held is not null")
    return own.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("held", "pieces")


def _by_exam_words(titles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that can reach the title's least score by exam words.

    They need a share of the shorter list's words. With all words in one order from rare to frequent, one of the
    shorter list's first words is shared then: as many of them as can't all miss. So a title looks up its own first
    words among descriptions that are as long or longer, and all its words among the first ones of shorter
    descriptions. Repeated words only shorten the lists to be looked up.
    """
    t, f = T.words(F.col("description_exam_key")), T.words(F.col("f_exam"))
    misses = lambda size: F.floor((1 - F.col("share")) * size) + 1
    share = (F.col("least") / FUZZY_TEXT - 0.2) / 0.8 - SLACK
    frequent = _frequencies(texts, f)
    asked = _probes(titles.withColumns({"share": share, "n": F.size(t)}), t, frequent, "share", "n").where(F.col("share") <= 1)
    held = _postings(texts.withColumn("m", F.size(f)), f, frequent, "m")
    longer = asked.where(F.col("place") <= misses(F.col("n"))).join(held, ["word", "piece"]).where(F.col("n") <= F.col("m"))
    first = asked.where(F.col("n") > 1).withColumn("held_place", F.explode(F.sequence(F.lit(1), misses(F.col("n") - 1).cast("int"))))
    shorter = first.join(held, ["word", "piece", "held_place"]).where((F.col("n") > F.col("m")) & (F.col("held_place") <= misses(F.col("m"))))
    return longer.select("title", "description").unionByName(shorter.select("title", "description"))


def _by_long_words(titles: DataFrame, texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs that can reach the title's least score by facts and long words.

    groups: asked, has and given, the score of facts alone, to which the words' Jaccard index adds 0.10 at most. What
    is missing is the least index; with it a title's rarest words are looked up, among the descriptions of the group
    and of a fitting number of words.
    """
    x, y = _long("radiology_title"), _long("description")
    frequent = _frequencies(texts, y)
    asked = _probes(titles.withColumn("n", F.size(x)), x, frequent, "asked", "least", "n").join(groups, "asked")
    asked = asked.withColumn("index", F.greatest(F.lit(0.0), (F.col("least") - F.col("given")) * 10 - SLACK))
    asked = asked.where((F.col("index") <= 1) & (F.col("place") <= F.least("n", F.col("n") - F.ceil(F.col("index") * F.col("n")) + 1)))
    held = _postings(texts.withColumns({"has": F.to_json("f_facts"), "m": F.size(y)}), y, frequent, "has", "m")
    both = asked.join(held, ["has", "word", "piece"])
    return both.where((F.col("m") >= F.col("index") * F.col("n")) & (F.col("n") >= F.col("index") * F.col("m"))).select("title", "description")


def close_pairs(titles: DataFrame, texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Titles (with asked and least) and descriptions whose score can reach the title's least: pairs of equal keys,
    of enough exam words, or of facts and enough long words. No pair that does reach it is left out."""
    equal = titles.select("title", F.col("description_key").alias("f_key")).join(texts, "f_key").select("title", "description")
    pairs = equal.unionByName(_by_exam_words(titles, texts)).unionByName(_by_long_words(titles, texts, groups))
    return pairs.distinct()


def fuzzy_description(titles: DataFrame, fees: DataFrame, k: int) -> DataFrame:
    """Rows of the fee schedule by similarity of their descriptions, the best 3 k of each title.

    Without a shared word a score is what facts give (modality, parts and contrast), as the text then gives 0.184 at
    most. So the first 3 k rows by the facts' score, which all titles with the same facts have in common, are ranked
    once for each combination of facts; these are few combinations of fixed words, however many rows there are. The
    last of them tells what another row must reach (else LEAST_DESCRIPTION), and only pairs that can reach it
    (close_pairs) are scored one by one.
    """
    n, texts = 3 * k, _texts(fees)
    order = ["cpt_code", "description", "work_rvu", "row"]
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n).drop("nth")
    few = first(fees.select("row", "cpt_code", "modifier", "description", "work_rvu", F.to_json("facts").alias("has")), "description")
    titles = titles.withColumn("asked", F.to_json("facts"))
    asked = titles.select("asked", "facts").dropDuplicates(["asked"])
    kinds = texts.select(F.to_json("f_facts").alias("has"), "f_facts").dropDuplicates(["has"])
    groups = cut(asked.crossJoin(kinds).select("asked", "has", T.facts_score(F.col("facts"), F.col("f_facts")).alias("given")))
    alike = groups.where(F.col("given") >= LEAST_DESCRIPTION).withColumnRenamed("given", "confidence").join(first(few, "has"), "has")
    best = Window.partitionBy("asked").orderBy(F.desc("confidence"), *order)
    alike = cut(alike.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= n))
    reached = alike.where(F.col("nth") == n).select("asked", F.col("confidence").alias("reached"))
    bounded = titles.join(reached, "asked", "left").withColumn("least", F.coalesce("reached", F.lit(LEAST_DESCRIPTION))).drop("reached")
    pairs = close_pairs(bounded, texts, groups).join(titles.drop("keys"), "title").join(texts, "description")
    exact = F.when(F.col("f_key") == F.col("description_key"), EXACT).otherwise(0.0)
    pairs = pairs.withColumn(
        "confidence",
        F.greatest(
            exact, T.radiology_score(F.col("radiology_title"), F.col("facts"), F.col("description"), F.col("f_facts")),
            T.combined_similarity(F.col("description_exam_key"), F.col("f_exam")) * FUZZY_TEXT,
        ),
    )
    near = pairs.where(F.col("confidence") >= LEAST_DESCRIPTION).select("title", "description", "confidence").join(few, "description")
    far = titles.select("title", "asked").join(alike.drop("nth"), "asked")
    columns = ["title", "row", "cpt_code", "modifier", "description", "work_rvu"]
    every = near.select(*columns, "confidence").unionByName(far.select(*columns, "confidence"))
    every = every.groupBy(*columns).agg(F.max("confidence").alias("confidence"))
    place = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("confidence"), *order))
    every = every.withColumn("place", place).where(F.col("place") <= n).withColumn("place", F.format_string("%06d", "place"))
    return _rows(every, 6, "fuzzy description", F.col("confidence"), "place")


def scored_descriptions(titles: DataFrame, fees: DataFrame) -> DataFrame:
    """Scores of typed titles, which are few, with all descriptions: radiology_score and text_score. The titles are
    dealt out to all parts of the descriptions."""
    texts = _texts(fees)
    parts = F.lit(max(1, texts.sparkSession.sparkContext.defaultParallelism)).cast("int")
    left = titles.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    both = left.join(texts.withColumn("part", F.pmod(F.xxhash64("description"), parts).cast("int")), "part")
    scored = both.withColumn(
        "radiology_score", T.radiology_score(F.col("radiology_title"), F.col("facts"), F.col("description"), F.col("f_facts"))
    ).withColumn("text_score", T.combined_similarity(F.col("description_exam_key"), F.col("f_exam")))
    return scored.drop("facts").join(fees.select("row", "cpt_code", "modifier", "description", "work_rvu"), "description")


def candidates(
    titles: DataFrame, cpt: DataFrame, aliases: DataFrame | None = None, entries: DataFrame | None = None, k: int = 5
) -> DataFrame:
    """Up to k candidates of each title: title, rank, code, modifier, description, work units, confidence, source.

    A title that is a code has only that. Later stages count while earlier ones gave fewer than k rows. Of
    equal codes the first stays; nothing is returned for a title whose best confidence is under 0.5. What is derived
    from titles and schedule is computed once, as all stages ask for it.
    """
    keys, fees = cut(title_keys(titles)), cut(fee_keys(cpt))
    stages = [direct(keys, fees), common(keys, fees), exact_description(keys, fees), fuzzy_description(keys, fees, k)]
    if aliases is not None:
        known = cut(alias_keys(aliases))
        stages += [exact_alias(keys, known, fees), fuzzy_alias(keys, known, fees, k)]
    if entries is not None:
        stages.append(dictionary(keys, entries, fees))
    every = stages[0]
    for stage in stages[1:]:
        every = every.unionByName(stage)
    order = Window.partitionBy("title").orderBy("stage")
    earlier = F.coalesce(F.count("*").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.min("stage").over(Window.partitionBy("title"))
    gated = every.withColumn("earlier", earlier).withColumn("starts", starts)
    gated = gated.where((F.col("earlier") < k) & ((F.col("starts") > 0) | (F.col("stage") == 0)))
    first = F.row_number().over(Window.partitionBy("title", "cpt_code", "modifier").orderBy("stage", "seq", "description", "work_rvu"))
    ranked = gated.withColumn("copy", first).where(F.col("copy") == 1)
    best = Window.partitionBy("title").orderBy(F.desc("confidence"), "stage", "seq", "cpt_code")
    ranked = ranked.withColumn("rank", F.row_number().over(best))
    ranked = ranked.withColumn("top", F.max("confidence").over(Window.partitionBy("title")))
    return ranked.where((F.col("top") >= LEAST_TOP) & (F.col("rank") <= k)).select(
        "title", "rank", "cpt_code", "modifier", "description", "work_rvu", "confidence", "source"
    )


def library_search(titles: DataFrame, cpt: DataFrame, k: int = 8) -> DataFrame:
    """Search of the fee schedule: fixed and exact mappings first, then a blend of three similarities.

    Rows of one description have the same confidence, so of each only the 2 * k that come first can be among a
    title's best; of the other stages, which take each code and modifier once, the first row of each. Titles meet
    these rows alone, however many rows a description has.
    """
    keys, fees = cut(title_keys(titles)), cut(fee_keys(cpt))
    few = Window.partitionBy("description").orderBy(F.desc("work_rvu"), "cpt_code")
    few = cut(fees.withColumn("place", F.row_number().over(few)).where(F.col("place") <= 2 * k).drop("place"))
    each = cut(fees.groupBy("cpt_code", "modifier", "description", "description_key").agg(F.min("work_rvu").alias("work_rvu")))
    scored = scored_descriptions(keys, few).withColumn("f_raw", T.normalize_exam_text(F.col("description")))
    raw = T.combined_similarity(F.col("exam_key"), F.col("f_raw"))
    many = F.size(F.split(F.trim("title"), r"\s+")) > 3
    blend = F.when(many, F.col("radiology_score") * 0.70 + raw * 0.15 + F.col("text_score") * 0.15).otherwise(
        F.col("radiology_score") * 0.40 + raw * 0.35 + F.col("text_score") * 0.25
    )
    exact = F.when(F.col("f_key") == F.col("description_key"), EXACT).otherwise(0.0)
    order = Window.partitionBy("title").orderBy(F.desc("confidence"), F.desc("work_rvu"), "cpt_code", "description")
    best = scored.withColumn("confidence", F.greatest(exact, blend)).where(F.col("confidence") >= LEAST_LIBRARY)
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * k)
    fuzzy = _rows(best.withColumn("place", F.format_string("%06d", "place")), 6, "fuzzy description", F.col("confidence"), "place")
    coded = direct(keys, each)
    others = common(keys, each).unionByName(exact_description(keys, each)).unionByName(fuzzy)
    every = coded.unionByName(others.join(coded.select("title").distinct(), "title", "left_anti"))
    first = F.row_number().over(Window.partitionBy("title", "cpt_code", "modifier").orderBy("stage", "seq", "description", "work_rvu"))
    place = F.row_number().over(Window.partitionBy("title").orderBy("stage", "seq", "cpt_code"))
    return (
        every.withColumn("copy", first).where(F.col("copy") == 1).withColumn("rank", place).where(F.col("rank") <= k)
        .select("title", "rank", "cpt_code", "modifier", "description", "work_rvu", "confidence", "source")
    )
