"""Brands: rules on single words, brands of queries, and words that a list of queries shows to be brands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lists import small

# The patterns and confidences of the word rules, in the order in which they are asked.
LATIN_CAPITAL, LATIN_LOWER, CYRILLIC_CAPITAL = r"^[A-Z][a-zA-Z0-9\-]+$", r"^[a-z]+[a-z0-9\-]*$", r"^[А-ЯЁ][а-яё]+$"
CAMEL, CAMEL_I = r"^[A-Z][a-z]+[A-Z]", r"^i[A-Z][a-z]+"
MODEL, CAPITAL_INSIDE = r"^[A-ZА-ЯЁ][a-zA-Zа-яёЁ]*[\-\d]+", r"[а-яё][А-ЯЁ]"
VOWELS = "аеёиоуыэюя"


def word_rule(word: Column, word_known: Column, lemma_known: Column, name: Column) -> Column:
    """struct(reason, confidence) of a word as it is spelled, or null: word_known and lemma_known say whether it or its lemma is a place
    or a common word, name whether morphology takes it for a first name or surname."""
    size = F.char_length(word)
    rules = (
        (word.rlike(LATIN_CAPITAL), "latin_capitalized", 0.9),
        (word.rlike(LATIN_LOWER) & (size >= 4), "latin_lowercase", 0.75),
        (word.rlike(CAMEL) | word.rlike(CAMEL_I), "camel_case", 0.85),
        (word.rlike(CYRILLIC_CAPITAL) & (size >= 4) & ~lemma_known, "cyrillic_capitalized", 0.7),
        (name, "morph_name", 0.7),
        (word.rlike("[a-zA-Z]") & word.rlike("[а-яА-ЯёЁ]"), "mixed_script", 0.6),
        (word.rlike(CAPITAL_INSIDE), "capitals_inside", 0.65),
        (word.rlike(MODEL), "model_number", 0.75),
    )
    out = F.when((size < 2) | word_known, F.lit(None).cast("struct<reason:string,confidence:double>"))
    for test, reason, confidence in rules:
        out = out.when(test, F.struct(F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence")))
    return out


def brand_words(rows: DataFrame, places: DataFrame, common: DataFrame, morphology: DataFrame | None = None, key: str = "row_id", keyword: str = "keyword") -> DataFrame:
    """(key, at, word, reason, confidence): the words of every keyword, split at white space, that a rule takes for a brand.

    places(word) and common(word) are never brands. morphology(form, lemma, name) gives a lower-cased form's lemma and whether it is a first
    name or surname; a form without an entry is its own lemma and no name. Lists join; a list is broadcast only if it is small."""
    each = rows.select(F.col(key).alias("key"), F.posexplode(F.filter(F.split(F.trim(F.col(keyword)), r"\s+"), lambda w: w != "")).alias("at", "word")).withColumn("low", F.lower("word"))
    known = small(places.select(F.lower("word").alias("w")).union(common.select(F.lower("word"))).distinct().withColumn("known", F.lit(True)))
    if morphology is not None:
        forms = small(morphology.groupBy(F.col("form").alias("low")).agg(F.min("lemma").alias("lemma"), F.max("name").alias("name")))
        each = each.join(forms, "low", "left")
    else:
        each = each.withColumn("lemma", F.lit(None).cast("string")).withColumn("name", F.lit(False))
    each = each.join(known.select(F.col("w").alias("low"), "known"), "low", "left")
    each = each.withColumn("lemma", F.coalesce("lemma", "low")).join(known.select(F.col("w").alias("lemma"), F.col("known").alias("lemma_known")), "lemma", "left")
    no = F.lit(False)
    ruled = each.withColumn("r", word_rule(F.col("word"), F.coalesce("known", no), F.coalesce("lemma_known", no), F.coalesce("name", no)))
    return ruled.where(F.col("r").isNotNull()).select(F.col("key").alias(key), "at", "word", "r.reason", "r.confidence")


def query_brands(rows: DataFrame, words: DataFrame, organisations: DataFrame | None = None, key: str = "row_id", least: float = 0.7) -> DataFrame:
    """(key, brand, confidence, n, is_brand_query) of every row, from words, the result of brand_words: the first brand, the greatest
    confidence (0 without one), how many there are, and whether the confidence is `least` or more.

    organisations(key, org) are names that a recogniser found, in lower case: a brand that holds one or is part of one gains 0.2, 1 at most; a
    name that is no brand word counts as a brand of 0.6 after the others."""
    found = words.select(key, F.col("at").cast("long").alias("at"), F.col("word").alias("brand"), "confidence")
    if organisations is not None:
        orgs = organisations.select(key, F.lower("org").alias("org")).distinct()
        near = found.join(orgs, key).where(F.col("org").contains(F.lower("brand")) | F.lower("brand").contains(F.col("org"))).select(key, "at").distinct().withColumn("sure", F.lit(True))
        extra = orgs.join(found.select(key, F.lower("brand").alias("org")), [key, "org"], "left_anti")
        found = found.join(near, [key, "at"], "left").withColumn("confidence", F.when(F.col("sure"), F.least(F.lit(1.0), F.round(F.col("confidence") + 0.2, 10))).otherwise(F.col("confidence"))).drop("sure")
        found = found.unionByName(extra.select(key, F.lit(1 << 40).cast("long").alias("at"), F.col("org").alias("brand"), F.lit(0.6).alias("confidence")))
    facts = found.groupBy(key).agg(F.min_by("brand", F.struct("at", "brand")).alias("brand"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    out = rows.select(key).join(facts, key, "left").na.fill(0, ["n"]).na.fill(0.0, ["confidence"])
    return out.select(key, "brand", "confidence", "n", (F.col("confidence") >= least).alias("is_brand_query"))


def learn_brands(rows: DataFrame, common: DataFrame, morphology: DataFrame | None = None, keyword: str = "keyword", topic_share: float = 0.5, least_acronym: int = 3, least_often: int = 5, least_contexts: int = 3) -> DataFrame:
    """(word, brand, rule, n) of words that the keywords show to be brands; brand is the most frequent spelling, of equals the least.

    Of words of three characters or more are counted: occurrences, those with a capital first, spellings, and different neighbours. A word with
    occurrences of `topic_share` of the rows or more is a topic. The first rule that fits decides: 'latin' for a word of Latin letters,
    digits and hyphens that isn't a number; 'acronym' for one of up to five characters with one vowel at most, found at least
    max(least_acronym, 5) times in three spellings at most; 'contexts' for one with `least_contexts` neighbours, `least_often` occurrences,
    a capital somewhere and four spellings at most. The latter two leave out common(word) and words whose lemma by morphology(form, lemma)
    is common or a topic. It is one pass of counts; words meet lists by joins. Null keywords count as rows without words."""
    n_rows = rows.count()
    words = rows.select(F.filter(F.split(F.trim(F.col(keyword)), r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    each = words.select("w", F.posexplode("w").alias("at", "form")).where(F.char_length("form") > 2)
    near = F.array(F.expr("try_element_at(w, if(at = 0, size(w) + 1, at))"), F.expr("try_element_at(w, at + 2)"))
    each = each.select(F.lower("form").alias("word"), "form", F.transform(near, lambda x: F.lower(x)).alias("near"))
    spelled = each.groupBy("word", "form").agg(F.count("*").alias("k"))
    first = F.substring("form", 1, 1)
    counts = spelled.groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("spellings"), F.sum(F.when((first == F.upper(first)) & (first != F.lower(first)), F.col("k")).otherwise(0)).alias("capitals"), F.min_by("form", F.struct(-F.col("k"), "form")).alias("brand"))
    contexts = each.select("word", F.explode("near").alias("other")).where("other is not null").groupBy("word").agg(F.countDistinct("other").alias("contexts"))
    facts = counts.join(contexts, "word", "left").na.fill(0, ["contexts"])
    topics = facts.where(F.col("n") >= topic_share * n_rows).select("word")
    known = small(common.select(F.lower("word").alias("word")).distinct())
    barred = known.union(topics)
    if morphology is not None:
        lemmas = morphology.groupBy(F.col("form").alias("word")).agg(F.min("lemma").alias("lemma"))
        inflected = lemmas.join(barred.select(F.col("word").alias("lemma")).distinct(), "lemma").select("word")
        plain = known.union(inflected).distinct()
    else:
        plain = known
    marked = facts.join(topics, "word", "left_anti").join(plain.withColumn("plain", F.lit(True)), "word", "left").withColumn("plain", F.coalesce("plain", F.lit(False)))
    size, vowels = F.char_length("word"), F.char_length("word") - F.char_length(F.translate("word", VOWELS, ""))
    latin, acronym = F.col("word").rlike(r"^[a-z0-9\-]+$"), (size <= 5) & (vowels <= 1) & (F.col("n") >= least_acronym)
    rule = (
        F.when(latin, F.when(~F.col("word").rlike("^[0-9]+$"), "latin"))
        .when(acronym, F.when(~F.col("plain") & (F.col("spellings") <= 3) & (F.col("n") >= 5), "acronym"))
        .when((F.col("contexts") >= least_contexts) & (F.col("n") >= least_often) & (F.col("capitals") > 0) & (F.col("spellings") <= 4) & ~F.col("plain"), "contexts")
    )
    return marked.withColumn("rule", rule).where("rule is not null").select("word", "brand", "rule", "n")
