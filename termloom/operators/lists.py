"""Operators whose word or domain lists are inputs. A list is a DataFrame or a Python collection; a list table joins as a
broadcast only below LIST_ROWS rows, else by a shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has LIST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(LIST_ROWS + 1).count() <= LIST_ROWS else df


def tokens(keyword: Column) -> Column:
    return F.regexp_extract_all(F.lower(keyword), F.lit("[а-яёa-z]+"), F.lit(0))


def blocked_rows(rows: DataFrame, words: DataFrame, key: str = "row_id", keyword: str = "keyword") -> DataFrame:
    """The rows with a stop word of words(word) among their whole tokens, and the first one found."""
    each = rows.select(key, F.posexplode(tokens(F.col(keyword))).alias("at", "word"))
    hits = each.join(small(words.select("word").distinct()), "word").groupBy(key).agg(F.min_by("word", "at").alias("found"))
    return rows.join(hits, key)


def stop_word_filter(rows: DataFrame, words: DataFrame, key: str = "row_id", keyword: str = "keyword") -> DataFrame:
    """The rows without one."""
    return rows.join(blocked_rows(rows, words, key, keyword).select(key), key, "left_anti")


def low_frequency_filter(rows: DataFrame, least: int = 1) -> DataFrame:
    return rows.where(F.col("frequency_world") >= least)


def frequency_ratio_filter(rows: DataFrame, most: float = 51) -> DataFrame:
    return rows.where((F.col("frequency_exact") > 0) & (F.col("frequency_world") <= most * F.col("frequency_exact")))


def short_query_filter(rows: DataFrame, least: int = 2) -> DataFrame:
    return rows.where(F.char_length("keyword") >= least)


def stop_domain_filter(rows: DataFrame, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """The rows whose domain, with and without www, has no stop domain among itself and its parents."""
    parts = F.split("host", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    stop = small(domains.select(F.regexp_replace(F.lower("domain"), "^www[.]", "").alias("stop")).distinct())
    hosts = rows.select(F.col(domain).alias("_d")).distinct().withColumn("host", F.regexp_replace(F.lower("_d"), "^www[.]", ""))
    bad = hosts.select("_d", F.explode(parents).alias("stop")).join(stop, "stop", "left_semi").select("_d").distinct()
    return rows.join(bad, rows[domain] == bad["_d"], "left_anti")


def lemmatised(rows: DataFrame, lemmas: DataFrame, key: str = "row_id", keyword: str = "keyword") -> DataFrame:
    """(key, lemmas, normalized): the words of two characters or more by lemmas(form, lemma), unknown ones as they are, in
    order; and sorted, repeated ones kept."""
    each = rows.select(key, F.posexplode(F.filter(F.split(F.lower(F.trim(keyword)), r"\s+"), lambda w: F.char_length(w) > 1)).alias("at", "form"))
    one = small(lemmas.groupBy("form").agg(F.min("lemma").alias("lemma")))
    known = each.join(one, "form", "left").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("lemma", "form").alias("l")))).alias("w"))
    words = F.coalesce(F.transform("w", lambda x: x.l), F.array().cast("array<string>"))
    out = rows.select(key).join(known, key, "left")
    return out.select(key, F.array_join(words, " ").alias("lemmas"), F.array_join(F.array_sort(words), " ").alias("normalized"))


def expanded_stop_words(words: DataFrame, lemmas: DataFrame, least: int = 3) -> DataFrame:
    """words(word) and all forms of `least` letters or more that share a lemma with one of them."""
    pairs = small(lemmas.select("form", "lemma").distinct())
    stems = words.join(pairs, words.word == pairs.form).select("lemma").distinct()
    forms = pairs.join(stems, "lemma").where(F.char_length("form") >= least).select(F.col("form").alias("word"))
    return words.select("word").union(forms).distinct()


def city_names(rows: DataFrame, aliases: DataFrame, city: str = "city") -> DataFrame:
    """rows with `full`: the alias table's (short, full) name, compared in lower case, else the name with capitals."""
    short = small(aliases.select(F.lower("short").alias("_s"), F.col("full").alias("_f")).dropDuplicates(["_s"]))
    return rows.join(short, F.lower(F.trim(city)) == short["_s"], "left").withColumn("full", F.coalesce("_f", F.initcap(F.trim(city)))).drop("_s", "_f")


def domain_classes(domains: DataFrame, observed: DataFrame, commercial: DataFrame, informational: DataFrame, shared: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(domain, class, source): the first that knows it of observed(domain, class), the commercial list, the informational
    list, and shared(domain, class, confidence) from `least` confidence on; else unknown."""
    known = observed.select("domain", "class", F.lit(0).alias("rank"), F.lit("database").alias("source"))
    for rank, name, frame in ((1, "commercial", commercial), (2, "informational", informational)):
        known = known.unionByName(frame.select("domain", F.lit(name).alias("class"), F.lit(rank).alias("rank"), F.lit(f"{name}_file").alias("source")))
    if shared is not None:
        known = known.unionByName(shared.where(F.col("confidence") >= least).select("domain", "class", F.lit(3).alias("rank"), F.lit("global_cache").alias("source")))
    best = known.groupBy("domain").agg(F.min(F.struct("rank", "class", "source")).alias("k"))
    out = domains.select("domain").distinct().join(best, "domain", "left")
    return out.select("domain", F.coalesce("k.class", F.lit("unknown")).alias("class"), F.coalesce("k.source", F.lit("none")).alias("source"))


def domain_intent(serp: DataFrame, classes: DataFrame, top: int = 10, limit: float = 0.5) -> DataFrame:
    """(q, commercial, informational, intent, confidence) by the shares of classes(domain, class) among the first `top`
    results of a query."""
    rows = serp.select("q", "position", "domain").where((F.col("position") <= top) & (F.coalesce("domain", F.lit("")) != "")).join(classes.select("domain", "class"), "domain", "left")
    share = lambda name: F.round(F.avg(F.when(F.col("class") == name, 1.0).otherwise(0.0)), 3)
    out = rows.groupBy("q").agg(share("commercial").alias("commercial"), share("informational").alias("informational"))
    intent = F.when(F.col("commercial") >= limit, "commercial").when(F.col("informational") >= limit, "informational").otherwise("unknown")
    sure = F.when(F.col("commercial") >= limit, F.col("commercial")).when(F.col("informational") >= limit, F.col("informational")).otherwise(F.greatest("commercial", "informational"))
    return out.withColumn("intent", intent).withColumn("confidence", sure)


def majority_apart(members: DataFrame) -> DataFrame:
    """(q) of members(q, cluster, geo) that are incompatible with more than half of the others of their cluster: compatible
    means equal places, or none on both sides. By counts of places, so no pairs are made."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    same = members.groupBy("cluster", "geo").agg(F.count("*").alias("k")).withColumnRenamed("geo", "g").withColumnRenamed("cluster", "c")
    rows = members.join(sizes, "cluster").join(same, (F.col("cluster") == F.col("c")) & F.col("geo").eqNullSafe(F.col("g")))
    return rows.where((F.col("n") > 1) & ((F.col("n") - F.col("k")) / (F.col("n") - 1) > 0.5)).select("q")


def words_of(spark, words: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")
