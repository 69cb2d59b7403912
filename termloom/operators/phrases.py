"""Phrases of result documents: n-grams, counts per query, and pruning inside clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ngrams(words: Column, low: int = 2, high: int = 4) -> Column:
    """All runs of low..high words of an array, joined by spaces."""
    def of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def lsi_phrases(texts: DataFrame, stop: tuple[str, ...] = (), least: int = 2, top: int = 10) -> DataFrame:
    """texts(id, text) to the `top` phrases of 2 to 4 words of each id that come `least` times or more: words of more
    than two letters that aren't in `stop`; by count, then alphabetically."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*stop) if stop else F.length(w) > 2)
    each = texts.select("id", words.alias("words")).select("id", F.explode(ngrams(F.col("words"))).alias("phrase"))
    counts = each.groupBy("id", "phrase").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("frequency"), "phrase"))
    return counts.withColumn("r", rank).where(F.col("r") <= top).drop("r")
