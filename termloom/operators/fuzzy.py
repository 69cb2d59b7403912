"""Fuzzy duplicates of keywords: a similarity self-join behind a gram index, and the greedy choice of leaders in rounds."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed


def _grams(texts: DataFrame, q: int) -> DataFrame:
    """(id, n, gram) of texts(id, text, n): the text's pieces of q characters, each with its number among equal ones, so that
    a piece that comes twice is two elements."""
    pieces = F.expr(f"sort_array(transform(sequence(1, n - {q - 1}), i -> substring(text, i, {q})))")
    rows = texts.where(F.col("n") >= q).select("id", "n", pieces.alias("g"))
    return rows.select("id", "n", F.explode(F.expr("transform(g, (x, i) -> concat(x, cast(i - array_position(g, x) + 1 as string)))")).alias("gram"))


def _partner_lengths(threshold: float) -> str:
    """SQL array of the lengths from n up that a text of n characters can be similar to: 2 * n >= threshold * (n + m)."""
    return f"sequence(n, greatest(n, int(floor(n * (2 - {threshold}D) / {threshold}D + 1e-9))))"


def similar_texts(texts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(a, b, ratio) of texts(id, text), id unique: pairs a < b whose difflib ratio (twice the characters in matching blocks, over
    both lengths; the text of `a` first) is `threshold` or more. Empty texts are similar to each other alone. Null texts to none.

    Matching characters are at most the longest common subsequence, so similar texts of n and m characters share one of
    c >= threshold * (n + m) / 2. Of the first one's n - q + 1 pieces of q characters, each of its n - c other characters spoils q
    at most, and each of the second one's m - c other characters q - 1 at most. What is left is common to both: at least
    (n + m) * ((2 * q - 1) * threshold / 2 - (q - 1)) - (q - 1) pieces, where m is at least n * threshold / (2 - threshold).
    Two texts hence have one in common among the first of each in the order of the least frequent (all but that number, and
    one); with the exact lengths that is the join's key, which cuts a frequent piece up. Texts for which the number isn't
    positive meet by their lengths alone. Raises ValueError below 0.8, where most would.
    """
    if not 0.8 <= threshold <= 1:
        raise ValueError("threshold is from 0.8 to 1")
    q = 3 if threshold >= 0.9 else 2
    rows = texts.where(F.col("text").isNotNull()).select("id", "text", F.char_length("text").cast("int").alias("n"))
    rows = checkpointed(rows)
    overlap = F.ceil(F.col("n") * F.lit(2 / (2 - threshold) * ((2 * q - 1) * threshold / 2 - (q - 1))) - (q - 1) - 1e-9)
    grams = checkpointed(_grams(rows, q))
    often = grams.groupBy("gram").agg(F.count("*").alias("f"))
    ranked = grams.join(often, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("f", "gram"))).alias("g"))
    first = F.slice("g", 1, F.greatest(F.lit(0), F.least(F.size("g"), F.size("g") - F.greatest(overlap, F.lit(1)).cast("int") + 1)))
    keys = ranked.select("id", "n", F.explode(F.transform(first, lambda x: x.gram)).alias("key"))
    short = rows.where((overlap < 1) | (F.col("n") < q)).select("id", "n", F.lit("").alias("key"))
    keys = checkpointed(keys.unionByName(short))
    shorter = keys.select(F.col("id").alias("x"), "n", "key", F.explode(F.expr(_partner_lengths(threshold))).alias("m"))
    longer = keys.select(F.col("id").alias("y"), F.col("n").alias("m"), "key")
    pairs = shorter.join(longer, ["key", "m"]).where((F.col("n") < F.col("m")) | (F.col("x") < F.col("y")))
    pairs = checkpointed(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    one, two = (rows.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, b, x, y in batch.itertuples(index=False):
                match = difflib.SequenceMatcher(None, x, y)
                if match.quick_ratio() >= threshold and (r := match.ratio()) >= threshold:
                    found.append((a, b, r))
            yield pd.DataFrame(found, columns=["a", "b", "ratio"]).astype({"a": "int64", "b": "int64", "ratio": "float64"})

    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInPandas(ratios, "a long, b long, ratio double")


def leaders(pairs: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, leader) of pairs(a, b), a < b: in the order of the nodes each one that no earlier leader is paired with leads, and
    the others follow the first leader that they are paired with. Only nodes with a pair come back.

    In a round every node all of whose earlier partners follow others leads, and what is paired with a leader follows; both
    leave with their pairs. Raises RuntimeError if that isn't over after `rounds` rounds."""
    left = checkpointed(pairs.select("a", "b").where("a < b").distinct())
    everyone = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    followers = [everyone.limit(0)]
    undecided = left
    for _ in range(rounds):
        if undecided.isEmpty():
            follow = everyone.limit(0)
            for part in followers[1:]:
                follow = follow.unionByName(part)
            lead = everyone.join(checkpointed(follow), "node", "left_anti")
            first = left.join(lead.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("first"))
            first = first.join(lead, "node", "left_anti")
            return checkpointed(everyone.join(first, "node", "left").select("node", F.coalesce("first", "node").alias("leader")))
        waiting = undecided.select(F.col("b").alias("a")).distinct()
        new = checkpointed(undecided.select("a").distinct().join(waiting, "a", "left_anti"))
        gone = checkpointed(undecided.join(new, "a", "left_semi").select(F.col("b").alias("node")).distinct())
        followers.append(gone)
        over = gone.unionByName(new.withColumnRenamed("a", "node"))
        undecided = checkpointed(undecided.join(over.withColumnRenamed("node", "a"), "a", "left_anti").join(over.withColumnRenamed("node", "b"), "b", "left_anti"))
    raise RuntimeError(f"leaders not settled after {rounds} rounds")


def merge_similar(rows: DataFrame, threshold: float = 0.9, key: str = "row_id", keyword: str = "keyword", weight: str | None = "frequency_exact") -> DataFrame:
    """(key, leader, kept) for every row: in the order of the keywords (then keys) a row joins the first leader whose
    lower-cased keyword is similar to its own, else it leads. Of a group the row with the greatest weight is kept, of equal ones
    and without a weight the first in that order; null weights come last. Keys are unique integers. Null keywords lead
    themselves and come last.

    Equal keywords are one text, whose place is that of its first row: what is similar to that row is similar to all of them."""
    value = F.col(weight).cast("double") if weight else F.lit(0.0)
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(keyword).alias("keyword"), F.lower(keyword).alias("text"), value.alias("weight"))
    own = checkpointed(own)
    firsts = own.where(F.col("text").isNotNull()).groupBy("text").agg(F.min(F.struct("keyword", "key")).alias("first"))
    # Places by sorting: a range-partitioned sort, and a number for each place that keeps its order.
    ordered = checkpointed(firsts.orderBy("first.keyword", "first.key").select("text", F.col("first.key").alias("key"), F.monotonically_increasing_id().alias("id")))
    found = leaders(similar_texts(ordered.select("id", "text"), threshold)).select(F.col("node").alias("id"), F.col("leader").alias("lead"))
    names = ordered.select(F.col("id").alias("lead"), F.col("key").alias("leader"))
    groups = ordered.join(found, "id", "left").withColumn("lead", F.coalesce("lead", "id")).join(names, "lead").select("text", "leader")
    out = own.join(groups, "text", "left").withColumn("leader", F.coalesce("leader", "key"))
    best = out.groupBy("leader").agg(F.max(F.struct(F.coalesce("weight", F.lit(float("-inf"))).alias("w"))).alias("m"))
    tied = out.join(best, "leader").where(F.coalesce("weight", F.lit(float("-inf"))) == F.col("m.w")).groupBy("leader").agg(F.min(F.struct("keyword", "key")).alias("k"))
    return out.join(tied.select("leader", F.col("k.key").alias("stays")), "leader").select(F.col("key").alias(key), "leader", (F.col("key") == F.col("stays")).alias("kept"))
