"""Second passes over clusters of queries: splitting large ones and attaching single queries.

Both take serp(q, u) and members(q, cluster) and return (q, cluster), named anew by each cluster's least query. All
clusters are worked on together, by joins and aggregates; no task holds a cluster.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import shared_url_pairs
from .graph import checkpointed, components


def _named(members: DataFrame) -> DataFrame:
    """members with clusters named by their least query, and their sizes as n."""
    facts = members.groupBy("cluster").agg(F.min("q").alias("name"), F.count("*").alias("n"))
    return members.join(facts, "cluster").drop("cluster").withColumnRenamed("name", "cluster")


def _labels_at(large: DataFrame, inside: DataFrame, threshold: int) -> DataFrame:
    """large(q, cluster) with the part that links of the threshold inside the clusters put each query in, and its size."""
    linked = components(inside.where(F.col("common") >= threshold).select(F.col("q1").alias("src"), F.col("q2").alias("dst")))
    placed = large.join(linked.withColumnRenamed("node", "q"), "q", "left").select("q", "cluster", F.coalesce("component", "q").alias("part"))
    return placed.join(placed.groupBy("part").agg(F.count("*").alias("size")), "part").withColumn("threshold", F.lit(threshold))


def split_clusters(serp: DataFrame, members: DataFrame, cap: int = 100, base: int = 3, step: int = 1, most: int = 20) -> DataFrame:
    """Splits clusters of more than `cap` queries. Connected parts at every threshold from base + step to `most` shared
    URLs are found for all large clusters at once; each cluster takes the least threshold whose largest part has `cap`
    queries at most, and where none has, the last that improved on what was best before it: its largest part is smaller
    than the part of the least query at the threshold then held (the whole cluster at first). Parts that are still too
    large are cut into runs of `cap` by order of their queries."""
    named = checkpointed(_named(members.select("q", "cluster")))
    large = checkpointed(named.where(F.col("n") > cap).select("q", "cluster", "n"))
    if large.isEmpty():
        return named.select("q", "cluster")
    pairs = shared_url_pairs(serp.join(large, "q", "left_semi"), base + step)
    end = lambda k: large.select(F.col("q").alias(f"q{k}"), F.col("cluster").alias(f"c{k}"))
    inside = checkpointed(pairs.join(end(1), "q1").join(end(2), "q2").where("c1 = c2").select("q1", "q2", "common"))
    tried, left = None, large.select("q", "cluster")
    for threshold in range(base + step, most + 1, step):
        labels = checkpointed(_labels_at(left, inside.join(left.select(F.col("q").alias("q1")), "q1", "left_semi"), threshold))
        tried = labels if tried is None else tried.unionByName(labels)
        fits = labels.groupBy("cluster").agg(F.max("size").alias("largest"), F.countDistinct("part").alias("parts")).where((F.col("largest") <= cap) & (F.col("parts") > 1))
        left = checkpointed(left.join(fits, "cluster", "left_anti").select("q", "cluster"))
        if left.isEmpty():
            break
    whole = large.select(F.col("cluster").alias("part"), "q", "cluster", F.col("n").alias("size"), F.lit(base).alias("threshold"))
    tried = checkpointed(whole if tried is None else whole.unionByName(tried))
    # By cluster and threshold: the largest part, and the part that the cluster's least query is in.
    facts = tried.groupBy("cluster", "threshold").agg(F.max("size").alias("largest"), F.max(F.when(F.col("q") == F.col("cluster"), F.col("size"))).alias("first"), F.countDistinct("part").alias("parts"))
    steps = F.sort_array(F.collect_list(F.struct("threshold", "largest", "first", "parts")))
    start = F.struct(F.lit(base).alias("held"), F.lit(1 << 40).alias("bound"), F.lit(False).alias("done"))

    def choose(acc, s):
        fits = (s.largest <= cap) & (s.parts > 1)
        better = ~acc.done & (fits | (s.largest < acc.bound))
        return F.struct(F.when(better, s.threshold).otherwise(acc.held).alias("held"), F.when(better, s["first"]).otherwise(acc.bound).alias("bound"), (acc.done | fits).alias("done"))

    chosen = facts.groupBy("cluster").agg(steps.alias("s")).select(F.col("cluster").alias("of"), F.aggregate("s", start, choose).held.alias("held"))
    parts = tried.join(chosen, (F.col("cluster") == F.col("of")) & (F.col("threshold") == F.col("held"))).select("q", "part")
    run = F.floor((F.row_number().over(Window.partitionBy("part").orderBy("q")) - 1) / cap)
    pieces = parts.withColumn("run", run)
    named_pieces = pieces.groupBy("part", "run").agg(F.min("q").alias("cluster"))
    return named.where(F.col("n") <= cap).select("q", "cluster").unionByName(pieces.join(named_pieces, ["part", "run"]).select("q", "cluster"))


def _offers(singles: DataFrame, people: DataFrame, pairs: DataFrame, cap: int, compared: int) -> DataFrame:
    """(single, into, common): what each open single query may join: clusters of its place that aren't full, by the first
    of their `compared` oldest members that it has a link with. A single may join an earlier single."""
    inside = people.withColumn("size", F.count("*").over(Window.partitionBy("cluster"))).withColumn("at", F.row_number().over(Window.partitionBy("cluster").orderBy("since", "q")))
    open_ = inside.where((F.col("size") < cap) & (F.col("at") <= compared)).select(F.col("q").alias("other"), F.col("cluster").alias("into"), F.col("place").alias("geo2"), "at", "size")
    both = pairs.select(F.col("q1").alias("single"), F.col("q2").alias("other"), "common").unionByName(pairs.select(F.col("q2").alias("single"), F.col("q1").alias("other"), "common"))
    met = both.join(singles.select(F.col("q").alias("single"), F.col("geo").alias("geo1")), "single").join(open_, "other").where(F.col("geo1").eqNullSafe(F.col("geo2")) & ((F.col("size") > 1) | (F.col("into") < F.col("single"))))
    return met.groupBy("single", "into").agg(F.min_by("common", "at").alias("common"))


def reattach_singletons(serp: DataFrame, members: DataFrame, base: int = 3, cap: int = 100, compared: int = 15) -> DataFrame:
    """Single queries join the cluster that is not full, has the same place (column geo of members, if there is one) as its
    first query, and whose first of `compared` members with `base` URLs in common shares the most; of equals the least.

    Singles are placed in rounds. A single waits while a lesser one is open that wants one of the same clusters or is itself
    what it could join; one without anything to join stays alone for good. So every placement sees what all lesser
    singles did before, as if they had come in order of their numbers. The least open single never waits, so every round
    places one at least, and unrelated ones at once."""
    geo = F.coalesce(F.col("geo").cast("string"), F.lit("")) if "geo" in members.columns else F.lit("")
    named = checkpointed(_named(members.select("q", "cluster", geo.alias("geo"))))
    pairs = checkpointed(shared_url_pairs(serp.join(named, "q", "left_semi"), base))
    firsts = named.where("q = cluster").select("cluster", F.col("geo").alias("place"))
    people = checkpointed(named.join(firsts, "cluster").select("q", "cluster", "place", F.lit(0).alias("since")))
    waiting = checkpointed(named.where("n = 1").select("q", "geo"))
    for now in itertools.count(1):
        offers = checkpointed(_offers(waiting, people, pairs, cap, compared))
        if offers.isEmpty():
            break
        # A single waits for the lesser open singles that could join, or be, a cluster it has an offer from.
        touched = offers.select("single", "into").unionByName(offers.select("single", F.col("single").alias("into"))).distinct()
        first = touched.groupBy("into").agg(F.min("single").alias("least"))
        free = touched.join(first, "into").groupBy("single").agg(F.max(F.col("least") < F.col("single")).alias("waits")).where("not waits").select("single")
        best = offers.join(free, "single").groupBy("single").agg(F.min(F.struct((-F.col("common")).alias("c"), "into")).alias("b")).select(F.col("single").alias("q"), F.col("b.into").alias("into"))
        moved = checkpointed(best)
        people = checkpointed(people.join(moved, "q", "left").select("q", F.coalesce("into", "cluster").alias("cluster"), "place", F.when(F.col("into").isNotNull(), now).otherwise(F.col("since")).alias("since")))
        waiting = checkpointed(waiting.join(offers.select(F.col("single").alias("q")).distinct(), "q", "left_semi").join(moved, "q", "left_anti"))
    least = people.groupBy("cluster").agg(F.min("q").alias("name"))
    return people.join(least, "cluster").select("q", F.col("name").alias("cluster"))
