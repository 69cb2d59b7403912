"""Greedy clusters that are decided in an order, as rounds of bounded groups.

A rule that takes queries one after the other, and asks only about links to queries before, is the same within each connected
part of the links. Parts go side by side; a part's queries go in rounds of BATCH in their order. In a round a group has the
part's next queries, the links among them, and for each of them the clusters of earlier rounds that still come into question,
with how often it is linked there: all that the rule asks for. So a task holds BATCH queries at most, however large a part is,
and the number of rounds is that of the largest part's batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, components

BATCH = 4000


def ranked_in_parts(order: DataFrame, parts: DataFrame) -> DataFrame:
    """(q, part, place, rank): order(q, weight) by weight, greatest first and null last, then q; place is a number in that order over
    all, rank from 0 within parts(node, component). Ranks come from counts by part and range of the sort, so no task sorts a part."""
    placed = checkpointed(order.join(parts.select(F.col("node").alias("q"), F.col("component").alias("part")), "q").orderBy(F.desc_nulls_last("weight"), "q").select("q", "part", F.monotonically_increasing_id().alias("place")))
    piece = placed.withColumn("piece", F.shiftright("place", 33))
    counts = piece.groupBy("part", "piece").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("piece")) - F.col("n")).drop("n")
    inside = piece.withColumn("at", F.row_number().over(Window.partitionBy("part", "piece").orderBy("place")) - 1)
    return checkpointed(inside.join(before, ["part", "piece"]).select("q", "part", "place", (F.col("at") + F.col("before")).alias("rank")))


def in_rounds(ranked: DataFrame, pairs: DataFrame, rule: Callable[[pd.DataFrame], pd.DataFrame], cap: int) -> DataFrame:
    """(q, cluster) of ranked(q, part, place, rank) by the rule. pairs(q1, q2) are the links. The rule gets a group's rows (kind, q,
    place, other, size) in order: kind 0 a query; 1 its link with an earlier query `other` of the group; 2 an earlier round's cluster
    `other` of which all `size` members are linked with it; and returns (q, cluster), a cluster named by its first query's place."""
    most = ranked.agg(F.max("rank")).first()[0]
    links = pairs.select(F.col("q1").alias("a"), F.col("q2").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one, two = (ranked.select(F.col("q").alias(k), F.col("place").alias(f"p_{k}"), F.col("rank").alias(f"r_{k}")) for k in "ab")
    earlier = checkpointed(links.join(one, "a").join(two, "b").where("p_b < p_a").select("a", "b", "p_b", "r_a", "r_b"))
    done, schema = None, "kind int, q long, place long, other long, size long"
    for start in range(0, (most if most is not None else -1) + 1, BATCH):
        now = ranked.where((F.col("rank") >= start) & (F.col("rank") < start + BATCH)).select("part", "q", "place")
        mine = earlier.where((F.col("r_a") >= start) & (F.col("r_a") < start + BATCH))
        none = F.lit(0).cast("long")
        rows = now.select("part", F.lit(0).alias("kind"), "q", "place", none.alias("other"), none.alias("size"))
        inner = mine.where(F.col("r_b") >= start).select(F.col("a").alias("q"), F.col("p_b").alias("other"))
        rows = rows.unionByName(inner.join(now, "q").select("part", F.lit(1).alias("kind"), "q", "place", "other", none.alias("size")))
        if done is not None:
            sizes = done.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") < cap)
            linked = mine.where(F.col("r_b") < start).select(F.col("a").alias("q"), "b").join(done.withColumnRenamed("q", "b"), "b").groupBy("q", "cluster").agg(F.count("*").alias("n"))
            whole = linked.join(sizes, "cluster").where("n = size").select("q", F.col("cluster").alias("other"), "size")
            rows = rows.unionByName(whole.join(now, "q").select("part", F.lit(2).alias("kind"), "q", "place", "other", "size"))
        found = rows.groupBy("part").applyInPandas(lambda group: rule(group.sort_values(["place", "kind", "other"])[[c.split()[0] for c in schema.split(", ")]]), "q long, cluster long")
        found = checkpointed(found)
        done = found if done is None else checkpointed(done.unionByName(found))
    return done if done is not None else ranked.select("q", F.col("place").alias("cluster"))


def _first_that_accepts(cap: int):
    """A query joins the first cluster, by its first query's place, that isn't full and whose members are all linked with it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cluster_of: dict[int, int] = {}  # by place, of this round's queries
        joined: dict[int, list[int]] = {}  # cluster to places of this round
        sizes: dict[int, int] = {}
        names, out = {}, []
        kinds = group.kind.to_numpy()
        starts = [k for k in range(len(group)) if kinds[k] == 0]
        columns = list(zip(*(group[c].to_numpy() for c in ("kind", "q", "place", "other", "size")), strict=True))
        for start, end in zip(starts, [*starts[1:], len(group)], strict=True):
            q, place = int(columns[start][1]), int(columns[start][2])
            near = {int(r[3]) for r in columns[start + 1 : end] if r[0] == 1}
            known = {int(r[3]): int(r[4]) for r in columns[start + 1 : end] if r[0] == 2}
            for c in sorted({cluster_of[p] for p in near} | known.keys()):
                new = joined.get(c, [])
                # a cluster of earlier rounds must be linked whole; one that this round founded has new members alone
                if (c in known or c in cluster_of) and known.get(c, 0) + len(new) < cap and all(p in near for p in new):
                    break
            else:
                c = place
            cluster_of[place] = c
            joined.setdefault(c, []).append(place)
            names[place] = q
            out.append((q, c))
        return pd.DataFrame(out, columns=["q", "cluster"]).astype("int64")

    return run


def full_link_clusters(pairs: DataFrame, order: DataFrame, cap: int = 100, places: DataFrame | None = None) -> DataFrame:
    """(q, cluster) of order(q, weight): by weight, greatest first and null last, then q, each query joins the first cluster (the one
    founded first) that has fewer than `cap` members and is linked with it in every one by pairs(q1, q2); else it founds one. A
    cluster is named by the query that founded it. places(q, geo) keeps queries of unlike places apart; equal ones, or none on
    both sides, go together. Queries without a link are their own clusters; q is unique in order, and pairs with others are dropped.
    """
    order = order.select(F.col("q").cast("long").alias("q"), F.col("weight").cast("double").alias("weight"))
    pairs = pairs.select("q1", "q2").where("q1 <> q2").select(F.least("q1", "q2").alias("q1"), F.greatest("q1", "q2").alias("q2")).distinct()
    if places is not None:
        end = lambda k: places.select(F.col("q").alias(f"q{k}"), F.col("geo").alias(f"geo{k}"))
        pairs = pairs.join(end(1), "q1", "left").join(end(2), "q2", "left").where(F.col("geo1").eqNullSafe(F.col("geo2"))).select("q1", "q2")
    known = order.select("q").distinct()
    pairs = checkpointed(pairs.join(known.withColumnRenamed("q", "q1"), "q1").join(known.withColumnRenamed("q", "q2"), "q2"))
    ranked = ranked_in_parts(order, components(pairs.select(F.col("q1").alias("src"), F.col("q2").alias("dst"))))
    placed = in_rounds(ranked, pairs, _first_that_accepts(cap), cap)
    names = ranked.select(F.col("place").alias("cluster"), F.col("q").alias("name"))
    named = placed.join(names, "cluster").select("q", F.col("name").alias("cluster"))
    return order.select("q").join(named, "q", "left").select("q", F.coalesce("cluster", "q").alias("cluster"))
