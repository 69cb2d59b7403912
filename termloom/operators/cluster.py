"""Clustering of queries by the result URLs that they share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, components


def _met(serp: DataFrame, threshold: int, apart: Column | None = None) -> DataFrame:
    """(q1, q2, common, n1, n2) for the pairs q1 < q2 with at least `threshold` (1 or more) URLs in common; n1 and n2 are their numbers of
    URLs. apart is an expression of q: only queries that it gives the same value meet.

    Exact prefix filter: of two queries that share `threshold` URLs, one is among the first size - threshold + 1 of each in the order of
    the least frequent, so queries meet on these alone. A URL that very many queries show comes last and is met on only where a
    query has fewer than `threshold` others. Lists travel with the queries to each URL that they meet on, and a pair counts at the first URL
    that both have, so what is shuffled grows with the lists and not with the pairs that meet, and no pair is grouped again."""
    rows = serp.select("q", "u").where("q is not null and u is not null").distinct()
    often = rows.groupBy("u").agg(F.count("*").alias("f"))
    ordered = rows.join(often, "u").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("f", "u"))).alias("w"))
    ordered = ordered.where(F.size("w") >= threshold).select("q", F.transform("w", lambda x: x.u).alias("urls"), F.transform(F.filter(F.slice("w", 1, F.size("w") - threshold + 1), lambda x: x.f > 1), lambda x: x.u).alias("first"))
    keys = checkpointed(ordered).select("q", "urls", F.explode("first").alias("u"))
    keys, by = (keys, ["u"]) if apart is None else (keys.withColumn("apart", apart), ["u", "apart"])
    one, two = (keys.select(F.col("q").alias(f"q{k}"), F.col("urls").alias(f"urls{k}"), *by) for k in (1, 2))
    both = one.hint("merge").join(two, by).where("q1 < q2")
    # As a generator, the intersection is made once a pair; its order is that of the lists.
    common = F.filter(F.array(F.array_intersect("urls1", "urls2")), lambda c: (F.size(c) >= threshold) & (F.get(c, F.lit(0)) == F.col("u")))
    return both.select("q1", "q2", F.size("urls1").alias("n1"), F.size("urls2").alias("n2"), F.explode(F.transform(common, lambda c: F.size(c).cast("long"))).alias("common"))


def shared_url_pairs(serp: DataFrame, threshold: int, apart: Column | None = None) -> DataFrame:
    """serp(q, u) to (q1, q2, common) for pairs with at least `threshold` URLs in common, one if that is less; apart as for `_met`."""
    return _met(serp, max(threshold, 1), apart).select("q1", "q2", "common")


def jaccard_pairs(serp: DataFrame) -> DataFrame:
    """serp(q, u) to (q1, q2, jaccard) for pairs with a URL in common: their common URLs over all of both."""
    return _met(serp, 1).select("q1", "q2", (F.col("common") * 1.0 / (F.col("n1") + F.col("n2") - F.col("common"))).alias("jaccard"))


def soft_clusters(serp: DataFrame, threshold: int = 7) -> DataFrame:
    """(q, cluster): connected parts at `threshold` common URLs; a query without a partner is its own cluster."""
    linked = components(shared_url_pairs(serp, threshold).select(F.col("q1").alias("src"), F.col("q2").alias("dst")))
    return serp.select("q").distinct().join(linked.withColumnRenamed("node", "q"), "q", "left").select("q", F.coalesce("component", "q").alias("cluster"))


def _greedy(low: int, high: int, cap: int):
    """Clusters of one component. Thresholds fall from high to low; in each round the pairs of queries not yet placed
    are taken by overlap, then by ids. Two free queries found a cluster; a free one joins its partner's if it shares the
    threshold with every member there. Where the members are two that share twice the threshold, it must share twice
    the threshold with both. Clusters of earlier rounds stay shut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        common = {}
        for a, b, n in zip(pdf.q1, pdf.q2, pdf.common, strict=True):
            common[a, b] = common[b, a] = int(n)
        pairs = sorted(((n, a, b) for (a, b), n in common.items() if a < b), key=lambda p: (-p[0], p[1], p[2]))
        place: dict = {}
        for threshold in range(high, low - 1, -1):
            members: dict = {}
            closed = set(place)
            for n, a, b in pairs:
                if n < threshold:
                    break
                if a in closed or b in closed or (a in place and b in place):
                    continue
                if a not in place and b not in place:
                    place[a] = place[b] = min(a, b)
                    members[min(a, b)] = [a, b]
                    continue
                new, old = (b, a) if a in place else (a, b)
                inside = members[place[old]]
                if len(inside) >= cap:
                    continue
                strong = len(inside) == 2 and common.get(tuple(inside), 0) >= 2 * threshold
                if min(common.get((new, m), 0) for m in inside) >= threshold * (1 + strong):
                    inside.append(new)
                    place[new] = place[old]
        every = sorted({*pdf.q1, *pdf.q2})
        return pd.DataFrame({"q": every, "cluster": [place.get(q, q) for q in every]})

    return run


def iterative_clusters(serp: DataFrame, low: int = 3, high: int = 10, cap: int = 100, places: DataFrame | None = None) -> DataFrame:
    """(q, cluster): greedy full-link clusters with falling thresholds. Every test is on pairs within one connected part
    at the lowest threshold, so parts are clustered apart; queries without a partner are their own clusters.

    places(q, geo) keeps queries of unlike places apart (equal places, or none on both sides, go together): as that is an
    equality, dropping such pairs beforehand is exact. Queries of places without a result page are in cluster -1."""
    pairs = shared_url_pairs(serp, low)
    if places is not None:
        end = lambda k: places.select(F.col("q").alias(f"q{k}"), F.col("geo").alias(f"geo{k}"))
        pairs = pairs.join(end(1), "q1").join(end(2), "q2").where(F.col("geo1").eqNullSafe(F.col("geo2"))).select("q1", "q2", "common")
    pairs = checkpointed(pairs)
    parts = components(pairs.select(F.col("q1").alias("src"), F.col("q2").alias("dst")))
    grouped = pairs.join(parts, pairs.q1 == parts.node).select("component", "q1", "q2", "common").groupBy("component")
    placed = grouped.applyInPandas(_greedy(low, high, cap), "q long, cluster long")
    out = serp.select("q").distinct().join(placed, "q", "left").select("q", F.coalesce("cluster", "q").alias("cluster"))
    if places is None:
        return out
    return out.unionByName(places.select("q").distinct().join(out, "q", "left_anti").select("q", F.lit(-1).cast("long").alias("cluster")))
