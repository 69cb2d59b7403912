"""Single linkage over a graph of distances: minimum spanning forest by rounds of least edges, dendrogram and cuts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .graph import checkpointed, components, forest_of


def _forests(chunk: int):
    """Edges (x, y, height, a, b) without those that close a circle of lesser ones in this task: these are in no forest of the whole either. At
    most a chunk and a batch are held."""

    def least(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        x, y, height, a, b = (c.to_numpy() for c in table.columns)
        order = np.lexsort((b, a, height))
        return table.take(order[forest_of(x[order], y[order])[0]]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > chunk:
                held = least(held)
                size = sum(h.num_rows for h in held)
                if 2 * size > chunk:
                    yield from held
                    held, size = [], 0
        if size:
            yield from least(held)

    return run


def spanning_forest(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b, height) of the minimum spanning forest of edges(src, dst, distance), undirected; of equal distances the edge of lesser ends.

    Tasks first leave out what closes a circle among their own edges, and again among more of them as long as that halves the edges; of at most
    graph.CHUNK edges one task makes the forest. Else, in a round every connected part takes its least edge to another one; parts at least
    halve in number. Loops, null ends and null distances are no edges; of parallel ones the least counts."""
    own = edges.where("src <> dst and distance is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("distance").cast("double").alias("height"))
    own = own.select(F.col("a").alias("x"), F.col("b").alias("y"), "height", "a", "b")
    rounds_taken, left = [], checkpointed(own.mapInArrow(_forests(graph.CHUNK), own.schema))
    for _ in range(rounds):
        count, before = left.count(), None
        while before is None or graph.CHUNK < count <= before / 2:
            before, left = count, checkpointed(left.coalesce(max(1, -(-count // graph.CHUNK))).mapInArrow(_forests(graph.CHUNK), own.schema))
            if before <= graph.CHUNK:
                return checkpointed(reduce(DataFrame.unionByName, [*rounds_taken, left.select("a", "b", "height")]))
            count = left.count()
        left = left.select("x", "y", F.struct("height", "a", "b").alias("e"))
        ends = left.select(F.col("x").alias("part"), "x", "y", "e").unionByName(left.select(F.col("y").alias("part"), "x", "y", "e"))
        least = checkpointed(ends.groupBy("part").agg(F.min(F.struct("e", "x", "y")).alias("m")).select("m.e", "m.x", "m.y").distinct())
        rounds_taken.append(least.select("e.a", "e.b", "e.height"))
        # Parts that the edges join become the nodes of the next round; of the edges between two of them the least is left.
        parts = components(least.select(F.col("x").alias("src"), F.col("y").alias("dst")))
        one, two = (parts.select(F.col("node").alias(k), F.col("component").alias(p)).hint("merge") for k, p in (("x", "p"), ("y", "r")))
        moved = left.join(one, "x").join(two, "y").where("p <> r").select(F.least("p", "r").alias("x"), F.greatest("p", "r").alias("y"), "e")
        left = checkpointed(moved.groupBy("x", "y").agg(F.min("e").alias("e")).select("x", "y", "e.height", "e.a", "e.b"))
    raise RuntimeError(f"forest not settled after {rounds} rounds")


def cut(forest: DataFrame, nodes: DataFrame, clusters: int) -> DataFrame:
    """(node, cluster) of nodes(node) when the longest edges of the forest are taken out until there are `clusters` clusters, or as many as the forest
    has parts, if those are more. A cluster is named by its least node. Only the edges taken out, fewer than `clusters`, reach the driver."""
    everyone = nodes.select("node").distinct()
    parts = everyone.count() - forest.count()
    drop = forest.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(max(0, clusters - parts))
    kept = forest.join(F.broadcast(drop.select("a", "b")), ["a", "b"], "left_anti")
    label = components(kept.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return everyone.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def dendrogram(forest: DataFrame) -> DataFrame:
    """(step, a, b, height): the merges in their order. Steps follow the sort, so they grow and need not be consecutive."""
    return forest.orderBy("height", "a", "b").select(F.monotonically_increasing_id().alias("step"), "a", "b", "height")


def multilevel(forest: DataFrame, nodes: DataFrame, levels: tuple[int, ...] = (5, 15, 30)) -> DataFrame:
    """(node, level_<n> for each n): the cuts at several numbers of clusters; a finer one divides a coarser one's clusters."""
    everyone = nodes.select("node").distinct()
    if not levels:
        return everyone
    forest = checkpointed(forest)
    parts = everyone.count() - forest.count()
    drop = forest.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(max(0, max(levels) - parts))
    label = components(forest.join(F.broadcast(drop.select("a", "b")), ["a", "b"], "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    out = everyone.where("node is not null").join(label, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    # The edges that the finest cut takes out, the longest first, are what joins its clusters to those of the others.
    drop = drop.collect()
    ends = {n for e in drop for n in (e.a, e.b)}
    own = {n: n for n in ends} | {r.node: r.component for r in label.where(F.col("node").isin(list(ends))).collect()}
    kind = dict(out.dtypes)["cluster"]
    for n in levels:
        name = {c: c for c in own.values()}
        for e in drop[max(0, n - parts) :]:
            one, two = (name[own[x]] for x in (e.a, e.b))
            name = {c: min(one, two) if d in (one, two) else d for c, d in name.items()}
        moved = {c: d for c, d in name.items() if c != d}
        to = F.create_map(*[F.lit(x).cast(kind) for kv in moved.items() for x in kv])[F.col("cluster")] if moved else F.lit(None)
        out = out.withColumn(f"level_{n}", F.coalesce(to, "cluster"))
    return out.drop("cluster")


def best_number(forest: DataFrame, nodes: DataFrame, most: int = 30) -> int:
    """The number of clusters, from 2 to `most`, before whose next merge the heights jump most (of equal jumps the fewest clusters); the number of
    parts where nothing can be merged. Only `most` heights reach the driver."""
    total, merges = nodes.select("node").distinct().count(), forest.count()
    parts = total - merges
    heights = [r.height for r in forest.orderBy(F.desc("height")).limit(most).collect()]
    best, jump = max(parts, 1), float("-inf")
    for k in range(len(heights) - 1):
        n = parts + k + 1
        if 2 <= n <= most and heights[k] - heights[k + 1] > jump:
            best, jump = n, heights[k] - heights[k + 1]
    return best
