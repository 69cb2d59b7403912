"""Graph operators: components and PageRank, as loops of joins whose lineage is cut by checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task takes into account at a time, and so the most that a last task settles by itself.
CHUNK = 1_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the folder that executors share (spark.checkpoint.dir; one of our own in local mode) and read back: lineage
    ends there, a lost executor costs no rerun, and the plans that follow know the table's true size (a checkpoint of Spark's own keeps
    the estimate of its plan, which multiplies from join to join in a loop)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forest_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges in their order, the best first: places of those in the spanning forest; the nodes in order, and the least node of each one's part."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = ends[: len(x)], ends[len(x) :]
    every, label, left, chosen = np.arange(len(nodes)), np.arange(len(nodes)), np.arange(len(x)), np.zeros(len(x), bool)
    while True:
        p, q = label[u[left]], label[v[left]]
        apart = p != q
        left, p, q = left[apart], p[apart], q[apart]
        if not len(left):
            break
        best = np.full(len(nodes), len(x))
        np.minimum.at(best, p, left)
        np.minimum.at(best, q, left)
        parts = np.flatnonzero(best < len(x))
        edge = best[parts]
        chosen[edge] = True
        one, two = label[u[edge]], label[v[edge]]
        to = every.copy()
        to[parts] = np.where(one == parts, two, one)
        # Edges have an order, so parts go round in pairs alone.
        to = np.where((to[to] == every) & (every < to), every, to)
        while (to != to[to]).any():
            to = to[to]
        label = to[label]
    least = np.full(len(nodes), len(nodes))
    np.minimum.at(least, label, every)
    return np.flatnonzero(chosen), nodes, nodes[least[label]]


def _stars(chunk: int):
    """Edges (src, dst) to (src, dst) with every node once a chunk, linked with the least node that the chunk's edges lead to."""

    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        _, nodes, least = forest_of(*(c.to_numpy() for c in table.columns))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((nodes, least), table.schema, strict=True)], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if size and size + batch.num_rows > chunk:
                yield settled(held)
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if size:
            yield settled(held)

    return run


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """edges(src, dst) to (node, component): the least node of each connected part. Tasks first put the stars of chunks of edges in their
    place; when these are CHUNK at most, one task joins them, else rounds do. Each round takes the least label around a node and then that
    label's own label, so long paths shrink fast. Labels are merged, never broadcast, so nothing that grows with the nodes passes through
    the driver. Edges with a null end are left out."""
    # One pass over edges, which may be a whole join that isn't written yet.
    own = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges = checkpointed(own.mapInArrow(_stars(CHUNK), own.schema))
    if edges.count() <= CHUNK:
        return checkpointed(edges.coalesce(1).mapInArrow(_stars(CHUNK), own.schema).toDF("node", "component"))
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    both = checkpointed(edges.select(ways).select("e.src", "e.dst").distinct())
    labels = checkpointed(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    for _ in range(rounds):
        around = both.join(labels.hint("merge"), both.dst == labels.node).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        step = labels.hint("merge").join(around, "node").select("node", F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        new = checkpointed(step.join(jump.hint("merge"), "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("component")))
        if new.hint("merge").join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            return new
        labels = new
    raise RuntimeError("components did not settle")


def label_propagation(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """edges(src, dst), taken as undirected, to (node, community). All nodes take the label most frequent around them and
    on themselves at once, of equally frequent ones the least, until nothing changes or `rounds` are over (labels may
    swing between two states)."""
    both = checkpointed(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = checkpointed(both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    seen = checkpointed(both.unionByName(labels.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct())
    for _ in range(rounds):
        counted = seen.join(labels, seen.dst == labels.node).groupBy("src", "community").agg(F.count("*").alias("n"))
        new = checkpointed(counted.groupBy(F.col("src").alias("node")).agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")))
        if new.join(labels.withColumnRenamed("community", "old"), "node").where("community <> old").isEmpty():
            return new
        labels = new
    return labels


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """edges(src, dst[, weight]), taken as undirected, to (node, rank). Stops when the ranks' summed change is small."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    one = edges.select("src", "dst", weight.cast("double").alias("w"))
    both = one.union(one.select("dst", "src", "w"))
    out = both.groupBy("src").agg(F.sum("w").alias("total"))
    links = checkpointed(both.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    n = out.count()
    ranks = checkpointed(out.select(F.col("src").alias("node"), F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(rounds):
        given = links.join(ranks, links.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = checkpointed(given.select(F.col("dst").alias("node"), ((1 - alpha) / n + alpha * F.col("got")).alias("rank")))
        moved = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        ranks = new
        if moved < tolerance * n:
            break
    return ranks


def adjacency_cells(edges: DataFrame) -> DataFrame:
    """(node, other, links): the cells of the adjacency matrix that aren't 0, both ways, for graphs of any size."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    return both.groupBy("node", "other").agg(F.count("*").alias("links"))


def adjacency_matrix(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, a column for every node): the number of links between two nodes, both ways. ValueError beyond `most` nodes,
    since a table can't be wider; use adjacency_cells then."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = [r.src for r in both.select("src").distinct().orderBy("src").limit(most + 1).collect()]
    if len(nodes) > most:
        raise ValueError(f"more than {most} nodes")
    return both.groupBy(F.col("src").alias("node")).pivot("dst", nodes).count().na.fill(0)


def graph_export(edges: DataFrame, features: DataFrame) -> DataFrame:
    """(part, json): a JSON object for each node with its features (part 'nodes') and for each edge ('edges'), so that a graph of any size is
    written as lines by many tasks."""
    row = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
    return row(features, "nodes").unionByName(row(edges, "edges"))


def node_features(edges: DataFrame) -> DataFrame:
    """(node, degree, weighted_degree, share) of edges(src, dst[, weight]); share is the degree over all other nodes."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    one = edges.select("src", "dst", weight.cast("double").alias("w"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = both.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("degree"), F.sum("w").alias("weighted_degree"))
    return out.join(F.broadcast(out.agg(F.count("*").alias("n")))).select("node", "degree", "weighted_degree", (F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("share"))


def hubs(edges: DataFrame, top: int = 50) -> DataFrame:
    """(node, rank) of the `top` nodes of the highest PageRank; of equals the least."""
    return pagerank(edges).orderBy(F.desc("rank"), "node").limit(top)
