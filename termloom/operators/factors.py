"""Non-negative matrix factors of a table of (row, term, value), by multiplicative updates as joins and sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

_TINY = 1e-12


def _start(key: Column, topics: int, salt: int) -> Column:
    """A row of a factor to begin with: numbers in (0, 1] that follow from the key alone."""
    return F.array(*[(F.pmod(F.xxhash64(key, F.lit(salt), F.lit(i)), F.lit(1000)) + 1) / 1000.0 for i in range(topics)])


def _gram(factor: DataFrame, topics: int) -> np.ndarray:
    """The factor's small square product, summed in the tasks: topics * topics numbers."""
    sums = factor.agg(*[F.sum(F.col("f")[i] * F.col("f")[j]).alias(f"s{i}_{j}") for i in range(topics) for j in range(i, topics)]).first()
    out = np.zeros((topics, topics))
    for i in range(topics):
        for j in range(i, topics):
            out[i, j] = out[j, i] = sums[f"s{i}_{j}"] or 0.0
    return out


def _updated(cells: DataFrame, factor: DataFrame, other: DataFrame, own: str, far: str, topics: int) -> DataFrame:
    """factor(own, f) times (cells * other) over (factor * square product of other)."""
    gram = _gram(other, topics)
    met = cells.join(other.withColumnRenamed("f", "g"), far).groupBy(own).agg(*[F.sum(F.col("value") * F.col("g")[i]).alias(f"n{i}") for i in range(topics)])
    below = lambda i: sum((F.col("f")[j] * F.lit(float(gram[j, i])) for j in range(topics)), F.lit(0.0))
    new = F.array(*[F.col("f")[i] * F.coalesce(F.col(f"n{i}"), F.lit(0.0)) / (below(i) + _TINY) for i in range(topics)])
    return checkpointed(factor.join(met, own, "left").select(own, new.alias("f")))


def loss(cells: DataFrame, rows: DataFrame, terms: DataFrame, topics: int) -> float:
    """Squared distance of the table and the factors' product, over absent cells too: |V|^2 - 2 <V, WH> + <W'W, HH'>."""
    met = cells.join(rows.withColumnRenamed("f", "w"), "id").join(terms.withColumnRenamed("f", "h"), "term")
    dot = sum((F.col("w")[i] * F.col("h")[i] for i in range(topics)), F.lit(0.0))
    got = met.agg(F.sum(F.col("value") * F.col("value")).alias("v"), F.sum(F.col("value") * dot).alias("d")).first()
    return float((got.v or 0.0) - 2 * (got.d or 0.0) + (_gram(rows, topics) * _gram(terms, topics)).sum())


def factorise(cells: DataFrame, topics: int = 10, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(id, f) and (term, f): factors W and H, a list of `topics` numbers for each row and term, of cells(id, term, value), value positive, each cell once.

    A round updates H, then W; the loss never rises. A join and a sum by key each, besides topics squared numbers that the driver gets. The
    start follows from the keys, so results repeat. An empty table gives empty factors."""
    cells = checkpointed(cells.select("id", "term", F.col("value").cast("double").alias("value")).where("value > 0"))
    rows = checkpointed(cells.select("id").distinct().select("id", _start(F.col("id"), topics, 1).alias("f")))
    terms = checkpointed(cells.select("term").distinct().select("term", _start(F.col("term"), topics, 2).alias("f")))
    for _ in range(rounds):
        terms = _updated(cells, terms, rows, "term", "id", topics)
        rows = _updated(cells, rows, terms, "id", "term", topics)
    return rows, terms


def topic_assignments(rows: DataFrame, hard: float = 0.3, soft: float = 0.15, most: int = 3) -> DataFrame:
    """(id, topic, share, topics): shares are a row's numbers over their sum. topic is the greatest one's number if it is `hard` or more, else -1, of equal ones
    the first; topics are up to `most` of `soft` or more, greatest first. A row of zeros has topic -1 and none."""
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    shares = rows.withColumn("total", total).select("id", F.when(F.col("total") > 0, F.transform("f", lambda x, i: F.struct((x / F.col("total")).alias("s"), (-i).alias("i")))).otherwise(F.transform("f", lambda x, i: F.struct(F.lit(0.0).alias("s"), (-i).alias("i")))).alias("p"))
    ranked = shares.select("id", F.sort_array("p", asc=False).alias("p"))
    top = F.transform(F.slice(F.filter("p", lambda x: x.s >= soft), 1, most), lambda x: -x.i)
    return ranked.select("id", F.when(F.col("p")[0].s >= hard, -F.col("p")[0].i).otherwise(F.lit(-1)).alias("topic"), F.col("p")[0].s.alias("share"), top.alias("topics"))


def topic_names(terms: DataFrame, words: int = 3) -> DataFrame:
    """(topic, name): the `words` terms of the greatest number, of equal ones the least, joined by ' + '."""
    order = Window.partitionBy("topic").orderBy(F.desc("x"), "term")
    each = terms.select("term", F.posexplode("f").alias("topic", "x")).where("x > 0")
    ranked = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= words)
    return ranked.groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda t: t.term), " + ").alias("name"))
