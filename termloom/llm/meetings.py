"""Links within buckets of documents, found once each, when a bucket may hold a third of all rows.

`linked_components` takes classes of documents (id, n, mark, more, keys): a key for each bucket that the class is in, a small
mark by which two of a bucket are screened, and what a second screen reads of those that pass, before their full sets are
compared.

1. Within each bucket every class is compared with the bucket's centre alone (one candidate a row). Candidates pass the
   screen and then a check on the full sets. The links found give components.
2. What is left are pairs of one bucket without its centre and in different components, so at least one of the two is
   outside the bucket's largest component. A large group has a bucket of nearly the same rows for each of its keys; such buckets
   are joined into one, in which a row is once (see `_joint`). Only rows outside the largest component visit the bucket's blocks,
   which split it over tasks; all others stay at home, so a large group that is connected but for a few rows is not repeated.
   Rows meet by mark; those with a near partner meet again with their full sets, and each block returns the links that connect
   its components (fewer than its rows). So every pair of a bucket is either known to be connected or was compared once, where
   the first bucket they share is (again, if one of them is its centre and they meet in another); none is given up for its bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components
from .shingles import shingle_set

#: Rows of a bucket that one block compares with another; partners of one hub whose sets one group checks; ids up to which their
#: table is broadcast to the texts (beyond, the texts are shuffled).
BLOCK, CHECKED, FEW_IDS = 256, 1024, 500_000


class Screen(Protocol):
    """What is known of two classes before their full sets are compared. Neither screen may lose a link."""

    #: Whether rows that pass in their block have to meet there once more, for `meet` and `first`.
    again: bool

    def pairs(self, a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether classes of marks a[k] and b[k] may be linked, for every k."""

    def block(self, marks: list[bytes], n: np.ndarray, here: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
        """A function (k, rows) that keeps the rows of a block that may be linked with row k; here[k]: its keys of the block's buckets."""

    def meet(self, a: bytes, b: bytes) -> bool:
        """Whether two that passed may still be linked, by `more` of both."""

    def first(self, a: np.ndarray, b: np.ndarray, here: np.ndarray) -> bool:
        """Whether the first bucket that both are in, by the keys of both, is one of `here` (True where block has seen to that)."""


def _screened(screen: Screen):
    """Rows (a, b, n_a, n_b, mark_a, mark_b): those that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = screen.pairs(batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy())
                yield batch.select([0, 1]).filter(pa.array(near))

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows that agree in their first `keys` columns, each as (number of its last batch, rows). Lists come as arrays."""
    group, at, k = [], None, 0
    for k, batch in enumerate(batches):
        columns = []
        for c in batch.columns:
            if pa.types.is_list(c.type):
                flat, ends = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
                columns.append([flat[ends[r] : ends[r + 1]].copy() for r in range(len(c))])
            else:
                columns.append(c.to_pylist())
        for row in zip(*columns, strict=True):
            if row[:keys] != at:
                if len(group) > 1:
                    yield k, group
                group, at = [], row[:keys]
            group.append(row)
    if len(group) > 1:
        yield k, group


def _partners(rows: list[tuple], percent: int, screen: Screen) -> Iterator[tuple[int, np.ndarray]]:
    """For each row k of a block (key, i, j, id, comp, n, side, mark, here), the later rows that may be linked with it: another
    component, sizes that allow it, and marks that pass. side: 0 at
    home and in the bucket's largest component, 1 at home and in another, 2 visiting. Rows at home meet visitors; two
    that are both outside the largest component meet where the one with the lesser id is at home. In a bucket of one block
    nobody visits: all have side 3 and meet."""
    comp, n = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    side, ids = np.array([r[6] for r in rows]), np.array([r[3] for r in rows])
    passing = screen.block([r[7] for r in rows], n, [r[8] for r in rows])
    for k in range(len(rows) - 1):
        other, later = side[k + 1 :], ids[k + 1 :]
        ok = (comp[k + 1 :] != comp[k]) & ((side[k] == 3) | ((other == 2) != (side[k] == 2)))
        if side[k] == 2:
            ok &= (other == 0) | (later < ids[k])
        elif side[k] == 1:
            ok &= later > ids[k]
        ok &= 100 * np.minimum(n[k + 1 :], n[k]) >= percent * np.maximum(n[k + 1 :], n[k])
        at = np.flatnonzero(ok) + k + 1
        if len(at):
            at = passing(k, at)
        if len(at):
            yield k, at


def _with_partner(percent: int, screen: Screen, first: bool = False):
    """The rows of a block that have a partner, once each; with `first`, one that the second screen lets pass and that meets them in
    no earlier bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            found: set[int] = set()
            for k, at in _partners(rows, percent, screen):
                near = [x for x in at.tolist() if not first or (screen.first(rows[k][10], rows[x][10], rows[k][8]) and screen.meet(rows[k][9], rows[x][9]))]
                found.update([k, *near] if near else [])
            if found:
                yield pa.RecordBatch.from_pydict({name: [rows[x][c] for x in sorted(found)] for name, c in (("key", 0), ("i", 1), ("j", 2), ("id", 3), ("comp", 4), ("side", 6), ("here", 8))})

    return run


def _linked(percent: int, screen: Screen):
    """Links that connect a block's components, checked on the full sets: one less than its rows at most, since what
    is connected already isn't compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 3):
            parent = {r[4]: r[4] for r in rows}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            found = []
            for k, at in _partners(rows, percent, screen):
                for x in at.tolist():
                    one, two = root(rows[k][4]), root(rows[x][4])
                    if one == two or not screen.first(rows[k][10], rows[x][10], rows[k][8]) or not screen.meet(rows[k][9], rows[x][9]):
                        continue
                    common = len(np.intersect1d(rows[k][11], rows[x][11], assume_unique=True))
                    if 100 * common >= percent * (len(rows[k][11]) + len(rows[x][11]) - common):
                        parent[one] = two
                        found.append((rows[k][3], rows[x][3]))
            if found:
                yield pa.RecordBatch.from_pydict({"a": [f[0] for f in found], "b": [f[1] for f in found]})

    return run


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ids(id), a written table."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id", "left_semi")


def _sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents in ids, a written table."""
    return materialise(_only(docs, ids).dropDuplicates(["id"]).mapInArrow(_sets(width), "id long, shingles array<long>"), "sets")


def _checked(percent: int):
    """Rows (a, part, kind, id, shingles) in order: the set of hub a (kind 0), then those of its partners, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in batches:
            found, (flat, ends) = [], (lambda c: (c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()))(batch.column(4))
            for r, (a, part, kind, other) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                own = flat[ends[r] : ends[r + 1]]
                if kind == 0:
                    hub, held = (a, part), own.copy()
                elif hub == (a, part):
                    common = len(np.intersect1d(held, own, assume_unique=True))
                    if 100 * common >= percent * (len(held) + len(own) - common):
                        found.append((a, other))
            yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. A hub's set is sent once for every
    CHECKED of its partners, and its partners are spread over as many groups."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = _sets_of(ids, docs, width)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHECKED).alias("parts"))
    placed = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    hubs = placed.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("id"), "shingles")
    partners = placed.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", F.lit(1).alias("kind"), F.col("b").alias("id"), "shingles")
    met = hubs.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return met.mapInArrow(_checked(percent), "a long, b long")


def _meeting(screen: Screen):
    """Rows (a, b, more_a, more_b): those that the second screen lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [screen.meet(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _joint(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """(id, comp, minor, key, rows, minors, here) of the rows (key, id, comp) of the buckets mixed(key, major, rows, minors), a written table.

    Buckets of one largest component and about one size become one, called by the least of their keys, unless that would have
    more pairs to compare than they have together. `here` has the keys of those buckets that the row is in: two rows are of
    one bucket only if they share a key."""
    levels = mixed.withColumn("level", F.floor(F.log2("rows")))
    members = placed.join(levels, "key").groupBy("major", "level", "id").agg(F.min("comp").alias("comp"), F.collect_list(F.struct("key", "rows", "minors")).alias("own"))
    members = materialise(members.withColumn("minor", F.col("comp") != F.col("major")), "members")
    together = members.groupBy("major", "level").agg(F.count("*").alias("rows"), F.sum(F.col("minor").cast("long")).alias("minors"))
    apart = levels.groupBy("major", "level").agg(F.min("key").alias("key"), F.sum(F.col("rows").cast("double") * F.col("minors")).alias("pairs"))
    joint = together.join(apart, ["major", "level"]).where(F.col("rows").cast("double") * F.col("minors") <= F.col("pairs"))
    joint = materialise(joint.select("major", "level", F.struct("key", "rows", "minors").alias("all")), "joint")
    one = F.array(F.struct("all.key", "all.rows", "all.minors", F.col("own.key").alias("here")))
    each = F.transform("own", lambda b: F.struct(b["key"].alias("key"), b["rows"].alias("rows"), b["minors"].alias("minors"), F.array(b["key"]).alias("here")))
    return members.join(joint, ["major", "level"], "left").select("id", "comp", "minor", F.inline(F.when(F.col("all").isNotNull(), one).otherwise(each)))


def linked_components(classes: DataFrame, docs: DataFrame, width: int, percent: int, screen: Screen, block: int | None = None) -> DataFrame:
    """(node, component) of the classes (id, n, rank, mark, more, keys) that are linked with another one. docs(id, text) has the
    texts of their ids; block: rows of a block, BLOCK by default. A bucket's centre is its class of the highest rank, of equals the one of the least id."""
    block = block or BLOCK
    rows = classes.select("id", "rank", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.max(F.struct(F.col("rank"), (-F.col("id")).alias("minus"))).alias("c"), F.count("*").alias("rows")).where("rows > 1")
    buckets = materialise(buckets.select("key", (-F.col("c.minus")).alias("centre"), "rows"), "buckets")
    rows = materialise(rows.select("id", "key").join(buckets, "key").select("key", "id", "centre", "rows"), "bucketed")

    marks = classes.select("id", "n", "mark")
    stars = rows.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    one, two = (marks.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("mark").alias(f"mark_{k}")) for k in "ab")
    sized = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    near = stars.join(two, "b").join(one, "a").where(sized).select("a", "b", "n_a", "n_b", "mark_a", "mark_b").mapInArrow(_screened(screen), "a long, b long")
    near = materialise(near, "near")
    rest = _only(classes.select("id", "more"), materialise(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids"))
    near = near.join(rest.select(F.col("id").alias("b"), F.col("more").alias("more_b")), "b").join(rest.select(F.col("id").alias("a"), F.col("more").alias("more_a")), "a")
    near = near.select("a", "b", "more_a", "more_b").mapInArrow(_meeting(screen), "a long, b long")
    links = materialise(_confirmed(materialise(near, "meeting"), docs, width, percent), "links")
    comps = materialise(connected_components(links), "comps")

    others = rows.where("id <> centre and rows > 2").select("key", "id")
    placed = others.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    sized = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = materialise(sized.groupBy("key").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("major"), (F.sum("c") - F.max("c")).alias("minors"), F.sum("c").alias("rows")).where("minors > 0"), "mixed")
    homes, visits = (F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int") for c in ("rows", "minors"))
    home, visit = (F.pmod(F.xxhash64("id"), n).cast("int") for n in (homes, visits))
    minor = F.col("minor")
    at_home = F.transform(F.sequence(F.lit(0), visits - 1), lambda j: F.struct(home.alias("i"), j.alias("j"), minor.cast("int").alias("side")))
    visiting = F.transform(F.sequence(F.lit(0), homes - 1), lambda i: F.struct(i.alias("i"), visit.alias("j"), F.lit(2).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(3).alias("side")))
    marks = classes.select("id", "n", "mark")
    dealt = F.when(F.col("rows") <= block, alone).when(minor, F.concat(at_home, visiting)).otherwise(at_home)
    spread = _joint(placed, mixed).select("key", "id", "comp", "here", F.explode(dealt).alias("b")).select("key", "b.i", "b.j", "id", "comp", "b.side", "here")
    columns, schema = ["key", "i", "j", "id", "comp", "n", "side", "mark", "here"], "key long, i long, j long, id long, comp long, side long, here array<long>"
    ordered = spread.join(marks, "id").select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    late = materialise(ordered.mapInArrow(_with_partner(percent, screen), schema), "late")
    held = _only(classes.select("id", "n", "mark", "more", "keys"), materialise(late.select("id").distinct(), "ids"))
    columns += ["more", "keys"]
    if screen.again:
        ordered = late.join(held, "id").select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        late = materialise(ordered.mapInArrow(_with_partner(percent, screen, True), schema), "first")
    sets = _sets_of(materialise(late.select("id").distinct(), "ids"), docs, width)
    held = materialise(sets.join(held, "id"), "held")
    again = late.join(held, "id").select(*columns, "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = materialise(again.mapInArrow(_linked(percent, screen), "a long, b long"), "more")
    return materialise(connected_components(links.unionByName(more)), "final")
