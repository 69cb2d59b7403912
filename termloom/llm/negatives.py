"""Hard negatives by a pivot table: exact ranks of inner products without comparing every anchor with every row.

With M the greatest length of a vector, a row x gets the further component sqrt(M**2 - |x|**2) and an anchor a gets 0. Then
the squared distance of the two is M**2 + |a|**2 - 2 * score, so a score is known from a distance and the other way round.
The pivot table holds the distances of every row to PIVOTS pivots, and the row's cell, that of its nearest pivot. For any
pivot p the triangle inequality puts the distance of a and x between |d(a, p) - d(x, p)| and d(a, p) + d(x, p); that
brackets the score. It is used three times: an anchor is sent only to cells whose ranges of stored distances leave a score
that it still needs; within a cell, rows are in the order of the distance to the cell's pivot, so what is left is one
stretch; rows of that stretch go by all their pivots. Scores of the survivors are computed exactly, in integers.

What an anchor still needs follows from its scores with a bounded sample of the table, whose rows are rows of the table:
the k-th best of them is a bound that the k-th best of all can't fall below. Cells are cut into blocks of bounded size, the
anchors stream past a block's rows, and each block hands on its best k alone. The fit (pivots, bounds) reads SAMPLE rows;
every row is in the table and every one that the bounds don't rule out is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Pivots; rows that pivots and first bounds are taken from; numbers that a block's vectors hold together.
PIVOTS, SAMPLE, BLOCK_NUMBERS = 16, 4096, 1 << 21
_EXACT = float(1 << 53)
_MEETING = "block long, kind int, id long, label long, v array<long>, pd array<float>, want array<long>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix of whole numbers; shorter lists are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class _Space:
    """The augmented space: width and greatest squared length of the vectors, and the pivots."""

    def __init__(self, sample: np.ndarray, width: int, most: float):
        self.width, self.most = width, most
        self.slack = 1e-6 * (most**0.5 + 1)  # more than the stored distances are rounded by
        lifted = self.lift(sample)
        picked, far = [0], np.full(len(sample), np.inf)
        while len(picked) < min(PIVOTS, len(sample)):
            far = np.minimum(far, ((lifted - lifted[picked[-1]]) ** 2).sum(axis=1))
            if far.max() <= 0:
                break
            picked.append(int(far.argmax()))
        self.pivots = lifted[picked]

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1, keepdims=True), 0))])

    def to_pivots(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def anchor_to_pivots(self, v: np.ndarray) -> np.ndarray:
        return self.to_pivots(np.hstack([v.astype(np.float64), np.zeros((len(v), 1))]))

    def radius(self, v: np.ndarray, score: float) -> float:
        """The distance from anchor v at which a row has this score; -1 where no row can have it."""
        square = self.most + float((v.astype(np.float64) ** 2).sum()) - 2 * score
        return square**0.5 if square >= 0 else -1.0

    def scores(self, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles while every one is below 2**53, else in 64-bit integers."""
        if self.most < _EXACT:
            return (rows.astype(np.float64) @ v.astype(np.float64)).astype(np.int64)
        return rows @ v


def _pivot_table(space: _Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            if batch.num_rows:
                pd = space.to_pivots(space.lift(_matrix(batch.column(2), space.width)))
                slot = pa.array(np.arange(at, at + batch.num_rows), pa.int64())
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(pd.astype(np.float32)), pa.array(pd.argmin(axis=1), pa.int64()), slot], names=["id", "label", "v", "pd", "cell", "slot"])

    return run


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))


class _Positives:
    """Wanted: the `k` best rows of the anchor's label. want: [least score that may be among them]."""

    def __init__(self, k: int):
        self.k = k

    def windows(self, own: int, want: list[int], found: Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int | None, int | None]]:
        ids, labels, scores = found()
        same = np.sort(scores[labels == own])[::-1]
        return [(0, int(same[self.k - 1]) if len(same) >= self.k else None, None)]

    @staticmethod
    def eligible(labels: np.ndarray, own: int) -> np.ndarray:
        return labels == own


class _Negatives:
    """Wanted: for each positive score in `want` the `k` best rows of other labels with low * it <= 100 * score <= high * it."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high

    def windows(self, own: int, want: list[int], found: Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int | None, int | None]]:
        ids, labels, scores = found()
        other, out = np.sort(scores[labels != own])[::-1], []
        for j, positive in enumerate(want):
            least, most = -(-self.low * positive // 100), self.high * positive // 100
            below = other[other <= most]
            if len(below) >= self.k:
                least = max(least, int(below[self.k - 1]))
            if least <= most:
                out.append((j, least, most))
        return out

    @staticmethod
    def eligible(labels: np.ndarray, own: int) -> np.ndarray:
        return labels != own


def _visits(space: _Space, sample: tuple[np.ndarray, np.ndarray, np.ndarray], cells: dict[int, tuple[int, int, np.ndarray, np.ndarray]], wanted):
    """Anchors (id, label, v, want) to a row for every block that they must meet. cells: first block, blocks, and the least
    and greatest stored distance to each pivot. want becomes triples (which, least, greatest score), flat."""
    order = sorted(cells)
    low, high = (np.array([cells[c][k] for c in order]) for k in (2, 3))
    limit = np.iinfo(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = sample
        for batch in batches:
            if not batch.num_rows:
                continue
            v, out = _matrix(batch.column(2), space.width), []
            pd = space.anchor_to_pivots(v)
            for r, (own_id, own, want) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                others = ids != own_id
                windows = wanted.windows(own, want, lambda: (ids[others], labels[others], space.scores(rows[others], v[r])))
                if not windows:
                    continue
                near, far = _range(space, v[r], windows)
                if far < 0:
                    continue
                keep = (np.maximum(pd[r] - high, low - pd[r]).max(axis=1) <= far + space.slack) & ((pd[r] + high).min(axis=1) >= near - space.slack)
                flat = [x for j, least, most in windows for x in (j, limit.min if least is None else least, limit.max if most is None else most)]
                out += [(cells[order[c]][0] + b, r, flat) for c in np.flatnonzero(keep) for b in range(cells[order[c]][1])]
            for at in range(0, len(out), 4096):
                part = out[at : at + 4096]
                take = pa.array([x[1] for x in part], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.int64()), pa.array([1] * len(part), pa.int32()), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), _lists(pd[[x[1] for x in part]].astype(np.float32)), pa.array([x[2] for x in part], pa.list_(pa.int64()))],
                    names=["block", "kind", "id", "label", "v", "pd", "want"],
                )

    return run


def _range(space: _Space, v: np.ndarray, windows: list[tuple[int, int | None, int | None]]) -> tuple[float, float]:
    """Distances from v between which all rows with a score in one of the windows lie."""
    least = None if any(w[1] is None for w in windows) else min(w[1] for w in windows)
    most = None if any(w[2] is None for w in windows) else max(w[2] for w in windows)
    far = np.inf if least is None else space.radius(v, least)
    return (0.0 if most is None else max(space.radius(v, most), 0.0)), far


def _best(space: _Space, wanted, pivot_of: dict[int, int]):
    """Rows of a block (kind 0), then its anchors (kind 1), to (anchor, which, id, score): the block's best of each window."""
    limit = np.iinfo(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if start == end:
                    continue
                piece = batch.slice(start, end - start)
                if blocks[start] != at:
                    at, parts, held = int(blocks[start]), [], None
                arrays = [piece.column(2).to_numpy(), piece.column(3).to_numpy(), _matrix(piece.column(4), space.width), _matrix(piece.column(5), len(space.pivots))]
                if kinds[start] == 0:
                    parts.append([a.copy() for a in arrays])
                    continue
                if not parts:
                    continue
                if held is None:
                    held = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    held = [a[np.argsort(held[3][:, pivot_of[at]], kind="stable")] for a in held]
                for r, flat in enumerate(piece.column(6).to_pylist()):
                    windows = [(flat[k], None if flat[k + 1] == limit.min else flat[k + 1], None if flat[k + 2] == limit.max else flat[k + 2]) for k in range(0, len(flat), 3)]
                    found += _of_block(space, wanted, held, pivot_of[at], tuple(a[r] for a in arrays), windows)
            if found:
                yield pa.RecordBatch.from_pydict({n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(("anchor", "which", "id", "score"))})

    return run


def _of_block(space: _Space, wanted, held: list[np.ndarray], pivot: int, anchor: tuple, windows: list[tuple[int, int | None, int | None]]) -> list[tuple[int, int, int, int]]:
    ids, labels, rows, pd = held
    own_id, own, v, to_pivots = anchor
    near, far = _range(space, v, windows)
    column = pd[:, pivot]
    first, last = np.searchsorted(column, [to_pivots[pivot] - far - space.slack, to_pivots[pivot] + far + space.slack])
    last = max(last, first)
    ok = wanted.eligible(labels[first:last], own) & (ids[first:last] != own_id)
    left = np.flatnonzero(ok) + first
    if np.isfinite(far) and len(left):
        left = left[np.abs(pd[left] - to_pivots).max(axis=1) <= far + space.slack]
    if near > 0 and len(left):
        left = left[(pd[left] + to_pivots).min(axis=1) >= near - space.slack]
    if not len(left):
        return []
    scores, names, out = space.scores(rows[left], v), ids[left], []
    order = np.lexsort((names, -scores))
    scores, names = scores[order], names[order]
    for j, least, most in windows:
        from_, to = 0 if most is None else int(np.searchsorted(-scores, -most)), len(scores) if least is None else int(np.searchsorted(-scores, -least, side="right"))
        out += [(int(own_id), j, int(names[k]), int(scores[k])) for k in range(from_, min(to, from_ + wanted.k))]
    return out


def mine_hard_negatives(rows: DataFrame, anchors: Column | str = "vec_id % 100 = 0", id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor and each of its positives the rows of other labels that score just below the positive.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. A component x counts as
    floor(scale * x); a score is the inner product with the anchor, a whole number; higher ones come first, of equal ones the
    smaller id. Positives are the first `positives` other rows of the anchor's label (all, if fewer), negatives the first
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score (all, if
    fewer); a positive without any has no row, and so has one of a negative score. `anchors` is a condition on rows' columns.
    Rows without an id, a label or a vector, or with a component that is null or not finite, take no part. Labels are
    integers. Vectors of unequal length are filled with zeros; an empty one scores 0 with all. Rows that repeat an id are
    rows of their own for other anchors, and never positive or negative of an anchor with that id; of repeated anchors the
    one with the least label, then vector, counts. Empty tables, and tables without anchors, give empty results. Further
    columns are ignored. Raises ArithmeticError where a vector's squared length passes 2**62, since scores are longs.
    """
    spark = rows.sparkSession
    whole = F.transform(F.col("x"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(F.col("x"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"), (F.expr(anchors) if isinstance(anchors, str) else anchors).alias("is_anchor"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(finite)
    square = F.aggregate("x", F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"), 2))
    known = materialise(own.select("id", "label", whole.alias("v"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), square.alias("square")), "vectors")
    most, width, total = known.agg(F.max("square"), F.max(F.size("v")), F.count("*")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not total:
        return empty
    if most >= float(1 << 62):
        raise ArithmeticError("squared lengths beyond 2**62: scores are no longs")
    picked = known.select("id", "label", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
    chunk = [picked.column(k).chunk(0) for k in range(3)]
    width = max(width, 1)
    sample = (chunk[0].to_numpy(), chunk[1].to_numpy(), _matrix(chunk[2], width))
    # A row's computed square may differ in the last place; a greater M only moves all points further out.
    space = _Space(sample[2], width, max(most * (1 + 1e-9), 1.0))

    stored = materialise(known.select("id", "label", "v").mapInArrow(_pivot_table(space), "id long, label long, v array<long>, pd array<float>, cell long, slot long"), "pivot_table")
    ends = [f(F.col("pd")[p]).alias(f"{n}{p}") for p in range(len(space.pivots)) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    size, cells, next_block = max(1024, BLOCK_NUMBERS // width), {}, 0
    for c in stored.groupBy("cell").agg(F.count("*").alias("n"), *ends).orderBy("cell").collect():  # a row for each pivot
        blocks = -(-c.n // size)
        cells[c.cell] = (next_block, blocks, *(np.array([c[f"{n}{p}"] for p in range(len(space.pivots))], np.float64) for n in ("lo", "hi")))
        next_block += blocks
    pivot_of = {first + b: c for c, (first, blocks, *_) in cells.items() for b in range(blocks)}
    start = F.create_map(*[F.lit(x).cast("long") for c, (first, *_) in cells.items() for x in (c, first)])
    parts = F.create_map(*[F.lit(x).cast("long") for c, (_, blocks, *_) in cells.items() for x in (c, blocks)])
    placed = stored.select((start[F.col("cell")] + F.pmod(F.xxhash64("slot", "id"), parts[F.col("cell")])).alias("block"), F.lit(0).alias("kind"), "id", "label", "v", "pd", F.lit(None).cast("array<long>").alias("want"))

    def best(asking: DataFrame, wanted) -> DataFrame:
        sent = asking.select("id", "label", "v", "want").mapInArrow(_visits(space, sample, cells, wanted), _MEETING)
        met = placed.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind")
        found = met.mapInArrow(_best(space, wanted, pivot_of), "anchor long, which long, id long, score long")
        order = Window.partitionBy("anchor", "which").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted.k)

    asking = known.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    asking = materialise(asking, "anchors")
    chosen = materialise(best(asking.withColumn("want", F.array().cast("array<long>")), _Positives(positives)).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("which")), "positives")
    wants = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("which", "positive_score"))).alias("w")).select(F.col("anchor").alias("id"), F.col("w.positive_score").alias("want"))
    found = best(asking.join(wants, "id"), _Negatives(negatives, low, high)).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    out = found.join(chosen, ["anchor", "which"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
