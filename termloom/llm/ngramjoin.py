"""Exact Jaccard join on word shingles by several global orders of the shingles at once.

Under any order of all shingles, two sets of n and m elements with a similarity of t or more have an element in common
among the first n - ceil(t * n) + 1 of the one and the first m - ceil(t * m) + 1 of the other (else too few are left to
agree). Here there are ORDERS orders, each a hash of its own in which frequent shingles come last, and a pair is a candidate
only if the prefixes meet in every one: the first order's prefixes make the buckets in which documents meet; of those that
pass there by size and by a parity map of their sets, the prefixes under the other orders are intersected, before any full set
is fetched. The filters never lose a link, whatever the orders are.

Which shingles are frequent is counted over all documents: each task counts what it has read in pieces and hands on what
came at least twice in a piece, so a count falls short by one for each piece at most. Those of HOT documents or more set a
bit in a map of fixed size (a shingle that meets another's bit counts as frequent, which changes the order and no result).
With frequent shingles last, a line that a third of all documents share is in no prefix but of documents that are little else,
and a copy changed in many places has a prefix of shingles of its own and meets nobody.

Buckets may still be large (a group of close copies). meetings.py compares a bucket with its centre, the row with the
largest share of frequent shingles (the copies' common source rather than one of the changed ones), and then only what isn't
connected yet, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .meetings import linked_components
from .shingles import mix, shingle_set

ORDERS = 3
#: Documents from which a shingle is frequent; most frequent ones; bits of the map; shingles counted in one piece.
HOT, MOST_HOT, MAP_BITS, PIECE = 64, 1 << 20, 24, 1 << 21
#: Bits of a parity map, at least; larger sets have once to twice as many bits as elements.
PARITY = 512
_U = np.uint64


def _counts(width: int):
    """(shingle, n) of the shingles that came at least twice in a piece of the task's documents."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        more = n > 1
        return pa.RecordBatch.from_arrays([pa.array(token[more].view(np.int64)), pa.array(n[more].astype(np.int64))], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                sets.append(shingle_set(text.as_py(), width))
                held += len(sets[-1])
                if held >= PIECE:
                    yield counted(sets)
                    sets, held = [], 0
        if sets:
            yield counted(sets)

    return run


def frequent_map(docs: DataFrame, width: int) -> np.ndarray:
    """The map of frequent shingles of docs(text), 2**MAP_BITS bits: those of HOT documents or more, or of twice, four times
    ... as many, where else there were more than MOST_HOT. What reaches the driver is bounded by these two parameters."""
    counts = docs.select("text").mapInArrow(_counts(width), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(F.col("n") >= HOT), "frequent")
    levels = counts.groupBy(F.floor(F.log2(F.col("n") / HOT)).alias("level")).count().collect()  # 64 at most
    least, held = HOT, 0
    for level, n in sorted(((r.level, r["count"]) for r in levels), reverse=True):
        held += n
        if held > MOST_HOT:
            least = HOT * 2 ** (level + 1)
            break
    place = F.shiftrightunsigned("shingle", 64 - MAP_BITS)
    words = counts.where(F.col("n") >= least).select(F.floor(place / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(shingle, {64 - MAP_BITS}), 64) as int))").alias("bit"))
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for word, bits in words.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).collect():
        out[word] = bits
    return out.view(_U)


def prefix_length(n: int, percent: int) -> int:
    """How many first elements of a set of n can't all be missing from a set that is percent / 100 similar."""
    return n - -(-percent * n // 100) + 1


def _sketches(width: int, percent: int, frequent: np.ndarray):
    salts = [int(x) for x in mix(np.arange(1, ORDERS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, rank, marks, more, keys = [], [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py(), width)
                n = len(s)
                size.append(n)
                digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                if not n:
                    rank.append(0)
                    marks.append(b"")
                    more.append(b"")
                    keys.append([])
                    continue
                at = s >> _U(64 - MAP_BITS)
                hot = (frequent[at >> _U(6)] >> (at & _U(63))) & _U(1)
                rank.append(int(1_000_000 * int(hot.sum()) / n))
                first = prefix_length(n, percent)
                prefixes = [np.sort(np.partition((hot << _U(63)) | (mix(s ^ _U(salt)) >> _U(1)), first - 1)[:first]) for salt in salts]
                bits = max(PARITY, 1 << (n - 1).bit_length())
                parity = np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool))
                marks.append(parity.tobytes())
                more.append(b"".join((p >> _U(31)).astype(np.uint32).tobytes() for p in prefixes[1:]))
                keys.append(prefixes[0].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(rank, pa.int64()), pa.array(marks, pa.binary()), pa.array(more, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "digest", "rank", "mark", "more", "keys"],
            )

    return run


class _Orders:
    """Screens: first the parity maps, which differ in no more places than the sets do, then the prefixes of the further orders. `more` has
    these, 4 bytes an element: two that agree in them pass for one, which lets a pair through and loses none."""

    again = True

    def __init__(self, percent: int):
        self.percent = percent

    def _few(self, differ: np.ndarray, both: np.ndarray) -> np.ndarray:
        # 100 * common >= percent * union is (100 + percent) * (elements of one set alone) <= (100 - percent) * both
        return (100 + self.percent) * differ <= (100 - self.percent) * both

    @staticmethod
    def _folded(marks: list[bytes], size: int) -> np.ndarray:
        """Maps as rows of `size` bytes; a longer map is folded, which gives the shorter map of the same set."""
        out = np.empty((len(marks), size // 8), _U)
        for k, m in enumerate(marks):
            out[k] = np.bitwise_xor.reduce(np.frombuffer(m, _U).reshape(-1, size // 8), axis=0)
        return out

    def pairs(self, a, b, n_a, n_b):
        size = np.minimum([len(x) for x in a], [len(x) for x in b])
        ok = np.zeros(len(a), bool)
        for one in np.unique(size):
            at = np.flatnonzero(size == one)
            differ = np.bitwise_count(self._folded([a[k] for k in at], one) ^ self._folded([b[k] for k in at], one)).sum(axis=1, dtype=np.int64)
            ok[at] = self._few(differ, n_a[at] + n_b[at])
        return ok

    def block(self, marks, n, here):
        sizes = np.array([len(m) for m in marks])
        # For every size the rows that have it or a larger one, folded to it.
        tables = {one: (np.cumsum(sizes >= one) - 1, self._folded([m for m in marks if len(m) >= one], one)) for one in np.unique(sizes)}

        def passing(k, at):
            kept = []
            for one in np.unique(np.minimum(sizes[at], sizes[k])):
                part = at[np.minimum(sizes[at], sizes[k]) == one]
                row, table = tables[one]
                differ = np.bitwise_count(table[row[part]] ^ table[row[k]]).sum(axis=1, dtype=np.int64)
                kept.append(part[self._few(differ, n[part] + n[k])])
            return np.sort(np.concatenate(kept))

        return passing

    @staticmethod
    def meet(a, b):
        one, two = (np.frombuffer(x, np.uint32).reshape(ORDERS - 1, -1) for x in (a, b))
        return all(np.isin(x, y).any() for x, y in zip(one, two, strict=True))

    @staticmethod
    def first(a, b, here):
        common = np.intersect1d(a, b, assume_unique=True)
        return len(common) > 0 and bool((here == common[0]).any())


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their sets of width-word shingles.

    Returns a row per row of docs: doc_id, n_shingles (size of the set), component_id (least id reachable). Every link counts:
    there is no probability of a miss. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A text of fewer than `width` words
    is one shingle. Null and empty texts, and texts of white space, have no shingle and are linked with nothing. Repeated rows
    are returned as often as they come, all in the component of their id (where one id has several texts, the set of any one
    of them may stand for it in a link). Rows without an id are linked with nothing and have a null component_id. Empty tables
    give empty results. Further columns are ignored. Shingles are compared by 64-bit numbers (see shingles.py), equal sets by
    a 128-bit digest; links between different sets are checked on the full sets. percent is from 1 to 100, else ValueError.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n long, digest binary, rank long, mark binary, more binary, keys array<long>"
    sketch = materialise(own.mapInArrow(_sketches(width, percent, frequent_map(own, width)), schema), "prefixes")
    known = sketch.where("id is not null and n > 0").groupBy("n", "digest")
    classes = known.agg(F.min_by(F.struct("rank", "mark", "more", "keys"), "id").alias("s"), F.min("id").alias("id"))
    classes = materialise(classes.select("n", "digest", "id", "s.rank", "s.mark", "s.more", "s.keys"), "classes")
    final = linked_components(classes, own, width, percent, _Orders(percent))
    answer = classes.select("n", "digest", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("n", "digest", F.coalesce("component", "id").alias("component_id"))
    out = sketch.select("id", "n", "digest").join(materialise(answer, "answer"), ["n", "digest"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
