"""MinHash near-duplicates: universal hash minima, banding, signature screen, exact check, star components.

The plan, and why it holds when one group of copies has a third of all rows:

1. One pass over the texts makes a sketch of each document: its set's size and fingerprint, a byte of every minimum,
   and a key per band. Documents with equal sets form a class; only the least doc_id of a class goes on, so exact
   copies never meet each other again.
2. Classes meet in the buckets of the bands, as meetings.py has it: with the bucket's least id, then in blocks those that
   aren't connected yet. Every pair that shares a band is either known to be connected or was compared once.

Bands and screen follow from the threshold (see `banding`): a pair at the threshold shares no band with probability
LOSS at most and fails the screen with about that probability; at 0.8 it is 40 bands of 5 rows (1.3e-7) and a screen
of 0.66 of the 200 minima.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .meetings import linked_components
from .shingles import mix, shingle_set, signature, universal

MINIMA, LOSS, MOST_ROWS = 200, 1e-6, 20
#: Rows of a bucket that one block compares with another.
BLOCK = 1024


def banding(percent: int) -> tuple[int, int, float]:
    """Bands, rows a band, and the least share of equal signature bytes, for links of percent / 100: the most rows with
    which a pair at the threshold shares none of the bands with probability LOSS at most; the screen is 4.95 standard
    deviations below the threshold. Raises ValueError below 8 percent, where MINIMA are too few, and above 100."""
    j = percent / 100
    fit = [r for r in range(1, MOST_ROWS + 1) if j <= 1 and (1 - j**r) ** (MINIMA // r) <= LOSS]
    if not fit:
        raise ValueError(f"no banding of {MINIMA} minima finds pairs of {percent} percent")
    return MINIMA // fit[-1], fit[-1], j - 4.95 * math.sqrt(j * (1 - j) / MINIMA)


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = universal(MINIMA)
        salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            size, digest, sig, keys = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py(), width)
                size.append(len(s))
                digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                if not len(s):
                    sig.append(b"")
                    keys.append([])
                    continue
                minima = signature(s, a, b)
                band, table = salts.copy(), minima[: bands * rows].reshape(bands, rows).astype(np.uint64)
                for k in range(rows):
                    band = mix(band ^ table[:, k])
                keys.append(band.view(np.int64))
                sig.append(minima.astype(np.uint8).tobytes() + band.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "digest", "sig", "keys"],
            )

    return run


class _Signatures:
    """Screen by the share of equal bytes of two signatures. A mark is the signature, then the keys of the bands."""

    again = False  # block sees to the first bucket, and there is no second screen

    def __init__(self, least: float):
        self.least = least

    @staticmethod
    def _tables(marks):
        table = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1)
        return table[:, :MINIMA], np.ascontiguousarray(table[:, MINIMA:]).view(np.int64)

    def pairs(self, a, b, n_a, n_b):
        return (self._tables(a)[0] == self._tables(b)[0]).mean(axis=1) >= self.least

    def block(self, marks, n, here):
        table, keys = self._tables(marks)

        def passing(k, at):
            at = at[(table[at] == table[k]).mean(axis=1) >= self.least]
            if not len(at):
                return at
            same = keys[at] == keys[k]
            return at[same.any(axis=1) & np.isin(keys[k][same.argmax(axis=1)], here[k])]

        return passing

    @staticmethod
    def meet(a, b):
        return True

    @staticmethod
    def first(a, b, here):
        return True


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of width-word shingles have a Jaccard similarity of percent / 100 or more.

    Returns a row per row of docs: doc_id, n_shingles, component_id (least id reachable), kept (doc_id equals it).
    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased. A text of fewer than `width` words is one
    shingle. Null and empty texts, and texts of white space, have no shingle and are linked with nothing. Repeated
    rows are returned as often as they come, all in the component of their id (where one id has several texts, the
    set of any one of them may stand for it). Rows without an id are linked with nothing and kept, with a null
    component_id. Empty tables give empty results. Further columns are ignored. Equal sets are known by a 128-bit BLAKE2b
    digest of the whole sorted set; links between different sets are checked on the full sets.
    """
    bands, band_rows, screen = banding(percent)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialise(own.mapInArrow(_sketches(width, bands, band_rows), "id long, n long, digest binary, sig binary, keys array<long>"), "sketch")
    known = sketch.where("id is not null and n > 0")
    classes = materialise(
        known.groupBy("n", "digest").agg(F.min_by(F.struct("sig", "keys"), "id").alias("s"), F.min("id").alias("id")).select("n", "digest", "id", F.lit(0).alias("rank"), F.col("s.sig").alias("mark"), F.lit(b"").alias("more"), "s.keys"),
        "classes",
    )
    final = linked_components(classes, own, width, percent, _Signatures(screen), BLOCK)

    answer = materialise(
        classes.select("n", "digest", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("n", "digest", F.coalesce("component", "id").alias("component_id")),
        "answer",
    )
    out = sketch.select("id", "n", "digest").join(answer, ["n", "digest"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
