"""Exact duplicates by a log-structured merge index of text digests, in DataFrame operations only.

A flush cuts a batch into memtables by a hash of the entry (so a row's memtable is the same in every job, however files are
cut into tasks) and writes each as a run: sorted by digest within its files, with Parquet's Bloom filters and row-group ranges on the digest, so that a later look-up skips files
and pages without a hit. Runs belong to levels. When a level has FANOUT runs, compaction merges them into one run of the
next level, with the entry that stays and the count of each digest, and drops what it merged; a new batch never
rewrites the older levels until they are due. Merging pre-aggregates in each task, so a digest with a third of all rows
is a handful of rows when it is shuffled. Hits (groups of two or more) are then verified byte by byte against the text
of the entry that stays. A batch that comes later looks its digests up and meets only entries with these digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_folder, materialise, shared_folder, squeeze

#: Runs of a level that are merged into one of the next; rows of a memtable, and memtables of a batch at most (each is a job;
#: beyond that many, memtables are larger).
FANOUT, MEMTABLE_ROWS, MOST_MEMTABLES = 4, 60_000, 16
_ENTRY = "digest binary, doc_id long, points long, n long"


def _best() -> Column:
    """Of equal texts one with an id stays before any without, then the one with the most code points, then the smallest id."""
    return F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("points"), (-F.col("doc_id")).alias("minus")))


class DigestIndex:
    """Sorted runs of (digest, doc_id, points, n) in levels; points: code points of the original text, n: rows it stands
    for. A folder has a subfolder for each run; the object knows which runs are live, so a lost job leaves only
    unreferenced folders."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    def _write(self, entries: DataFrame, level: int) -> str:
        path = f"{self.folder}/level={level}/run={uuid.uuid4().hex}"
        rows = entries.selectExpr("digest", "cast(doc_id as long) as doc_id", "cast(points as long) as points", "cast(n as long) as n").sortWithinPartitions("digest")
        rows.write.option("parquet.bloom.filter.enabled#digest", "true").option("compression", "zstd").parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        return path

    def flush(self, entries: DataFrame) -> str:
        """Writes a batch of entries as one sorted run of level 0 and merges the levels that are full."""
        path = self._write(entries if "n" in entries.columns else entries.withColumn("n", F.lit(1)), 0)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= FANOUT:
                self.merge(level)
            level += 1
        return path

    def merge(self, level: int) -> None:
        """Merges all runs of a level into one of the next, and deletes them when that is written."""
        old = self.levels[level]
        self._write(self._merged(self._read(old)), level + 1)
        self.levels[level] = []
        for path in old:
            drop_folder(self.spark, path)

    @staticmethod
    def _merged(entries: DataFrame) -> DataFrame:
        merged = entries.groupBy("digest").agg(_best().alias("best"), F.sum("n").alias("n"))
        return merged.select("digest", (-F.col("best.minus")).alias("doc_id"), "best.points", "n")

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], _ENTRY)

    def entries(self) -> DataFrame:
        """All entries of all live runs."""
        return self._read([p for level in self.levels for p in level])

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """The entries with one of the digests; ranges and Bloom filters of the runs rule files and pages out."""
        return self.entries().where(F.col("digest").isin([bytearray(d) for d in digests]))

    def known(self, batch: DataFrame) -> DataFrame:
        """(digest, doc_id, points, n) of the digests of batch(digest) that the index has; the runs' entries are filtered
        by the batch's digests before they are merged."""
        return self._merged(self.entries().join(batch.select("digest").distinct(), "digest", "left_semi"))

    def compact(self) -> DataFrame:
        """(digest, keep_id, group_size) over all runs: most code points first, then the smallest identifier."""
        merged = self._merged(self.entries())
        return materialise(merged.select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size")), "compacted")


def flush_in_memtables(index: DigestIndex, entries: DataFrame, rows: int) -> None:
    """Flushes entries (digest, doc_id, points) as runs of about MEMTABLE_ROWS rows, MOST_MEMTABLES at most."""
    tables = max(1, min(MOST_MEMTABLES, -(-rows // MEMTABLE_ROWS)))
    memtable = F.pmod(F.xxhash64("doc_id", "digest", "points"), F.lit(tables))
    for k in range(tables):
        index.flush(entries.where(memtable == k))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose texts are equal without any character of [\\x20\\x09-\\x0D].

    Returns a row per row of docs: doc_id, keep_id (of the row that stays: most code points in the original text, then
    smallest doc_id), group_size (rows), kept, text_sha256 (of the text without white space). Null counts as empty, and
    all empty texts are one group. Repeated rows count in group_size and are all kept if their doc_id is. A row without
    an id never stays while its group has an id; a group without any has a null keep_id and all its rows are kept. Empty tables give empty results. Further columns are ignored.
    """
    bare = squeeze(F.col(text_col).cast("string"))
    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), bare.alias("bare"), F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("points"))
    index = DigestIndex(docs.sparkSession)
    digests = materialise(full.select("doc_id", F.unhex(F.sha2("bare", 256)).alias("digest"), "points"), "digests")
    flush_in_memtables(index, digests, digests.count())
    compacted = index.compact()

    # Byte verification: a document's text against the text of the entry that stays, in groups of two or more.
    hits = compacted.where("group_size > 1")
    texts = full.withColumn("digest", F.unhex(F.sha2("bare", 256))).select("digest", "doc_id", "points", "bare")
    held = texts.join(hits.select("digest", "keep_id"), "digest", "left_semi")
    marked = materialise(held, "hits")
    keepers = marked.join(hits.select("digest", F.col("keep_id").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"])
    keepers = materialise(keepers.select("digest", F.col("bare").alias("other")), "keepers")
    odd = materialise(marked.join(keepers, "digest").where("bare <> other").select("digest", "doc_id", "points", "bare"), "odd")

    found = digests.join(compacted, "digest").select("doc_id", "digest", "points", "keep_id", "group_size")
    out = found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if odd.isEmpty():
        return out
    return _regrouped(texts, odd)


def _regrouped(texts: DataFrame, odd: DataFrame) -> DataFrame:
    """The same result when texts of one digest differ: there the text itself is part of the key."""
    bad = odd.select("digest").distinct()
    marked = texts.join(bad.withColumn("bad", F.lit(True)), "digest", "left")
    marked = materialise(marked.select("doc_id", "digest", "points", F.when(F.col("bad"), F.col("bare")).alias("exact")), "regrouped")
    groups = marked.groupBy("digest", "exact").agg(_best().alias("best"), F.count("*").alias("group_size"))
    groups = materialise(groups.select("digest", "exact", (-F.col("best.minus")).alias("keep_id"), "group_size"), "groups")
    one, two = marked.alias("m"), groups.alias("g")
    found = one.join(two, (F.col("m.digest") == F.col("g.digest")) & F.col("m.exact").eqNullSafe(F.col("g.exact")))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("m.digest")).alias("text_sha256"))
