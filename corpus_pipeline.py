"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) that returns a DataFrame.

Each stage's result is written as Parquet and read again as the next one's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import materialise, table
from termloom.llm.exactdedup import exact_dedup
from termloom.llm.minhash import near_dedup
from termloom.llm.packing import pack
from termloom.llm.secrets import redact, trained
from termloom.llm.toxicity import fit, held_out, score_column


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model, fitted to the labels outside the held-out fifth, calls toxic."""
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return docs.where(score_column(F.col("text"), model) < 0.5)


def _without(docs: DataFrame, deduplicate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that a deduplication drops. Where ids are repeated or null, it decides on rows that are
    numbered by id (null last) and text instead; of rows with the same id and text one stays."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        dropped = materialise(deduplicate(docs).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    one = materialise(docs.groupBy("doc_id", digest.alias("digest")).agg(F.max(F.struct(*docs.columns)).alias("row")), "rows")
    ordered = one.select("doc_id", "digest").orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    numbered = docs.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), "id long, other string, number long")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("other"))
    rows = materialise(one.join(numbered, same).select("number", "row"), "numbered")
    kept = materialise(deduplicate(rows.select(F.col("number").alias("doc_id"), "row.text")).where("kept").select(F.col("doc_id").alias("number")), "kept")
    return rows.join(kept, "number", "left_semi").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return _without(docs, exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates: five words, similarity 0.8."""
    return _without(docs, lambda rows: near_dedup(rows, width=5, percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    clean = redact(docs, trained(spark, docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; the last stage's rows are pieces."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end=0)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("packing", packing)]

#: SQL can't express the fitted stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
