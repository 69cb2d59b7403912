"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the ASCII controls 9 to 13.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (local runs)."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(spark.sparkContext, "_termloom_shared", None) or tempfile.mkdtemp(prefix="termloom-")
        spark.sparkContext._termloom_shared = folder
    return folder.rstrip("/")


def materialise(df: DataFrame, tag: str, partition_by: tuple[str, ...] = (), **options: int) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and a lost executor costs no rerun.
    options: further ones of the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.options(compression="zstd", **options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(df_spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer."""
    jvm = df_spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df_spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def squeeze(text: Column) -> Column:
    """The text without any character of SPACES; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
