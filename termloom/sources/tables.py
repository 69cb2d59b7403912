"""Sources: keyword files with unknown headers, dictionaries, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header names that stand for each column of the keyword frame.
SYNONYMS = {"keyword": ("keyword", "query", "phrase", "ключ", "запрос", "фраза"), "frequency_world": ("frequency_world", "world", "frequency", "частота"), "frequency_exact": ("frequency_exact", "exact", "!частота", "точная")}


def read_keywords(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """A keyword file as keyword, frequency_world, frequency_exact. Headers match synonyms after trimming; spaces, commas
    and dots in numbers go; missing or unreadable numbers are 0; without a known keyword column the first one is taken."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding)
    plain = {c.strip(' "﻿').lower(): c for c in raw.columns}
    found = {name: next((plain[s] for s in names if s in plain), None) for name, names in SYNONYMS.items()}
    key = found["keyword"] or raw.columns[0]
    number = lambda c: F.coalesce(F.regexp_replace(F.col(f"`{c}`"), r"[\s,.]", "").try_cast("bigint"), F.lit(0)) if c else F.lit(0).cast("bigint")
    return raw.select(F.col(f"`{key}`").alias("keyword"), number(found["frequency_world"]).alias("frequency_world"), number(found["frequency_exact"]).alias("frequency_exact"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The distinct lower-case lines of a text file, without blanks and byte-order marks."""
    line = F.lower(F.trim(F.regexp_replace("value", "^﻿", "")))
    return spark.read.text(path).select(line.alias("word")).where("word <> ''").distinct()


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """name:weight lines; # starts a comment."""
    bare = F.trim(F.regexp_replace("value", "#.*$", ""))
    parts = spark.read.text(path).select(F.split(bare, ":").alias("p")).where("size(p) = 2")
    return parts.select(F.trim(F.col("p")[0]).alias("name"), F.trim(F.col("p")[1]).try_cast("double").alias("weight")).where("weight is not null")


def write_keywords(df: DataFrame, path: str) -> None:
    """A quoted, semicolon-separated export; arrays are joined by commas."""
    joined = [F.array_join(F.col(c).cast("array<string>"), ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*joined).write.csv(path, sep=";", header=True, quoteAll=True)


def cluster_json(df: DataFrame) -> DataFrame:
    """One JSON object per cluster with its keywords, without null fields."""
    rows = df.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "cluster_id"]))).alias("keywords"))
    return rows.select("cluster_id", F.to_json(F.struct("cluster_id", "keywords"), {"ignoreNullFields": "true"}).alias("json"))
