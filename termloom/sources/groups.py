"""Keyword files by group, dictionaries and aliases. Files are listed and opened by Spark's own file layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_dictionary

# The encodings and separators that are tried, in order; look-alike letters; dictionary files with flag and weight.
ENCODINGS, SEPARATORS = ("UTF-8", "windows-1251"), (";", ",", "\t")
LATIN, CYRILLIC = "aceopxyACEOPXY", "асеорхуАСЕОРХУ"
GEO_FILES = {"Russian": "Russian.txt", "Moscow": "Moscow.txt", "Kazakhstan": "Kazakhstan.txt", "Belarus": "Belarus.txt", "Ukraine": "Ukraine.txt", "Country": "Country.txt"}


def _files(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(path) if f.isFile()) if fs.exists(path) else []


def read_csv_trying(spark: SparkSession, path: str, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """A headed CSV file in the first encoding and separator that give more than one column; a byte-order mark goes. An
    absent file is an empty frame; where nothing fits, ValueError. Only the head is read to decide."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "keyword string")
    head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("c")).first()["c"])
    head = head[: head.rfind(b"\n") + 1] or head
    for encoding in ENCODINGS:
        try:
            line = head.decode(encoding).lstrip("﻿").splitlines()[0]
        except (UnicodeDecodeError, IndexError):
            continue
        for sep in separators:
            if sep in line:
                return _read(spark, path, sep, encoding)
    raise ValueError(f"no encoding and separator fit {path}")


def _read(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """Spark reads UTF-8 itself; a one-byte code is read byte by byte as Latin-1 and then mapped to its own letters."""
    if encoding == "UTF-8":
        raw = spark.read.csv(path, header=True, sep=sep)
        return raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    raw = spark.read.csv(path, header=True, sep=sep, encoding="ISO-8859-1")
    high = bytes(range(128, 256))
    names = [c.encode("latin-1").decode(encoding, "replace").strip() for c in raw.columns]
    return raw.select(*[F.translate(F.col(f"`{c}`"), high.decode("latin-1"), high.decode(encoding, "replace")).alias(n) for c, n in zip(raw.columns, names, strict=True)])


def discover_groups(spark: SparkSession, folder: str) -> dict[str, str]:
    """Group name to CSV file: names are the files' without their ending; backups and hidden or temporary files go."""
    out = {}
    for path in _files(spark, folder):
        name = path.rsplit("/", 1)[-1]
        if name.endswith(".csv") and not name.startswith(("~", ".")) and not name[:-4].endswith("_backup"):
            out[name[:-4]] = path
    return out


def find_group(groups: dict[str, str], name: str, fuzzy: bool = True) -> str | None:
    """The path of a group: by its name, then in any case, then with Latin look-alikes as Cyrillic letters."""
    tries = [name, name.translate(str.maketrans(LATIN, CYRILLIC))] if fuzzy else [name]
    for wanted in dict.fromkeys(tries):
        if wanted in groups:
            return groups[wanted]
        if fuzzy and (found := next((p for n, p in groups.items() if n.lower() == wanted.lower()), None)):
            return found
    return None


def load_queries(spark: SparkSession, groups: dict[str, str], name: str) -> DataFrame:
    """A group's file, commas tried first, with the group's name as query_group. KeyError for an unknown group."""
    path = find_group(groups, name)
    if path is None:
        raise KeyError(name)
    return read_csv_trying(spark, path, (",", ";", "\t")).withColumn("query_group", F.lit(name))


def load_dictionaries(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame:
    """(dict_name, word) of all the dictionary files (name to file) that are there."""
    have = {p.rsplit("/", 1)[-1]: p for p in _files(spark, folder)}
    out = spark.createDataFrame([], "dict_name string, word string")
    for name, file in files.items():
        if file in have:
            out = out.unionByName(read_dictionary(spark, have[file]).select(F.lit(name).alias("dict_name"), "word"))
    return out


def load_city_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(short, full) of <alias short="" full=""/> elements."""
    line = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"<alias\b[^>]*>"), F.lit(0))).alias("tag"))
    value = lambda name: F.regexp_extract("tag", rf'\b{name}\s*=\s*"([^"]*)"', 1)
    return line.select(value("short").alias("short"), value("full").alias("full")).where("short <> '' and full <> ''").distinct()


def load_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain) lines in lower case, without comments, counts in brackets, scheme and www."""
    bare = F.lower(F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s*\(\d+\)\s*$", "")))
    return spark.read.text(path).select(F.regexp_replace(F.regexp_replace(bare, "^https?://", ""), r"^www\.", "").alias("domain")).where("domain <> ''").distinct()


def load_minus_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) lines that are neither blank nor comments, without a leading minus."""
    bare = F.trim("value")
    return spark.read.text(path).where(~bare.startswith("#")).select(F.regexp_replace(F.lower(bare), "^-", "").alias("word")).where("word <> ''").distinct()

