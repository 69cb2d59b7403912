"""Places of queries: a dictionary of cities, their forms and aliases, met by equality joins on word sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lists import small

#: A word may have hyphens inside, as in the names of some cities.
WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"


def place_forms(cities: DataFrame, forms: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(form, base, priority, words): every spelling that names a place. cities(city, priority): the names, of which the least priority
    asks first; forms(city, form): inflected forms; aliases(short, full): short names, which count only where `full` is a city or a
    form of one. All in lower case. A spelling that names several places stands for the one of the least priority, then name."""
    names = cities.select(F.lower(F.trim("city")).alias("base"), F.col("priority").cast("int").alias("priority")).where("base <> ''").groupBy("base").agg(F.min("priority").alias("priority"))
    spelled = names.select(F.col("base").alias("form"), "base", "priority")
    if forms is not None:
        spelled = spelled.unionByName(forms.select(F.lower(F.trim("city")).alias("base"), F.lower(F.trim("form")).alias("form")).join(names, "base").select("form", "base", "priority"))
    if aliases is not None:
        short = aliases.select(F.lower(F.trim("short")).alias("short"), F.lower(F.trim("full")).alias("form"))
        spelled = spelled.unionByName(short.join(spelled, "form").select(F.col("short").alias("form"), "base", "priority"))
    best = spelled.where("form is not null and form <> ''").groupBy("form").agg(F.min(F.struct("priority", "base")).alias("b"))
    return best.select("form", "b.base", "b.priority", F.size(F.regexp_extract_all("form", F.lit(WORD), F.lit(0))).alias("words"))


def resolve_places(rows: DataFrame, known: DataFrame, key: str = "row_id", keyword: str = "keyword") -> DataFrame:
    """(key, place) of every row: known is place_forms' result. Of the spellings among the keyword's word sequences the one of the least
    priority counts, then the first in the keyword, then the longest; null without one. Words are compared in lower case. A join by
    equality, a broadcast only if the dictionary is small, so that millions of spellings work as well."""
    most = known.agg(F.max("words")).first()[0] or 0
    joined = F.array_join(F.regexp_extract_all("form", F.lit(WORD), F.lit(0)), " ").alias("form")
    dictionary = small(known.select(joined, "base", "priority").groupBy("form").agg(F.min(F.struct("priority", "base")).alias("b")).select("form", "b.base", "b.priority"))
    words = rows.select(F.col(key).alias("key"), F.regexp_extract_all(F.lower(keyword), F.lit(WORD), F.lit(0)).alias("w"))
    spans = F.expr(f"flatten(transform(sequence(1, {most}), n -> transform(filter(sequence(1, size(w)), i -> i + n - 1 <= size(w)), i -> named_struct('at', i, 'n', n, 'form', array_join(slice(w, i, n), ' ')))))") if most else None
    if spans is None:
        return rows.select(F.col(key), F.lit(None).cast("string").alias("place"))
    each = words.where(F.size("w") > 0).select("key", F.explode(spans).alias("s")).select("key", "s.at", "s.n", "s.form")
    found = each.join(dictionary, "form").groupBy("key").agg(F.min_by("base", F.struct("priority", "at", (-F.col("n")).alias("n"))).alias("place"))
    return rows.select(F.col(key).alias("key")).join(found, "key", "left").select(F.col("key").alias(key), "place")
