"""Nested category trees in JSON as rows: one round for each depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

_ITEM = "array<struct<level:int,type:string,name:string,slug:string,clusters:array<string>,children:string>>"


def flatten_hierarchy(rows: DataFrame, key: str = "cluster_id", json: str = "hierarchy", separator: str = " > ") -> DataFrame:
    """(key, place, depth, level, type, name, slug, clusters, path) of rows(key, json): a row for every item of the document's `hierarchy`
    list and of the items' `children`, at any depth. place has an item's position on each depth, so that ordering by it gives the tree's
    own order; path joins the names from the top. A missing level is 1, a missing name or slug ''. Documents that are null, no JSON or
    without the list give no row, and children that are no list none either. The text is finite, so there are no cycles; a round for each
    depth keeps a level of the trees as rows, never a whole tree."""
    items = F.from_json(F.get_json_object(F.col(json), "$.hierarchy"), _ITEM)
    left = rows.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("place"), F.lit(None).cast("string").alias("path"), items.alias("items"))
    parts = []
    while True:
        each = left.select("key", "place", "path", F.posexplode("items").alias("at", "item")).where("item is not null")
        name = F.coalesce("item.name", F.lit(""))
        each = checkpointed(each.select("key", F.array_append("place", F.col("at")).alias("place"), F.when(F.coalesce("path", F.lit("")) == "", name).otherwise(F.concat("path", F.lit(separator), name)).alias("path"), "item"))
        if each.isEmpty():
            break
        parts.append(each)
        left = each.where("item.children is not null").select("key", "place", "path", F.from_json("item.children", _ITEM).alias("items"))
    out = each
    for part in parts:
        out = out.unionByName(part)
    empty = F.lit("")
    return out.select(F.col("key").alias(key), "place", F.size("place").alias("depth"), F.coalesce("item.level", F.lit(1)).alias("level"), "item.type", F.coalesce("item.name", empty).alias("name"), F.coalesce("item.slug", empty).alias("slug"), "item.clusters", "path")


def hierarchy_report(rows: DataFrame, key: str = "cluster_id", json: str = "hierarchy", context: str | None = "context", titles: tuple[str, str] = ("РЕКОМЕНДАЦИИ", "SEO ЗАМЕТКИ")) -> DataFrame:
    """(key, context, part, place, level, name, slug, path): the tree's rows (part 0), then a row with the document's `recommendations`, a line each
    (part 1), and one with its `seo_notes` (part 2), where it has them; level is null in those."""
    said = F.col(context).cast("string") if context else F.lit("")
    own = rows.select(F.col(key).alias("key"), F.coalesce(said, F.lit("")).alias("context"), F.col(json).alias("doc"))
    tree = flatten_hierarchy(own.select("key", "doc"), "key", "doc").join(own.select("key", "context"), "key")
    tree = tree.select("key", "context", F.lit(0).alias("part"), "place", "level", "name", "slug", "path")
    advice = F.array_join(F.from_json(F.get_json_object("doc", "$.recommendations"), "array<string>"), "\n")
    notes = F.get_json_object("doc", "$.seo_notes")
    none = F.array().cast("array<int>"), F.lit(None).cast("int")
    for part, (text, title) in enumerate(zip((advice, notes), titles, strict=True), 1):
        extra = own.select("key", "context", F.lit(part).alias("part"), none[0].alias("place"), none[1].alias("level"), F.lit(title).alias("name"), F.lit("").alias("slug"), text.alias("path"))
        tree = tree.unionByName(extra.where("path <> ''"))
    return tree.withColumnRenamed("key", key)
