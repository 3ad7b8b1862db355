"""Items of a reference manager, as its JSON export stores them, to papers that can be had."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.urls import DOI_PREFIX, none_if_empty, trimmed

ITEM = """struct<key:string,data:struct<key:string,itemType:string,title:string,DOI:string,url:string,extra:string,archiveID:string,archive:string,
  publicationTitle:string,repository:string,collections:array<string>,tags:array<struct<tag:string>>>>"""
# Kinds of items that are no works.
NO_WORKS = ["annotation", "attachment", "note"]


def read_items(items: DataFrame, json: str, order: str, names: dict[str, str] | None = None, collection: str | None = None, tag: str | None = None) -> DataFrame:
    """(key, title, url, collections, tags, reason, ord) of stored items; ``reason`` is set where no address can be had.

    The address is the DOI's, else that of an arXiv id or a DOI in the item's free fields, else the item's own. Of several items with one
    address the first in ``order`` stays. ``names`` maps collection keys to names; an unknown key stands for itself.
    Items without a title, notes and attachments are left out, as is what can't be read.
    """
    parsed = items.select(F.from_json(json, ITEM).alias("i"), F.col(order).alias("ord"))
    d = lambda f: none_if_empty(trimmed(F.col(f"i.data.{f}")))
    free = F.concat_ws(" ", *[d(f) for f in ("extra", "archiveID", "publicationTitle", "repository", "url", "archive")])
    arxiv = none_if_empty(F.regexp_extract(free, r"(?i)arxiv(?:[.]org/(?:abs|pdf)/|[:\s]+)(\d{4}[.]\d{4}\d?|[a-z-]+(?:[.][a-z]{2})?/\d{7})", 1))
    doi = none_if_empty(F.regexp_replace(F.regexp_extract(free, rf"({DOI_PREFIX}[^\s\"<>]+)", 1), r"[.,;)]+$", ""))
    url = F.coalesce(
        F.concat(F.lit("https://doi.org/"), F.regexp_replace(d("DOI"), "^https://doi[.]org/", "")),
        F.concat(F.lit("https://arxiv.org/abs/"), arxiv),
        F.concat(F.lit("https://doi.org/"), doi),
        d("url"),
    )
    table = F.create_map(*[F.lit(x) for pair in (names or {"": ""}).items() for x in pair])
    rows = parsed.where(d("title").isNotNull() & ~F.coalesce(F.col("i.data.itemType"), F.lit("")).isin(NO_WORKS)).select(
        F.coalesce(F.col("i.data.key"), F.col("i.key"), F.lit("")).alias("key"),
        d("title").alias("title"),
        url.alias("url"),
        F.transform(F.coalesce("i.data.collections", F.array().cast("array<string>")), lambda c: F.coalesce(F.try_element_at(table, c), c)).alias("collections"),
        F.filter(F.transform(F.coalesce(F.col("i.data.tags"), F.array().cast("array<struct<tag:string>>")), lambda t: t["tag"]), lambda t: t.isNotNull()).alias("tags"),
        "ord",
    )
    if collection:
        rows = rows.where(F.exists("collections", lambda c: F.lower(c) == collection.lower()))
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    w = Window.partitionBy(F.coalesce("url", F.concat(F.lit("item:"), F.col("ord").cast("string")))).orderBy("ord")
    once = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return once.withColumn("reason", F.when(F.col("url").isNull(), "no DOI, arXiv id or URL"))
