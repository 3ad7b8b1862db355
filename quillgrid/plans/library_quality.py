"""Queries over a library's tables that test its integrity: p3, p4, p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import hierarchy, nested, orphans
from quillgrid.sources.tables import table


def _library(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in ("papers", "figures", "tables_index", "files")]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.found(*_library(spark, folder))


def p3_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.monthly(*_library(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.found(table(spark, folder, "ir_documents"))


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_documents(table(spark, folder, "ir_documents"), "record_id", "doc_json")


def p4_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return nested.blocks(_flat(spark, folder), "record_id")


def p4_cells(spark: SparkSession, folder: str) -> DataFrame:
    return nested.cells(_flat(spark, folder), "record_id")


def p4_inlines(spark: SparkSession, folder: str) -> DataFrame:
    return nested.inlines(_flat(spark, folder), "record_id")


def _trees(spark: SparkSession, folder: str, paths: bool = True) -> hierarchy.Hierarchy:
    rows = table(spark, folder, "sections")
    return hierarchy.build_hierarchy(hierarchy.links(rows, "paper_key", "section_id", "parent_id", "ordinal"), paths=paths)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _trees(spark, folder, paths=False).spoilt.select(F.col("tree").alias("paper_key"), F.col("node").alias("section_id"))


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _trees(spark, folder).nodes.select(
        F.col("tree").alias("paper_key"),
        F.col("node").alias("section_id"),
        F.col("root").alias("root_id"),
        F.col("depth").cast("bigint").alias("depth"),
        F.array_join("path", "/").alias("path"),
    )


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendant_counts(_trees(spark, folder).nodes).select(
        F.col("tree").alias("paper_key"),
        F.col("node").alias("section_id"),
        F.col("n_descendants"),
        F.col("height").cast("bigint").alias("height"),
    )


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every section with each of its descendants."""
    return hierarchy.ancestor_pairs(_trees(spark, folder).nodes).select(
        F.col("tree").alias("paper_key"),
        F.col("ancestor").alias("section_id"),
        F.col("descendant").alias("descendant_id"),
        F.col("distance").cast("bigint").alias("distance"),
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_monthly": p3_monthly,
    "p4_found": p4_found,
    "p4_blocks": p4_blocks,
    "p4_cells": p4_cells,
    "p4_inlines": p4_inlines,
    "p5_found": p5_found,
    "p5_paths": p5_paths,
    "p5_descendants": p5_descendants,
    "p5_pairs": p5_pairs,
}

_ORPHANS = r"""
WITH newest AS (
  SELECT lower(regexp_replace(key, '^\s+|\s+$', '', 'g')) AS k, arg_max(coalesce(status, ''), (updated_at, created_at, status)) AS status
  FROM papers WHERE key IS NOT NULL GROUP BY 1),
live AS (SELECT k FROM newest WHERE status <> 'dropped'),
named AS (
  SELECT 'figures' AS ref_table, 'paper_key' AS ref_field, nullif(lower(regexp_replace(paper_key, '^\s+|\s+$', '', 'g')), '') AS paper_key, id AS item_id, indexed_at FROM figures
  UNION ALL SELECT 'tables_index', 'paper_key', nullif(lower(regexp_replace(paper_key, '^\s+|\s+$', '', 'g')), ''), id, indexed_at FROM tables_index
  UNION ALL SELECT 'files', 'paper_key', nullif(lower(regexp_replace(paper_key, '^\s+|\s+$', '', 'g')), ''), rel_path, indexed_at FROM files),
places AS (
  SELECT nullif(lower(regexp_replace(paper_key, '^\s+|\s+$', '', 'g')), '') AS paper_key, id AS item_id, indexed_at,
    array_to_string(list_filter(string_split(replace(regexp_replace(crop_path, '^\s+|\s+$', '', 'g'), '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS path
  FROM figures),
present AS (
  SELECT nullif(lower(regexp_replace(paper_key, '^\s+|\s+$', '', 'g')), '') AS paper_key,
    array_to_string(list_filter(string_split(replace(regexp_replace(rel_path, '^\s+|\s+$', '', 'g'), '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS path
  FROM files),
orphans AS (
  SELECT * FROM named WHERE paper_key IS NOT NULL AND paper_key NOT IN (SELECT k FROM live)
  UNION ALL
  SELECT 'figures', 'crop_path', paper_key, item_id, indexed_at FROM places p
  WHERE path <> '' AND paper_key IN (SELECT k FROM live)
    AND NOT EXISTS (SELECT 1 FROM present f WHERE f.paper_key = p.paper_key AND f.path = p.path))
"""

_TREES = """
WITH RECURSIVE one AS (
  SELECT paper_key, section_id, max(struct_pack(o := coalesce(ordinal, -1), p := coalesce(parent_id, ''))).p AS parent
  FROM sections WHERE section_id IS NOT NULL GROUP BY 1, 2),
linked AS (
  SELECT a.paper_key, a.section_id, b.section_id AS parent FROM one a
  LEFT JOIN one b ON a.paper_key = b.paper_key AND a.parent = b.section_id AND a.parent <> ''),
walk AS (
  SELECT paper_key, section_id, section_id AS root_id, 0::BIGINT AS depth, section_id::VARCHAR AS path, [section_id] AS steps
  FROM linked WHERE parent IS NULL
  UNION ALL
  SELECT l.paper_key, l.section_id, w.root_id, w.depth + 1, w.path || '/' || l.section_id, list_append(w.steps, l.section_id)
  FROM walk w JOIN linked l ON l.paper_key = w.paper_key AND l.parent = w.section_id)
"""

ORACLE = {
    "p3_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_field, paper_key, item_id FROM orphans",
    "p3_monthly": _ORPHANS
    + """SELECT ref_table, ref_field, strftime(indexed_at, '%Y-%m') AS month, count(*) AS n_rows,
      count(DISTINCT paper_key || '/' || coalesce(item_id, '')) AS n_items FROM orphans GROUP BY 1, 2, 3""",
    "p5_found": _TREES
    + "SELECT paper_key, section_id FROM linked EXCEPT SELECT paper_key, section_id FROM walk",
    "p5_paths": _TREES + "SELECT paper_key, section_id, root_id, depth, path FROM walk",
    "p5_pairs": _TREES
    + """SELECT paper_key, steps[i] AS section_id, section_id AS descendant_id, depth - (i - 1) AS distance
      FROM (SELECT paper_key, section_id, steps, depth, unnest(range(1, depth + 1)) AS i FROM walk WHERE depth > 0)""",
    "p5_descendants": _TREES
    + """SELECT paper_key, steps[i] AS section_id, count(*) AS n_descendants, max(depth - (i - 1)) AS height
      FROM (SELECT paper_key, steps, depth, unnest(range(1, depth + 1)) AS i FROM walk WHERE depth > 0) GROUP BY 1, 2""",
}
