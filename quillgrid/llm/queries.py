"""Registered queries of the subpackage, and their SQL oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import leakage, markup, matching, names, packing, spam, splitting
from quillgrid.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return matching.found(table(spark, folder, "refs"), table(spark, folder, "papers"))


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    return matching.match_references(table(spark, folder, "refs"), table(spark, folder, "papers"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.found(*[table(spark, folder, n) for n in ("blocks", "equations", "ir_documents")])


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    texts = markup.texts_of_library(*[table(spark, folder, n) for n in ("blocks", "equations", "ir_documents")])
    return markup.clean_library(texts)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.found(table(spark, folder, "authors"))


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_names(table(spark, folder, "authors"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.found(table(spark, folder, "blocks"))


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_library(table(spark, folder, "blocks"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_report(p8_containers(spark, folder))


def p8_breaches(spark: SparkSession, folder: str) -> DataFrame:
    """No rows: every document assigned once, no container over a capacity."""
    documents = table(spark, folder, "documents")
    return packing.breaches(documents, packing.pack_documents(documents))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.found(table(spark, folder, "documents"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spam.judge_documents(table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_matches": p1_matches,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p6_found": p6_found,
    "p6_entities": p6_entities,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_breaches": p8_breaches,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
}

ORACLE = {
    "p8_breaches": "SELECT doc_id AS id, text AS breach FROM documents WHERE false",
    "p7_found": """
      WITH once AS (SELECT paper_key, id, any_value(section_id) AS section_id, max(coalesce(length(text), 0)) AS n FROM blocks GROUP BY 1, 2)
      SELECT 'block' AS item_kind, paper_key, id::VARCHAR AS item_id FROM once WHERE n > 2000
      UNION ALL
      SELECT 'section', paper_key, section_id FROM once WHERE section_id IS NOT NULL GROUP BY 2, 3 HAVING sum(n) > 12000""",
}
