"""Sections of documents: parents from heading levels, fill-forward of the current section, outlines, paged reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.urls import trimmed

READ_WINDOW = 8_000


def heading_parents(headings: DataFrame, doc: str, order: str, level: str, node: str, levels: int = 6) -> DataFrame:
    """``parent``: the nearest earlier heading of a smaller level (levels 1 to ``levels``; others are clamped).

    A window per document over its headings alone: for each level the last heading of that level before the row,
    of which the latest with a smaller level counts.
    """
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    clamped = F.least(F.greatest(F.coalesce(F.col(level), F.lit(1)), F.lit(1)), F.lit(levels))
    rows = headings.withColumn("__level", clamped)
    for k in range(1, levels):
        rows = rows.withColumn(f"__p{k}", F.max(F.when(F.col("__level") == k, F.struct(order, node))).over(w))
    candidates = [F.when(F.col("__level") > k, F.col(f"__p{k}")) for k in range(1, levels)]
    return rows.withColumn("parent", F.greatest(*candidates)[node]).drop("__level", *[f"__p{k}" for k in range(1, levels)])


def current_section(blocks: DataFrame, doc: str, order: str, is_heading: Column, heading_id: str) -> DataFrame:
    """``section``: the id of the latest heading at or before each block; null before the first."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(F.when(is_heading, F.col(heading_id)), ignorenulls=True).over(w))


def section_rollup(blocks: DataFrame) -> DataFrame:
    """(paper_key, section_id, char_count, end_block, n_blocks) from blocks, each id counted once."""
    return (
        blocks.where(F.col("section_id").isNotNull())
        .groupBy("paper_key", "section_id", "id")
        .agg(F.max(F.length("text")).alias("n"), F.max("ordinal").alias("o"))
        .groupBy("paper_key", "section_id")
        .agg(
            F.sum(F.coalesce("n", F.lit(0))).alias("char_count"),
            F.max("o").alias("end_block"),
            F.count(F.lit(1)).alias("n_blocks"),
        )
    )


def markdown_sections(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, section_no, section_id, level, title, body, block_ordinal): every line that begins with ``#`` opens a section.

    The text before the first heading is section 0, without id. Bodies are the lines between, without white space around them;
    ``block_ordinal`` is the place of the body among the pieces that headings part, empty ones counted.
    """
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("line").startswith("#")
    numbered = lines.withColumn("section_no", F.sum(is_heading.cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.when(~is_heading, F.struct("pos", "line"))))
    head = F.max(F.when(is_heading, F.col("line")))
    return (
        numbered.groupBy(doc, "section_no")
        .agg(head.alias("head"), trimmed(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("body"))
        .select(
            doc,
            "section_no",
            F.when(F.col("section_no") > 0, F.concat(F.lit("md-sec-"), "section_no")).alias("section_id"),
            F.length(F.regexp_extract("head", "^(#+)", 1)).alias("level"),
            trimmed(F.regexp_replace("head", "^#+", "")).alias("title"),
            "body",
            F.col("section_no").alias("block_ordinal"),
        )
    )


def read_window(docs: DataFrame, text: str, offset: int = 0, max_chars: int = READ_WINDOW) -> DataFrame:
    """``window``, ``total`` and ``next_offset`` (null at the end) of each text; a size of 0 or less is the default."""
    at, size = max(offset, 0), max_chars if max_chars > 0 else READ_WINDOW
    total = F.length(text)
    return (
        docs.withColumn("window", F.substring(F.col(text), at + 1, size))
        .withColumn("total", total)
        .withColumn("next_offset", F.when(total > at + size, F.lit(at + size)))
    )


def read_section(blocks: DataFrame, paper_key: str, section_id: str) -> DataFrame:
    """One row (paper_key, section_id, text): the blocks of exactly this section in order, parted by blank lines."""
    own = blocks.where((F.col("paper_key") == paper_key) & (F.col("section_id") == section_id))
    once = own.select("paper_key", "section_id", "id", "ordinal", "text").distinct()
    return once.groupBy("paper_key", "section_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))), lambda b: b["text"]), "\n\n").alias("text")
    )


def outline(sections: DataFrame, paper_key: str) -> DataFrame:
    """The headings of a paper in order, indented by level."""
    return (
        sections.where(F.col("paper_key") == paper_key)
        .select("section_id", "level", "title", "ordinal")
        .distinct()
        .withColumn("line", F.concat(F.repeat(F.lit("  "), F.greatest(F.coalesce("level", F.lit(1)) - 1, F.lit(0))), F.col("title")))
        .orderBy("ordinal", "section_id")
    )


def positional(floats: DataFrame, doc: str, node: str, natural: Column) -> DataFrame:
    """``position``: place of a figure or table in natural order of its id within the document, from 1."""
    return floats.withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy(natural, F.col(node))))
