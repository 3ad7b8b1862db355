"""Splitting oversized items at natural boundaries.

Method: recursive bisection. A text is cut at the strongest boundary near its midpoint; halves that exceed
the limit less the overlap are cut again; then each piece but the first is given the end of the one before.
Items made of many rows (sections) are first brought under a bound by the same bisection over their rows; the
end of each such span is carried into the next, and piece numbers go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LIMIT = 2_000
OVERLAP = 200
SECTION_LIMIT = 12_000
#: Characters of a section that one task takes at once.
SPAN_CHARS = 400_000
#: Share of the text around the midpoint in which a boundary is sought.
REACH = 0.25
SALTS = 16

#: Boundaries from strong to weak; a cut lies at the end of the match.
BOUNDARIES = [
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…][\"'”’)\]]*\s+"),
    re.compile(r"[;:,]\s+"),
    re.compile(r"\s+"),
]


def cut_near_middle(text: str, lo: int, hi: int) -> int:
    """Position in (lo, hi) of the strongest boundary near the middle; the middle where there is none."""
    middle, reach = (lo + hi) // 2, max(1, int((hi - lo) * REACH))
    left, right = max(lo + 1, middle - reach), min(hi - 1, middle + reach)
    for boundary in BOUNDARIES:
        best = -1
        for m in boundary.finditer(text, left, right):
            end = m.end()
            if lo < end < hi and (best < 0 or abs(end - middle) < abs(best - middle)):
                best = end
        if best > 0:
            return best
    return middle


def bisect(text: str, most: int) -> list[tuple[int, int]]:
    """Cut ``text`` until no part has more than ``most`` characters; parts in order, without gaps."""
    parts, stack = [], [(0, len(text))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= most:
            parts.append((lo, hi))
        else:
            at = cut_near_middle(text, lo, hi)
            stack += [(at, hi), (lo, at)]
    return parts


def overlap_start(text: str, lo: int, hi: int, overlap: int) -> int:
    """Where the repeated end of the part (lo, hi) begins: at most ``overlap`` characters, at a word if near."""
    start = max(lo, hi - overlap)
    if start > lo and not text[start - 1].isspace():
        m = re.compile(r"\s+").search(text, start, min(hi, start + overlap // 2))
        if m and m.end() < hi:
            start = m.end()
    return start


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces as (start, own_start, end): ``text[start:own_start]`` repeats the end of the piece before.

    No piece has more than ``limit`` characters; a text within the limit is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    parts = bisect(text, limit - overlap)
    pieces, before = [], None
    for lo, hi in parts:
        start = lo if before is None else overlap_start(text, *before, overlap)
        pieces.append((start, lo, hi))
        before = (lo, hi)
    return pieces


PIECES = T.StructType(
    [
        T.StructField("item_kind", T.StringType()),
        T.StructField("paper_key", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("span", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("n_overlap", T.IntegerType()),
        T.StructField("piece_text", T.StringType()),
    ]
)


def _split_batches(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, key, item, span, text in zip(
                batch["item_kind"], batch["paper_key"], batch["item_id"], batch["span"], batch["text"]
            ):
                for i, (start, own, end) in enumerate(split_text(text, limit, overlap)):
                    rows.append((kind, key, item, span, i, own - start, text[start:end]))
            yield pd.DataFrame(rows, columns=PIECES.names)

    return run


ENDS = T.StructType([*PIECES.fields[1:4], T.StructField("pieces", T.IntegerType()), T.StructField("end_text", T.StringType())])
#: What parts the blocks of a section.
BETWEEN = "\n\n"


def _span_ends(limit: int, overlap: int):
    """(pieces, end_text) of each span: what the span after it has to go on from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, item, span, text in zip(batch["paper_key"], batch["item_id"], batch["span"], batch["text"] + BETWEEN):
                parts = bisect(text, limit - overlap)
                rows.append((key, item, span, len(parts), text[overlap_start(text, *parts[-1], overlap) :]))
            yield pd.DataFrame(rows, columns=ENDS.names)

    return run


def _split_spans(limit: int, overlap: int):
    """Pieces of the spans of a section, cut as for ``_span_ends``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                text = r.text if r.last else r.text + BETWEEN
                repeated = r.before or ""
                for i, (lo, hi) in enumerate(bisect(text, limit - overlap)):
                    rows.append((r.item_kind, r.paper_key, r.item_id, r.span, r.first + i, len(repeated), repeated + text[lo:hi]))
                    repeated = text[overlap_start(text, lo, hi, overlap) : hi]
            yield pd.DataFrame(rows, columns=PIECES.names)

    return run


def _sizes_once(blocks: DataFrame) -> DataFrame:
    """(paper_key, section_id, n): the length of each block, repeats of (paper_key, id) counted once.

    Rows without id can't be told from each other and all count.
    """
    sizes = blocks.select("paper_key", "section_id", "id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    once = (
        sizes.where(F.col("id").isNotNull())
        .groupBy("paper_key", "id")
        .agg(F.max(F.struct("section_id", "n")).alias("b"))
        .select("paper_key", "b.section_id", "b.n")
    )
    return once.unionByName(sizes.where(F.col("id").isNull()).drop("id"))


def oversized_sections(blocks: DataFrame, section_limit: int = SECTION_LIMIT) -> DataFrame:
    """(paper_key, section_id, n_chars, n_blocks) of sections whose blocks have more than the limit together.

    Sizes come from the texts, not from any stored count; repeated blocks count once, null texts as empty, and
    blocks outside a section (null section_id) make no section. Only lengths are shuffled; sums are
    combined on the map side, so a section with a third of all blocks isn't gathered.
    """
    return (
        _sizes_once(blocks)
        .where(F.col("section_id").isNotNull())
        .groupBy("paper_key", "section_id")
        .agg(F.sum("n").alias("n_chars"), F.count(F.lit(1)).alias("n_blocks"))
        .where(F.col("n_chars") > section_limit)
    )


def section_spans(blocks: DataFrame, oversized: DataFrame, span_chars: int = SPAN_CHARS) -> DataFrame:
    """Texts of oversized sections, in spans that one task can hold: (paper_key, section_id, span, text).

    A section longer than ``span_chars`` is halved over its blocks until the halves fit: block number b, whose
    middle lies at the share s of the section, goes to span floor(s * 2^k). The place of each block comes
    from sums per run of ordinals and sums within a run, so no task reads a whole section. A single
    block longer than the bound is a span of its own.
    """
    halvings = F.greatest(F.ceil(F.log2(F.col("n_chars") / F.lit(span_chars))), F.lit(0))
    keys = oversized.select(
        "paper_key",
        "section_id",
        "n_chars",
        F.pow(F.lit(2.0), halvings).alias("n_spans"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    rows = (
        blocks.where(F.col("section_id").isNotNull() & (F.length("text") > 0))
        .withColumn("salt", F.pmod(F.xxhash64("id", "ordinal"), F.lit(SALTS)).cast("int"))
        .join(keys, ["paper_key", "section_id", "salt"])
        .groupBy("paper_key", "section_id", "id", F.when(F.col("id").isNull(), F.monotonically_increasing_id()).alias("u"))
        .agg(F.max(F.struct("ordinal", "text", "n_chars", "n_spans")).alias("b"))
        .select("paper_key", "section_id", "id", "b.*")
        .withColumn("run", F.floor(F.coalesce("ordinal", F.lit(0)) / 512))
    )
    within = Window.partitionBy("paper_key", "section_id", "run").orderBy("ordinal", "id")
    across = Window.partitionBy("paper_key", "section_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.sum(F.length("text")).over(within) - F.length("text") / 2)
    runs = (
        rows.groupBy("paper_key", "section_id", "run")
        .agg(F.sum(F.length("text")).alias("run_chars"))
        .withColumn("before", F.coalesce(F.sum("run_chars").over(across), F.lit(0)))
        .drop("run_chars")
    )
    share = (F.col("before") + F.col("inside")) / F.col("n_chars")
    return (
        placed.join(runs, ["paper_key", "section_id", "run"])
        .withColumn("span", F.least(F.floor(share * F.col("n_spans")), F.col("n_spans") - 1).cast("bigint"))
        .groupBy("paper_key", "section_id", "span")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))).alias("parts"))
        .select("paper_key", "section_id", "span", F.array_join(F.transform("parts", lambda p: p["text"]), BETWEEN).alias("text"))
    )


def split_blocks(blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of all blocks longer than ``limit``. Only those are shuffled (to drop repeats) and sent to Python."""
    large = blocks.where(F.length("text") > limit).select(
        F.lit("block").alias("item_kind"),
        "paper_key",
        F.col("id").cast("string").alias("item_id"),
        F.lit(0).cast("bigint").alias("span"),
        "text",
    )
    return large.distinct().mapInPandas(_split_batches(limit, overlap), PIECES)


def split_sections(
    blocks: DataFrame,
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    section_limit: int = SECTION_LIMIT,
    span_chars: int = SPAN_CHARS,
) -> DataFrame:
    """Pieces of all sections whose blocks have more than ``section_limit`` characters together.

    Sections of several spans are cut twice: for the ends of their spans, of which a window per section takes
    no more than ``overlap`` characters each, and for the pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    oversized = oversized_sections(blocks, section_limit)
    small, large = (
        section_spans(blocks, oversized.where(which), span_chars).select(
            F.lit("section").alias("item_kind"), "paper_key", F.col("section_id").alias("item_id"), "span", "text"
        )
        for which in (F.col("n_chars") <= span_chars, F.col("n_chars") > span_chars)
    )
    ordered = Window.partitionBy("paper_key", "item_id").orderBy("span")
    ends = large.mapInPandas(_span_ends(limit, overlap), ENDS).select(
        "paper_key",
        "item_id",
        "span",
        F.lag("end_text").over(ordered).alias("before"),
        F.coalesce(F.sum("pieces").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.lead("span").over(ordered).isNull().alias("last"),
    )
    following = large.join(ends, ["paper_key", "item_id", "span"]).mapInPandas(_split_spans(limit, overlap), PIECES)
    return small.mapInPandas(_split_batches(limit, overlap), PIECES).unionByName(following)


def split_library(blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, section_limit: int = SECTION_LIMIT) -> DataFrame:
    """Pieces of all oversized blocks and sections.

    Null and empty texts and items within their limit give no pieces; an empty table gives an empty result.
    Columns of ``blocks`` other than id, paper_key, section_id, ordinal, kind and text are ignored.
    """
    return split_blocks(blocks, limit, overlap).unionByName(
        split_sections(blocks, limit, overlap, section_limit)
    )


def found(blocks: DataFrame) -> DataFrame:
    """(item_kind, paper_key, item_id) of the items that the splitter had to cut."""
    return split_library(blocks).select("item_kind", "paper_key", "item_id").distinct()
