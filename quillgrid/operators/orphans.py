"""References to records that do not exist.

Method: references are pre-aggregated per key and period; keys with very many references are looked up
through a broadcast of bounded size, all others by a shuffled anti-join, and both results are united.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.session import cut_lineage

HEAVY_ROWS = 100_000
HEAVY_KEYS = 4_096


def normal_key(key: Column) -> Column:
    """Trimmed, lower case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(key, r"(?U)^\s+|\s+$", "")), F.lit(""))


def normal_path(path: Column) -> Column:
    """The place in the bundle a path names: ``\\`` as ``/``, no empty or ``.`` parts, ``..`` resolved."""
    parts = F.filter(
        F.split(F.regexp_replace(F.regexp_replace(path, r"(?U)^\s+|\s+$", ""), r"\\", "/"), "/"),
        lambda p: (p != "") & (p != "."),
    )
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.concat(acc, F.array(p))
        ),
    )
    plain = F.array_join(parts, "/")
    return F.when(F.array_contains(parts, ".."), F.array_join(resolved, "/")).otherwise(plain)


def reference_counts(refs: DataFrame, key: Sequence[str], group: Sequence[str], period: Column) -> DataFrame:
    """References per group, key and period. Rows with a null key part refer to nothing and are left out."""
    named = refs
    for k in key:
        named = named.where(F.col(k).isNotNull())
    return named.groupBy(*group, *key, period.alias("period")).agg(F.count(F.lit(1)).alias("n_refs"))


def heavy_keys(counts: DataFrame, key: Sequence[str], heavy_rows: int, heavy_keys_max: int) -> DataFrame:
    """Keys with at least ``heavy_rows`` references, at most ``heavy_keys_max`` of them.

    The rest, heavy or not, takes the shuffled way, so the bound only limits the broadcast.
    """
    return (
        counts.groupBy(*key)
        .agg(F.sum("n_refs").alias("n"))
        .where(F.col("n") >= heavy_rows)
        .orderBy(F.desc("n"), *key)
        .limit(heavy_keys_max)
        .select(*key)
    )


def orphan_counts(
    refs: DataFrame,
    parents: DataFrame,
    key: Sequence[str],
    group: Sequence[str],
    period: Column,
    heavy_rows: int = HEAVY_ROWS,
    heavy_keys_max: int = HEAVY_KEYS,
) -> DataFrame:
    """Orphan references per ``group``, ``key`` and ``period``: (group…, key…, period, n_refs).

    ``parents`` holds the key columns under the same names; repeated parents don't matter. A null
    ``period`` is a period of its own. The aggregated counts are checkpointed, as several branches read them. Empty inputs give an empty result, or all references if only
    ``parents`` is empty.
    """
    counts = cut_lineage(reference_counts(refs, key, group, period))
    heavy = F.broadcast(heavy_keys(counts, key, heavy_rows, heavy_keys_max))
    known = parents.select(*key)
    held = known.join(heavy, list(key), "left_semi").distinct()
    hot = counts.join(heavy, list(key), "left_semi").join(F.broadcast(held), list(key), "left_anti")
    cold = counts.join(heavy, list(key), "left_anti").join(known, list(key), "left_anti")
    columns = [*group, *key, "period", "n_refs"]
    return hot.select(*columns).unionByName(cold.select(*columns))


def orphan_rows(
    refs: DataFrame,
    parents: DataFrame,
    key: Sequence[str],
    group: Sequence[str],
    period: Column,
    heavy_rows: int = HEAVY_ROWS,
    heavy_keys_max: int = HEAVY_KEYS,
) -> DataFrame:
    """The rows of ``refs`` behind :func:`orphan_counts`, with all their columns.

    The orphan keys found on the aggregated counts are brought back to the rows. Keys with many
    references are few by the bound of the split and are broadcast, so no task gets the
    rows of a hot key; the others are joined by shuffle.
    """
    counts = orphan_counts(refs, parents, key, group, period, heavy_rows, heavy_keys_max)
    lost = cut_lineage(counts.groupBy(*group, *key).agg(F.sum("n_refs").alias("__n")))
    top = F.broadcast(
        lost.where(F.col("__n") >= heavy_rows).orderBy(F.desc("__n"), *group, *key).limit(heavy_keys_max)
    )
    by = [*group, *key]
    hot = refs.join(top.select(*by), by, "left_semi")
    cold = refs.join(top.select(*by), by, "left_anti").join(lost.select(*by), by, "left_semi")
    return hot.unionByName(cold)


def paper_key_references(figures: DataFrame, tables_index: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_table, ref_field, paper_key, item_id, indexed_at) of every row that names a paper."""

    def of(df: DataFrame, name: str, item: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("ref_table"),
            F.lit("paper_key").alias("ref_field"),
            normal_key(F.col("paper_key")).alias("paper_key"),
            F.col(item).alias("item_id"),
            "indexed_at",
        ).where(F.col("paper_key").isNotNull())

    return (
        of(figures, "figures", "id")
        .unionByName(of(tables_index, "tables_index", "id"))
        .unionByName(of(files, "files", "rel_path"))
    )


def library_orphans(
    papers: DataFrame,
    figures: DataFrame,
    tables_index: DataFrame,
    files: DataFrame,
    heavy_rows: int = HEAVY_ROWS,
    heavy_keys_max: int = HEAVY_KEYS,
) -> DataFrame:
    """Orphan rows of a library: (ref_table, ref_field, paper_key, item_id, indexed_at).

    ``paper_key``: the paper is missing, or the newest of its rows is ``dropped``. ``crop_path``: the paper
    exists, but ``files`` has no such path for it. Null or empty keys and null paths (and paths that name
    no place, such as ``/``) are no references. Repeated rows come out as often as they are stored.
    """
    live = (
        papers.where(F.col("key").isNotNull())
        .groupBy(normal_key(F.col("key")).alias("paper_key"))
        .agg(F.max(F.struct("updated_at", "created_at", "status"))["status"].alias("status"))
        .where(~F.col("status").eqNullSafe("dropped"))
        .select("paper_key")
    )
    period = F.date_trunc("month", F.col("indexed_at"))
    refs = paper_key_references(figures, tables_index, files)
    by_key = orphan_rows(refs, live, ["paper_key"], ["ref_table", "ref_field"], period, heavy_rows, heavy_keys_max)

    crops = figures.select(
        F.lit("figures").alias("ref_table"),
        F.lit("crop_path").alias("ref_field"),
        normal_key(F.col("paper_key")).alias("paper_key"),
        F.col("id").alias("item_id"),
        F.nullif(normal_path(F.col("crop_path")), F.lit("")).alias("path"),
        "indexed_at",
    ).where(F.col("path").isNotNull() & F.col("paper_key").isNotNull())
    crops = crops.join(live, "paper_key", "left_semi")
    present = files.select(
        normal_key(F.col("paper_key")).alias("paper_key"), normal_path(F.col("rel_path")).alias("path")
    ).where(F.col("paper_key").isNotNull() & F.col("path").isNotNull())
    by_path = orphan_rows(
        crops, present, ["paper_key", "path"], ["ref_table", "ref_field"], period, heavy_rows, heavy_keys_max
    )
    return by_key.unionByName(by_path.drop("path"))


def found(papers: DataFrame, figures: DataFrame, tables_index: DataFrame, files: DataFrame, **split: int) -> DataFrame:
    return (
        library_orphans(papers, figures, tables_index, files, **split)
        .select("ref_table", "ref_field", "paper_key", "item_id")
        .distinct()
    )


def monthly(papers: DataFrame, figures: DataFrame, tables_index: DataFrame, files: DataFrame, **split: int) -> DataFrame:
    """Orphan references per table, field and month of ``indexed_at``: distinct rows and rows as stored."""
    return (
        library_orphans(papers, figures, tables_index, files, **split)
        .groupBy("ref_table", "ref_field", F.date_format("indexed_at", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.countDistinct("paper_key", F.coalesce("item_id", F.lit(""))).alias("n_items"),
        )
    )
