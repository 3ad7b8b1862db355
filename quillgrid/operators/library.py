"""The library's relational operators: statistics, listing, look-ups, merges, upserts, maintenance, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.text import normal_label


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): a count per table, in one job."""
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def count_by(df: DataFrame, column: str, default: str | None = None) -> DataFrame:
    """(value, n); with a default, null and empty values count as it, without one null values are left out."""
    value = F.col(column)
    if default is not None:
        value = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default))
    return df.select(value.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def list_papers(papers: DataFrame, query: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Papers whose title or abstract holds the query (``%`` and ``_`` are wild, case is not minded), newest first."""
    rows = papers
    if query:
        rows = rows.where(F.col("title").ilike(f"%{query}%") | F.col("abstract").ilike(f"%{query}%"))
    rows = rows.orderBy(F.desc("updated_at"), "key")
    if offset > 0:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit and limit > 0 else rows


def papers_with_authors(papers: DataFrame, authors: DataFrame) -> DataFrame:
    """Papers with ``authors``, an array in order of position; empty for papers without any."""
    named = (
        authors.select("paper_key", "position", "name")
        .distinct()
        .groupBy("paper_key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda a: a["name"]).alias("authors"))
    )
    joined = papers.join(named, papers["key"] == named["paper_key"], "left").drop("paper_key")
    return joined.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def list_with_authors(papers: DataFrame, query: str, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Papers (with ``authors``) whose title, abstract or authors hold the query as it stands, case not minded, newest first."""
    low = query.lower()
    held = lambda c: F.coalesce(F.lower(c).contains(low), F.lit(False))
    rows = papers.where(held(F.col("title")) | held(F.col("abstract")) | held(F.array_join("authors", ", ")))
    rows = rows.orderBy(F.desc("updated_at"), "key").offset(max(offset, 0))
    return rows.limit(limit) if limit and limit > 0 else rows


def count_by_category(papers: DataFrame, categories: str) -> DataFrame:
    """(value, n) of an array column, each value of a row once more than it stands there; most frequent first."""
    return papers.select(F.explode(categories).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def requested_keys(papers: DataFrame, keys: DataFrame | None = None, by_url: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """(key): the keys asked for by name or URL, or all, each once, as far as the library has them."""
    held = papers.select("key").distinct()
    if everything:
        return held
    asked = [df.select("key") for df in (keys, by_url) if df is not None]
    union = asked[0] if asked else held.where(F.lit(False))
    for more in asked[1:]:
        union = union.unionByName(more)
    return held.join(union.distinct(), "key", "left_semi")


def find_float(floats: DataFrame, paper_key: str, wanted: str, positioned: DataFrame) -> DataFrame:
    """A figure or table by id or label (colon and case are not minded), else by its place in natural order."""
    key = wanted.strip().rstrip(":").strip().lower()
    own = positioned.where(F.col("paper_key") == paper_key)
    named = (normal_label(F.col("id")) == key) | (normal_label(F.col("label")) == key)
    placed = F.col("position") == int(key) if key.isdigit() else F.lit(False)
    return own.where(named | placed).orderBy(F.when(named, 0).otherwise(1)).limit(1)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def neighbour_frequency(edges: DataFrame, seed: str, neighbour: str, min_seeds: int = 1) -> DataFrame:
    """(neighbour, n_seeds): how many seeds each neighbour belongs to; null and empty neighbours are left out.

    A seed counts once; both steps combine on the map side, so a work cited by a third of all seeds is no hot task.
    """
    return (
        edges.where(F.col(neighbour).isNotNull() & (F.col(neighbour) != ""))
        .select(seed, neighbour)
        .distinct()
        .groupBy(neighbour)
        .agg(F.count(F.lit(1)).alias("n_seeds"))
        .where(F.col("n_seeds") >= min_seeds)
    )


def neighbour_filter(rows: DataFrame, open_access: bool = False, min_citations: int = 0) -> DataFrame:
    """Neighbours that are open access, and cited often enough; a missing count is 0."""
    if open_access:
        rows = rows.where(F.coalesce("is_open_access", F.lit(False)))
    return rows.where(F.coalesce("citation_count", F.lit(0)) >= min_citations) if min_citations else rows


def ranked_neighbours(edges: DataFrame, seed: str, neighbour: str, citations: str, order: str, min_seeds: int = 1) -> DataFrame:
    """(neighbour, n_seeds, citation_count, resolvable, rank): most seeds first, then most cited, then first seen.

    ``edges`` also has arxiv_id and doi; a neighbour with either can be resolved. Attributes are those of the first edge in
    ``order``. Counting is combined on the map side; the rank is a window over the distinct neighbours that are left.
    """
    known = edges.where(F.col(neighbour).isNotNull() & (F.col(neighbour) != ""))
    counted = known.groupBy(neighbour).agg(
        F.countDistinct(seed).alias("n_seeds"),
        F.min(F.struct(F.col(order).alias("o"), F.coalesce(F.col(citations), F.lit(0)).alias("c"), (F.coalesce("arxiv_id", "doi", F.lit("")) != "").alias("r"))).alias("f"),
    )
    kept = counted.where(F.col("n_seeds") >= min_seeds)
    by = [F.desc("n_seeds"), F.desc("f.c"), F.asc("f.o"), F.asc(neighbour)]
    return kept.orderBy(*by).select(neighbour, "n_seeds", F.col("f.c").alias("citation_count"), F.col("f.r").alias("resolvable"))


def jobs(records: DataFrame, limit: int = 20) -> DataFrame:
    """The newest jobs with ``line``, what is to be said of each; ``runner_alive`` false marks a job whose runner is gone."""
    over = F.col("state").isin("done", "failed", "cancelled")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    progress = F.concat(F.lit("("), count("done"), F.lit("/"), count("total"), F.lit(")"))
    head = F.concat(F.lit("job "), F.col("id"), F.lit(": "))
    dead = ~over & ~F.coalesce("runner_alive", F.lit(True))
    alive = F.concat_ws(
        ", ",
        F.concat(head, F.col("state"), F.lit(" "), progress),
        F.when(F.col("succeeded") > 0, F.concat(count("succeeded"), F.lit(" ok"))),
        F.when(F.col("failed") > 0, F.concat(count("failed"), F.lit(" failed"))),
        F.when(~over & (F.col("current") != ""), F.concat(F.lit("now: "), F.col("current"))),
    )
    line = F.when(dead, F.concat(head, F.lit("runner exited without finishing "), progress)).otherwise(alive)
    return records.withColumn("line", line).orderBy(F.desc("started_at"), "id").limit(limit)


def fresh(neighbours: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """Neighbours that the library doesn't hold; those without the key stay."""
    return neighbours.join(held.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


def ranked_candidates(sources: Sequence[DataFrame], key: str, url: str) -> DataFrame:
    """(key, url, kind, priority): candidates of all sources in order, each url once, priority by first place."""
    tagged = None
    for i, s in enumerate(sources):
        t = s.select(key, url, "kind", F.lit(i).alias("__source")).where(F.col(url).isNotNull())
        tagged = t if tagged is None else tagged.unionByName(t)
    once = tagged.groupBy(key, url).agg(F.min(F.struct("__source", "kind")).alias("f"))
    w = Window.partitionBy(key).orderBy("f.__source", url)
    return once.select(key, url, F.col("f.kind").alias("kind"), (F.row_number().over(w) - 1).alias("priority"))


def merge_by_precedence(sources: Sequence[DataFrame], key: str, fields: Sequence[str]) -> DataFrame:
    """A row per key; each field from the first source that has it neither null nor empty."""
    tagged = None
    for i, s in enumerate(sources):
        t = s.select(key, *[(F.col(f) if f in s.columns else F.lit(None)).alias(f) for f in fields], F.lit(i).alias("__source"))
        tagged = t if tagged is None else tagged.unionByName(t)
    filled = lambda f: F.when(F.nullif(F.col(f).cast("string"), F.lit("")).isNotNull(), F.struct("__source", F.col(f).alias("v")))
    return tagged.groupBy(key).agg(*[F.min(filled(f))["v"].alias(f) for f in fields])


def upsert(old: DataFrame, new: DataFrame, key: str, keep: Sequence[str] = ("created_at",), order: Column | None = None) -> DataFrame:
    """All rows of ``old`` with those of ``new`` put over them; the columns ``keep`` stay as they were first.

    Of several new rows of a key the last in ``order`` counts. A union and one aggregation instead of a join.
    """
    columns = old.columns
    rank = order if order is not None else F.lit(0)
    a = old.select(*columns, F.lit(0).alias("__new"), F.lit(None).cast("timestamp").alias("__order"))
    b = new.select(*columns, F.lit(1).alias("__new"), rank.cast("timestamp").alias("__order"))
    latest = F.max(F.struct("__new", "__order", *[c for c in columns if c != key]))
    first = F.min(F.struct("__new", "__order", *[c for c in columns if c != key]))
    got = a.unionByName(b).groupBy(key).agg(latest.alias("n"), first.alias("o"))
    return got.select(*[F.col(key) if c == key else F.coalesce(F.col("o")[c], F.col("n")[c]).alias(c) if c in keep else F.col("n")[c].alias(c) for c in columns])


def cascade_drop(tables: dict[str, tuple[DataFrame, str]], dropped: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables without the rows of the dropped keys."""
    gone = dropped.select(F.col(key).alias("__gone")).distinct()
    return {n: df.join(gone, df[c] == gone["__gone"], "left_anti") for n, (df, c) in tables.items()}


def presence(index: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """(key, state): ``missing`` is indexed but not on disk, ``unindexed`` the reverse."""
    a = index.select(key).distinct().withColumn("i", F.lit(True))
    b = disk.select(key).distinct().withColumn("d", F.lit(True))
    state = F.when(F.col("d").isNull(), "missing").when(F.col("i").isNull(), "unindexed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where(F.col("state").isNotNull())


def refresh(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], force: bool = False) -> DataFrame:
    """Fill the missing fields of ``old`` from ``new``, or overwrite them where ``new`` has a value and ``force`` is set."""
    fetched = new.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = old.join(fetched, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(F.col(f"__{f}"), F.col(f)) if force else F.coalesce(F.col(f), F.col(f"__{f}")))
    return joined.drop(*[f"__{f}" for f in fields])


def prune_sizes(files: DataFrame) -> DataFrame:
    """(folder, n_files, n_bytes) of a bundle's members by their first folder, each (paper, path) once."""
    folder = F.regexp_extract(F.regexp_replace("rel_path", r"^[./\\]+", ""), r"^([^/\\]+)[/\\]", 1)
    return (
        files.groupBy("paper_key", "rel_path")
        .agg(F.max("bytes").alias("b"))
        .groupBy(F.coalesce(F.nullif(folder, F.lit("")), F.lit("root")).alias("folder"))
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("b").alias("n_bytes"))
    )


def regression(current: DataFrame, baseline: DataFrame, key: str, fields: Sequence[str], tolerance: float = 0.8) -> DataFrame:
    """(key, field, was, now): values under ``tolerance`` of the baseline, and keys that are gone (now null)."""
    long = lambda df, name: df.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).cast("double") for f in fields]))).alias("field", name))
    return (
        long(baseline, "was").join(long(current, "now"), [key, "field"], "left").where(F.col("now").isNull() | (F.col("now") < tolerance * F.col("was")))
    )


# The counters of an extraction's coverage map.
TRACKED = ["math", "figures", "tables", "bibitems", "notes"]


def coverage_report(docs: DataFrame, min_ratio: float = 0.95, empty_chars: int = 1_000) -> DataFrame:
    """``ratio``, ``ok``, ``reason`` of extractions.

    Needs source_counts and mapped_counts (map<string,int>), n_blocks, content_chars, ir_available, images_total,
    images_downloaded. A document without blocks, or with few characters and nothing to count, is empty.
    """
    zero = F.lit(0)
    count = lambda m, k: F.coalesce(F.try_element_at(F.col(m), F.lit(k)), zero)
    images, got = F.coalesce("images_total", zero), F.coalesce("images_downloaded", zero)
    source = sum((count("source_counts", k) for k in TRACKED), zero) + images
    mapped = sum((F.least(count("mapped_counts", k), count("source_counts", k)) for k in TRACKED), zero) + F.when(images > 0, got).otherwise(0)
    empty = (F.col("n_blocks") == 0) | ((F.col("content_chars") < empty_chars) & (source == 0))
    ratio = F.when(source == 0, F.lit(1.0)).otherwise(mapped / source)
    usable = F.col("ir_available") & ~empty
    return docs.select(
        "*",
        F.when(usable, F.round(ratio, 4)).alias("ratio"),
        (usable & (ratio >= min_ratio)).alias("ok"),
        F.when(~F.col("ir_available"), "no structured document")
        .when(empty, "empty document")
        .when(ratio < min_ratio, "coverage below the threshold")
        .alias("reason"),
    )
