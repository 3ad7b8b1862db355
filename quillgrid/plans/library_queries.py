"""Queries of the reference's own operators over the library's tables, with SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions import bibtex, text, urls
from quillgrid.operators import bundles, library, outline, resolving, search
from quillgrid.session import checkpoint_folder
from quillgrid.sources.tables import current_papers, table
from quillgrid.streaming import events


def url_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("url IS NOT NULL").select("doc_id", "url")
    return urls.with_identity(rows, "url", "i").select("doc_id", "i.kind", "i.fingerprint", "i.key")


def source_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "papers").where("source_url IS NOT NULL").select("source_url").distinct()
    return urls.with_identity(rows, "source_url", "i").select("source_url", "i.kind", "i.key")


def url_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("url IS NOT NULL")
    keyed = docs.select("doc_id", urls.canonical_url(F.col("url")).alias("canonical"))
    return keyed.groupBy("canonical").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"))


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "papers").where("title IS NOT NULL").select("title").distinct().withColumn("slug", text.slug(F.col("title")))


def library_stats(spark: SparkSession, folder: str) -> DataFrame:
    names = ("papers", "figures", "tables_index", "equations", "refs")
    return library.table_counts({n: table(spark, folder, n) for n in names})


def papers_by_extractor(spark: SparkSession, folder: str) -> DataFrame:
    return library.count_by(current_papers(table(spark, folder, "papers")), "extractor", "unknown")


def papers_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return library.count_by(current_papers(table(spark, folder, "papers")), "year")


def list_papers(spark: SparkSession, folder: str) -> DataFrame:
    rows = library.list_papers(current_papers(table(spark, folder, "papers")), "corpus", 20, 5)
    return rows.select("key", "title", "year")


def paper_authors(spark: SparkSession, folder: str) -> DataFrame:
    got = library.papers_with_authors(current_papers(table(spark, folder, "papers")), table(spark, folder, "authors"))
    return got.select("key", F.size("authors").cast("bigint").alias("n_authors"), F.array_join("authors", "; ").alias("author_line"))


def outline_parents(spark: SparkSession, folder: str) -> DataFrame:
    heads = table(spark, folder, "sections").where("ordinal IS NOT NULL").groupBy("paper_key", "ordinal").agg(F.max(F.struct("section_id", "level")).alias("h"))
    rows = heads.select("paper_key", "ordinal", "h.*")
    return outline.heading_parents(rows, "paper_key", "ordinal", "level", "section_id").select("paper_key", "section_id", "ordinal", F.col("parent").alias("level_parent"))


def section_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return outline.section_rollup(table(spark, folder, "blocks"))


def heading_sections(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "blocks").where("ordinal IS NOT NULL").groupBy("paper_key", "ordinal").agg(F.max(F.struct("id", "kind")).alias("b")).select("paper_key", "ordinal", "b.*")
    got = outline.current_section(blocks, "paper_key", "ordinal", F.col("kind") == "heading", "id")
    return got.groupBy("paper_key", "section").agg(F.count(F.lit(1)).alias("n_blocks"))


def kind_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").groupBy("paper_key", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.countDistinct("id").alias("n"))


def read_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of the default size from the beginning, from the end of that, and from a place between."""
    docs = table(spark, folder, "documents")
    got = outline.read_window(docs, "text")
    for at in (outline.READ_WINDOW, 100):
        got = got.unionByName(outline.read_window(docs, "text", at))
    return got.select("doc_id", "window", F.col("total").cast("bigint").alias("total"), F.col("next_offset").cast("bigint").alias("next_offset"))


def markdown_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(text.strip_markdown(F.col("text"))).alias("plain_md5"))


def _block_docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").where("id IS NOT NULL AND text IS NOT NULL").select("id", "text").distinct()


def fts_terms(spark: SparkSession, folder: str) -> DataFrame:
    tokens = table(spark, folder, "documents").select("doc_id", text.search_tokens(F.col("text")).alias("t"))
    return (
        tokens.select("doc_id", F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    )


def fts_bm25(spark: SparkSession, folder: str) -> DataFrame:
    got = search.search(table(spark, folder, "documents"), "retrieval corpus", ["doc_id"], "text")
    return got.select("doc_id", F.round("score", 6).alias("score"))


def fts_boolean(spark: SparkSession, folder: str) -> DataFrame:
    got = search.search(table(spark, folder, "documents"), "retrieval OR ranking NOT corpus", ["doc_id"], "text")
    return got.select("doc_id")


def fts_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), '"zero-shot"', ["doc_id"], "text").select("doc_id")


def fts_grep(spark: SparkSession, folder: str) -> DataFrame:
    return search.grep(_block_docs(spark, folder), "citation typing", ["id"], "text", 20)


def fts_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The query of ``fts_bm25`` and a phrase, answered from an inverted index that is built below the checkpoint folder."""
    at = f"{checkpoint_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    search.write_index(table(spark, folder, "documents"), ["doc_id"], "text", at)
    scored = search.search_index(spark, at, "retrieval corpus", ["doc_id"]).select(F.lit("terms").alias("asked"), "doc_id", F.round("score", 6).alias("score"))
    phrase = search.search_index(spark, at, '"zero-shot"', ["doc_id"]).select(F.lit("phrase").alias("asked"), "doc_id", F.lit(0.0).alias("score"))
    return scored.unionByName(phrase)


def find_papers(spark: SparkSession, folder: str) -> DataFrame:
    papers = library.papers_with_authors(current_papers(table(spark, folder, "papers")), table(spark, folder, "authors"))
    return library.list_with_authors(papers, "an", None).select("key")


def neighbour_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Cited works by seeds; how often a work is cited at all stands for its citation count."""
    refs = table(spark, folder, "refs").select("src_key", "bibkey", "arxiv_id", "doi", urls.none_if_empty(urls.normal_doi(F.col("doi"))).alias("cited")).distinct()
    counts = refs.groupBy("cited").agg(F.count(F.lit(1)).alias("citation_count"))
    edges = refs.join(counts, "cited").withColumn("ord", F.concat_ws("/", "src_key", "bibkey"))
    return library.ranked_neighbours(edges, "src_key", "cited", "citation_count", "ord", 2)


def arxiv_sources(spark: SparkSession, folder: str) -> DataFrame:
    papers = current_papers(table(spark, folder, "papers")).where("arxiv_id IS NOT NULL")
    return papers.select("key", F.explode(resolving.arxiv_candidates(F.col("arxiv_id"), F.lit(None).cast("string"))).alias("c")).select("key", "c.kind", "c.url", "c.priority")


def paper_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Resolution of every paper's identity without any stored record: what the identity alone gives."""
    papers = current_papers(table(spark, folder, "papers")).where("source_url IS NOT NULL").select("key", "source_url")
    identities = urls.with_identity(papers, "source_url", "i").select("key", "i.kind", "i.value", "i.normalized_url", "i.version")
    stored = spark.createDataFrame([], "key string, provider string, body string")
    got = resolving.resolve(identities, stored)
    return got.groupBy("resolver", "status").agg(F.count(F.lit(1)).alias("n"))


def outline_ranges(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "blocks").where("ordinal IS NOT NULL").groupBy("paper_key", "ordinal").agg(F.max(F.struct("id", "kind", "text")).alias("b"))
    rows = blocks.select("paper_key", "ordinal", "b.kind", "b.text", F.col("b.id").alias("block_id"), F.lit(1).alias("level"))
    return bundles.outline_ranges(rows).select("paper_key", "block_id", "start", "end")


def ir_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of stored captures by their own counters."""
    docs = table(spark, folder, "ir_documents").where(F.try_parse_json("doc_json").isNotNull()).select("record_id", "doc_json").distinct()
    counts = lambda k: F.from_json(F.get_json_object("doc_json", f"$.coverage.{k}"), "map<string,int>")
    rows = docs.select(
        "record_id", counts("source_counts").alias("source_counts"), counts("mapped_counts").alias("mapped_counts"), F.lit(1).alias("n_blocks"), F.lit(10_000).alias("content_chars"),
        F.lit(True).alias("ir_available"), F.lit(None).cast("int").alias("images_total"), F.lit(None).cast("int").alias("images_downloaded"),
    )
    return library.coverage_report(rows).select("record_id", "ratio", "ok").distinct()


def events_sliding(spark: SparkSession, folder: str) -> DataFrame:
    got = events.windowed_counts(table(spark, folder, "events"), "2 hours", "1 hour")
    return got.groupBy("start").agg(F.sum("n").alias("n"))


def neighbour_rank(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "refs").select("src_key", urls.none_if_empty(urls.normal_doi(F.col("doi"))).alias("cited"))
    return library.neighbour_frequency(edges, "src_key", "cited", 2)


def fresh_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    held = current_papers(table(spark, folder, "papers")).select(urls.normal_doi(F.col("doi")).alias("cited"))
    return library.fresh(neighbour_rank(spark, folder), held, "cited")


def candidate_priority(spark: SparkSession, folder: str) -> DataFrame:
    papers = current_papers(table(spark, folder, "papers"))
    arxiv = papers.where("arxiv_id IS NOT NULL").select("key", F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id").alias("url"), F.lit("arxiv").alias("kind"))
    doi = papers.where("doi IS NOT NULL").select("key", F.concat(F.lit("https://doi.org/"), urls.normal_doi(F.col("doi"))).alias("url"), F.lit("doi").alias("kind"))
    page = papers.select("key", F.col("source_url").alias("url"), F.lit("page").alias("kind"))
    return library.ranked_candidates([arxiv, doi, page], "key", "url").withColumn("priority", F.col("priority").cast("bigint"))


def metadata_merge(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers")
    newest = current_papers(papers)
    fallback = papers.groupBy("key").agg(F.max("title").alias("title"), F.max("venue").alias("venue"), F.max("year").alias("year"), F.max("license").alias("license"))
    return library.merge_by_precedence([newest, fallback], "key", ["title", "venue", "year", "license"])


def upsert_papers(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers")
    old = papers.where("created_at = updated_at").distinct()
    new = papers.where("created_at <> updated_at").distinct()
    got = library.upsert(library.first_wins(old, ["key"], ["updated_at", "status", "title", "venue", "abstract"]), new, "key", ("created_at",), F.col("updated_at"))
    return got.select("key", "status", "created_at", "updated_at")


def stale_bundles(spark: SparkSession, folder: str) -> DataFrame:
    index = table(spark, folder, "papers").select(F.lower("key").alias("key"))
    disk = table(spark, folder, "files").where("paper_key <> ''").select(F.lower(F.trim("paper_key")).alias("key"))
    return library.presence(index, disk, "key")


def prune_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return library.prune_sizes(table(spark, folder, "files"))


def figure_positions(spark: SparkSession, folder: str) -> DataFrame:
    figures = table(spark, folder, "figures").select("paper_key", "id").distinct()
    got = outline.positional(figures, "paper_key", "id", text.natural_key(F.col("id")))
    return got.withColumn("position", F.col("position").cast("bigint"))


def bibtex_keys(spark: SparkSession, folder: str) -> DataFrame:
    papers = library.papers_with_authors(current_papers(table(spark, folder, "papers")), table(spark, folder, "authors"))
    first = F.try_element_at("authors", F.lit(1))
    based = papers.withColumn("base", bibtex.base_key(first, F.col("year"), F.col("title")))
    return bibtex.with_unique_keys(based, "base", ["key"]).select("key", "base", "bibkey")


def bibtex_entries(spark: SparkSession, folder: str) -> DataFrame:
    papers = library.papers_with_authors(current_papers(table(spark, folder, "papers")), table(spark, folder, "authors"))
    first = F.try_element_at("authors", F.lit(1))
    based = papers.withColumn("base", bibtex.base_key(first, F.col("year"), F.col("title")))
    keyed = bibtex.with_unique_keys(based, "base", ["key"])
    cols = [F.col(c) for c in ("bibkey", "title", "authors", "year", "venue", "arxiv_id", "doi", "source_url")]
    return keyed.select("key", bibtex.entry(*cols).alias("entry"))


def events_daily(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def coverage_states(spark: SparkSession, folder: str) -> DataFrame:
    papers = current_papers(table(spark, folder, "papers"))
    state = F.when(F.col("coverage_ratio").isNull(), "none").when(F.col("coverage_ratio") >= 0.95, "passes").otherwise("fails")
    return papers.groupBy(state.alias("state"), F.coalesce("coverage_ok", F.lit(False)).alias("marked_ok")).agg(F.count(F.lit(1)).alias("n"))


def dropped_papers(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("status"))
    ranked = table(spark, folder, "papers").withColumn("rn", F.row_number().over(w))
    return ranked.where("rn = 1 AND status = 'dropped'").select("key")


QUERIES = {
    f.__name__: f
    for f in (
        url_identity, source_identity, url_dedupe, slugs, library_stats, papers_by_extractor, papers_by_year, list_papers,
        paper_authors, outline_parents, section_rollup, heading_sections, kind_histogram, read_windows, markdown_text,
        fts_terms, fts_bm25, fts_boolean, fts_phrase, fts_grep, neighbour_rank, fresh_neighbours, candidate_priority,
        metadata_merge, upsert_papers, stale_bundles, prune_sizes, figure_positions, bibtex_keys, bibtex_entries,
        events_daily, coverage_states, dropped_papers, fts_indexed, find_papers, neighbour_ranked, arxiv_sources, paper_sources, outline_ranges,
        ir_coverage, events_sliding,
    )
}

_CURRENT = """cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, created_at DESC, status DESC,
  identity_kind DESC, identity_value DESC, fingerprint DESC, title DESC NULLS LAST, abstract DESC NULLS LAST) AS rn FROM papers WHERE key IS NOT NULL) WHERE rn = 1)"""
_CANON = r"""
canon AS (
  SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_extract(u, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 2), '^.*@', ''), ':\d*$', '')) AS host,
    coalesce(nullif(lower(regexp_extract(u, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 1)), ''), 'https') AS scheme,
    coalesce(nullif(regexp_extract(u, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 3), ''), '/') AS path,
    array_to_string(list_filter(string_split(regexp_extract(u, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$', 4), '&'),
      lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(string_split(p, '=')[1]) NOT IN
        ('ref','referrer','source','spm','fbclid','gclid','mc_cid','mc_eid','sk','si')), '&') AS query
  FROM (SELECT doc_id, trim(url) AS u FROM documents WHERE url IS NOT NULL)),
whole AS (SELECT doc_id, scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM canon)
"""
_DOI = r"lower(regexp_replace(regexp_replace(trim(doi), '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''), '^/+|/+$', '', 'g'))"
_EDGES = f"""edges AS (SELECT DISTINCT src_key, nullif({_DOI}, '') AS cited FROM refs),
ranked AS (SELECT cited, count(*) AS n_seeds FROM edges WHERE cited IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)"""
_TOKENS = """tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM documents),
kept AS (SELECT * FROM tok WHERE len(t) > 0)"""
_FIRST = """firsts AS (SELECT paper_key, arg_min(name, (position, name)) AS first_author FROM (SELECT DISTINCT paper_key, position, name FROM authors) GROUP BY 1)"""


ORACLE = {
    "url_dedupe": "WITH " + _CANON + "SELECT canonical, min(doc_id) AS first_doc, count(*) AS n_docs FROM whole GROUP BY 1",
    "url_identity": "WITH " + _CANON + "SELECT doc_id, 'url' AS kind, 'url:' || lower(canonical) AS fingerprint, sha256('url:' || lower(canonical)) AS key FROM whole",
    "slugs": r"""
      WITH s AS (SELECT DISTINCT title FROM papers WHERE title IS NOT NULL),
      c AS (SELECT title, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^a-zA-Z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'paper') AS x FROM s)
      SELECT title, CASE WHEN length(x) > 80 THEN regexp_replace(substring(x, 1, 80), '[-.]+$', '') ELSE x END AS slug FROM c""",
    "library_stats": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("papers", "figures", "tables_index", "equations", "refs")),
    "papers_by_extractor": f"WITH {_CURRENT} SELECT coalesce(nullif(extractor, ''), 'unknown') AS value, count(*) AS n FROM cur GROUP BY 1",
    "coverage_states": f"""WITH {_CURRENT} SELECT CASE WHEN coverage_ratio IS NULL THEN 'none' WHEN coverage_ratio >= 0.95 THEN 'passes' ELSE 'fails' END AS state,
      coalesce(coverage_ok, false) AS marked_ok, count(*) AS n FROM cur GROUP BY 1, 2""",
    "list_papers": f"""WITH {_CURRENT} SELECT key, title, year FROM cur WHERE title ILIKE '%corpus%' OR abstract ILIKE '%corpus%'
      ORDER BY updated_at DESC, key LIMIT 20 OFFSET 5""",
    "papers_by_year": f"WITH {_CURRENT} SELECT year AS value, count(*) AS n FROM cur WHERE year IS NOT NULL GROUP BY 1",
    "section_rollup": """
      SELECT paper_key, section_id, sum(coalesce(n, 0))::BIGINT AS char_count, max(o) AS end_block, count(*) AS n_blocks FROM (
        SELECT paper_key, section_id, id, max(length(text)) AS n, max(ordinal) AS o FROM blocks WHERE section_id IS NOT NULL GROUP BY 1, 2, 3)
      GROUP BY 1, 2""",
    "outline_parents": """
      WITH h AS (SELECT paper_key, ordinal, max(struct_pack(s := section_id, l := coalesce(level, -1))) AS x FROM sections WHERE ordinal IS NOT NULL GROUP BY 1, 2),
      r AS (SELECT paper_key, ordinal, x.s AS section_id, least(greatest(CASE WHEN x.l = -1 THEN 1 ELSE x.l END, 1), 6) AS level FROM h)
      SELECT a.paper_key, a.section_id, a.ordinal, arg_max(b.section_id, b.ordinal) AS level_parent
      FROM r a LEFT JOIN r b ON a.paper_key = b.paper_key AND b.ordinal < a.ordinal AND b.level < a.level GROUP BY 1, 2, 3""",
    "kind_histogram": "SELECT paper_key, coalesce(kind, 'none') AS kind, count(DISTINCT id) AS n FROM blocks GROUP BY 1, 2",
    "heading_sections": """
      WITH b AS (SELECT paper_key, ordinal, max(struct_pack(id := id, kind := coalesce(kind, ''))) AS x FROM blocks WHERE ordinal IS NOT NULL GROUP BY 1, 2),
      s AS (SELECT paper_key, last_value(CASE WHEN x.kind = 'heading' THEN x.id END IGNORE NULLS) OVER (PARTITION BY paper_key ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS section FROM b)
      SELECT paper_key, section, count(*) AS n_blocks FROM s GROUP BY 1, 2""",
    "read_windows": " UNION ALL ".join(
        f"""SELECT doc_id, substring(text, {at + 1}, 8000) AS "window", length(text)::BIGINT AS total, CASE WHEN length(text) > {at + 8000} THEN {at + 8000}::BIGINT END AS next_offset FROM documents"""
        for at in (0, 8000, 100)
    ),
    "fts_terms": f"WITH {_TOKENS} SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS token FROM kept) GROUP BY 1",
    "fts_bm25": f"""
      WITH {_TOKENS},
      f AS (SELECT doc_id, len(t) AS d, len(list_filter(t, lambda x: x = 'retrieval')) AS a, len(list_filter(t, lambda x: x = 'corpus')) AS b FROM kept),
      s AS (SELECT count(*) AS n, avg(d) AS m, sum((a > 0)::INT) AS na, sum((b > 0)::INT) AS nb FROM f),
      w AS (SELECT m, CASE WHEN ln((n - na + 0.5) / (na + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - na + 0.5) / (na + 0.5)) END AS ia,
                   CASE WHEN ln((n - nb + 0.5) / (nb + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nb + 0.5) / (nb + 0.5)) END AS ib FROM s)
      SELECT doc_id, round(-(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * d / m)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * d / m))), 6) AS score
      FROM f, w WHERE a > 0 AND b > 0""",
    "fts_boolean": f"WITH {_TOKENS} SELECT doc_id FROM kept WHERE list_contains(t, 'retrieval') OR (list_contains(t, 'ranking') AND NOT list_contains(t, 'corpus'))",
    "fts_phrase": f"WITH {_TOKENS} SELECT doc_id FROM kept WHERE (' ' || array_to_string(t, ' ') || ' ') LIKE '% zero shot %'",
    "neighbour_rank": f"WITH {_EDGES} SELECT cited, n_seeds FROM ranked",
    "fresh_neighbours": f"WITH {_EDGES}, {_CURRENT} SELECT cited, n_seeds FROM ranked WHERE cited NOT IN (SELECT {_DOI} FROM cur WHERE doi IS NOT NULL)",
    "stale_bundles": """
      WITH i AS (SELECT DISTINCT lower(key) AS key FROM papers), d AS (SELECT DISTINCT lower(trim(paper_key, ' ')) AS key FROM files WHERE paper_key <> '')
      SELECT coalesce(i.key, d.key) AS key, CASE WHEN d.key IS NULL THEN 'missing' ELSE 'unindexed' END AS state
      FROM i FULL JOIN d ON i.key = d.key WHERE d.key IS NULL OR i.key IS NULL""",
    "prune_sizes": r"""
      SELECT coalesce(nullif(regexp_extract(regexp_replace(rel_path, '^[./\\]+', ''), '^([^/\\]+)[/\\]', 1), ''), 'root') AS folder, count(*) AS n_files, sum(b)::BIGINT AS n_bytes
      FROM (SELECT paper_key, rel_path, max(bytes) AS b FROM files GROUP BY 1, 2) GROUP BY 1""",
    "events_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "dropped_papers": "SELECT key FROM papers GROUP BY 1 HAVING arg_max(status, (updated_at, created_at, status)) = 'dropped'",
    "paper_authors": f"""
      WITH {_CURRENT}, a AS (SELECT paper_key, count(*) AS n, string_agg(name, '; ' ORDER BY position, name) AS line FROM (SELECT DISTINCT paper_key, position, name FROM authors) GROUP BY 1)
      SELECT key, coalesce(n, 0) AS n_authors, coalesce(line, '') AS author_line FROM cur LEFT JOIN a ON key = paper_key""",
    "figure_positions": """
      SELECT paper_key, id, row_number() OVER (PARTITION BY paper_key ORDER BY array_to_string(list_transform(regexp_extract_all(id, '(\\d+|\\D+)'),
        lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN lpad(r, 20, '0') ELSE lower(r) END), ''), id) AS position FROM (SELECT DISTINCT paper_key, id FROM figures)""".replace("\\\\", "\\"),
    "candidate_priority": f"""
      WITH {_CURRENT}, c AS (
        SELECT key, 'https://arxiv.org/pdf/' || arxiv_id AS url, 'arxiv' AS kind, 0 AS s FROM cur WHERE arxiv_id IS NOT NULL
        UNION ALL SELECT key, 'https://doi.org/' || {_DOI}, 'doi', 1 FROM cur WHERE doi IS NOT NULL
        UNION ALL SELECT key, source_url, 'page', 2 FROM cur WHERE source_url IS NOT NULL),
      o AS (SELECT key, url, min(struct_pack(s := s, kind := kind)) AS f FROM c GROUP BY 1, 2)
      SELECT key, url, f.kind AS kind, row_number() OVER (PARTITION BY key ORDER BY f.s, url) - 1 AS priority FROM o""",
    "fts_indexed": f"""
      WITH {_TOKENS},
      f AS (SELECT doc_id, len(t) AS d, len(list_filter(t, lambda x: x = 'retrieval')) AS a, len(list_filter(t, lambda x: x = 'corpus')) AS b FROM kept),
      s AS (SELECT count(*) AS n, avg(d) AS m, sum((a > 0)::INT) AS na, sum((b > 0)::INT) AS nb FROM f),
      w AS (SELECT m, CASE WHEN ln((n - na + 0.5) / (na + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - na + 0.5) / (na + 0.5)) END AS ia,
                   CASE WHEN ln((n - nb + 0.5) / (nb + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - nb + 0.5) / (nb + 0.5)) END AS ib FROM s)
      SELECT 'terms' AS asked, doc_id, round(-(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * d / m)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * d / m))), 6) AS score
      FROM f, w WHERE a > 0 AND b > 0
      UNION ALL SELECT 'phrase', doc_id, 0.0 FROM kept WHERE (' ' || array_to_string(t, ' ') || ' ') LIKE '% zero shot %'""",
    "find_papers": f"""
      WITH {_CURRENT}, a AS (SELECT paper_key, string_agg(name, ', ' ORDER BY position, name) AS line FROM (SELECT DISTINCT paper_key, position, name FROM authors) GROUP BY 1)
      SELECT key FROM cur LEFT JOIN a ON key = paper_key WHERE contains(lower(title), 'an') OR contains(lower(abstract), 'an') OR contains(lower(coalesce(line, '')), 'an')""",
    "neighbour_ranked": f"""
      WITH r AS (SELECT DISTINCT src_key, bibkey, arxiv_id, doi, nullif({_DOI}, '') AS cited FROM refs), c AS (SELECT cited, count(*) AS n FROM r GROUP BY 1)
      SELECT r.cited, count(DISTINCT src_key) AS n_seeds, max(c.n) AS citation_count, true AS resolvable FROM r JOIN c ON r.cited = c.cited GROUP BY 1 HAVING count(DISTINCT src_key) >= 2""",
    "arxiv_sources": f"""WITH {_CURRENT} SELECT key, 'arxiv_html' AS kind, 'https://arxiv.org/html/' || arxiv_id AS url, 0 AS priority FROM cur WHERE arxiv_id IS NOT NULL
      UNION ALL SELECT key, 'pdf', 'https://arxiv.org/pdf/' || arxiv_id || '.pdf', 10 FROM cur WHERE arxiv_id IS NOT NULL""",
    "outline_ranges": """
      WITH b AS (SELECT paper_key, ordinal, max(struct_pack(id := id, kind := coalesce(kind, ''))) AS x FROM blocks WHERE ordinal IS NOT NULL GROUP BY 1, 2),
      n AS (SELECT paper_key, max(ordinal) + 1 AS n FROM b GROUP BY 1)
      SELECT b.paper_key, x.id AS block_id, ordinal AS start, coalesce(lead(ordinal) OVER (PARTITION BY b.paper_key ORDER BY ordinal), n) AS "end"
      FROM b JOIN n ON b.paper_key = n.paper_key WHERE x.kind = 'heading'""",
    "ir_coverage": """
      WITH d AS (SELECT DISTINCT record_id, doc_json FROM ir_documents WHERE json_valid(doc_json)),
      k AS (SELECT unnest(['math', 'figures', 'tables', 'bibitems', 'notes']) AS k),
      c AS (SELECT record_id, doc_json, coalesce(try_cast(json_extract_string(doc_json, '$.coverage.source_counts.' || k) AS INT), 0) AS s,
        coalesce(try_cast(json_extract_string(doc_json, '$.coverage.mapped_counts.' || k) AS INT), 0) AS m FROM d, k),
      t AS (SELECT record_id, doc_json, sum(s) AS s, sum(least(s, m)) AS m FROM c GROUP BY 1, 2)
      SELECT DISTINCT record_id, round(CASE WHEN s = 0 THEN 1.0 ELSE m / s END, 4) AS ratio, (CASE WHEN s = 0 THEN 1.0 ELSE m / s END) >= 0.95 AS ok FROM t""",
    "events_sliding": """
      SELECT w AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1""",
    "upsert_papers": """
      WITH o AS (SELECT key, arg_min(struct_pack(c := created_at, u := updated_at, s := status), (updated_at, status)) AS x FROM papers WHERE created_at = updated_at AND key IS NOT NULL GROUP BY 1),
      n AS (SELECT key, arg_max(struct_pack(u := updated_at, s := status), updated_at) AS l, arg_min(created_at, updated_at) AS c FROM papers WHERE created_at <> updated_at AND key IS NOT NULL GROUP BY 1)
      SELECT coalesce(o.key, n.key) AS key, coalesce(n.l.s, o.x.s) AS status, coalesce(o.x.c, n.c) AS created_at, coalesce(n.l.u, o.x.u) AS updated_at FROM o FULL JOIN n ON o.key = n.key""",
    "metadata_merge": f"""
      WITH {_CURRENT}, f AS (SELECT key, max(title) AS title, max(venue) AS venue, max(year) AS year, max(license) AS license FROM papers WHERE key IS NOT NULL GROUP BY 1)
      SELECT f.key, coalesce(nullif(cur.title, ''), nullif(f.title, '')) AS title, coalesce(nullif(cur.venue, ''), nullif(f.venue, '')) AS venue,
        coalesce(cur.year, f.year) AS year, coalesce(nullif(cur.license, ''), nullif(f.license, '')) AS license FROM f JOIN cur ON f.key = cur.key""",
    "markdown_text": r"""
      SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```[^\n]*\n?(.*?)```', '\1', 'g'),
        '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^#{1,6}\s*', '', 'g'), '[*_`>]', '', 'g'), '^\s+|\s+$', '', 'g') || chr(10)) AS plain_md5 FROM documents""",
    "source_identity": r"""
      WITH u AS (SELECT DISTINCT source_url, trim(source_url) AS u FROM papers WHERE source_url IS NOT NULL),
      p AS (SELECT source_url, u, lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, regexp_extract(u, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM u),
      k AS (SELECT source_url, host, path, regexp_extract(path, '^/(?:abs|pdf|html)/(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$', 1) AS arxiv FROM p)
      SELECT source_url, CASE WHEN arxiv <> '' AND host LIKE '%arxiv.org' THEN 'arxiv' WHEN host LIKE '%doi.org' THEN 'doi' ELSE 'url' END AS kind,
        sha256(CASE WHEN arxiv <> '' AND host LIKE '%arxiv.org' THEN 'arxiv:' || arxiv WHEN host LIKE '%doi.org' THEN 'doi:' || lower(trim(path, '/'))
          ELSE 'url:' || lower('https://' || host || path) END) AS key FROM k""",
}
