"""Bundles, the folders that captures are stored in, and the library's tables made from them.

A bundle is a folder named by the paper's key with ``meta.json``, and perhaps ``document.json`` (blocks, bibliography),
``paper.md`` and members in subfolders. Scans read all bundles of a library at once, as files with paths; nothing walks folders on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.urls import none_if_empty
from quillgrid.operators import nested, outline

META = """struct<key:string,slug:string,identity_kind:string,identity_value:string,identity_fingerprint:string,title:string,abstract:string,year:int,venue:string,
  doi:string,arxiv_id:string,license:string,source_url:string,extractor:string,source_kind:string,created_at:timestamp,updated_at:timestamp,
  authors:array<string>,categories:array<string>,primary_category:string,published:string,updated:string,bibtex:string,pdf:string,md:string,document:string,
  coverage:struct<ratio:double,ok:boolean>>"""
# Fields of an index entry, those that always stand in it and those only if they hold anything.
ENTRY_FIELDS = ["slug", "title", "source_url", "identity_kind", "identity_value", "identity_fingerprint", "pdf", "md", "document", "extractor", "updated_at", "coverage_ratio", "coverage_ok"]
ENTRY_OPTIONAL = ["authors", "abstract", "year", "venue", "categories", "primary_category", "doi", "arxiv_id", "published", "updated", "bibtex", "license"]


def _member(path: Column) -> tuple[Column, Column]:
    """(key, path within the bundle) of a file's path; the key is the folder below the library."""
    return F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1), F.regexp_extract(path, r"([^/]+)$", 1)


def scan_meta(spark: SparkSession, library: str) -> DataFrame:
    """(key, meta): bundles with a readable ``meta.json``; folders that begin with a dot are none."""
    files = spark.read.text(f"{library}/*/meta.json", wholetext=True).withColumn("path", F.input_file_name())
    key, _ = _member(F.col("path"))
    rows = files.select(key.alias("key"), F.from_json("value", META).alias("meta")).where(~F.col("key").startswith("."))
    return rows.where(F.col("meta").isNotNull())


def scan_texts(spark: SparkSession, library: str, name: str) -> DataFrame:
    """(key, text) of one member of all bundles."""
    files = spark.read.text(f"{library}/*/{name}", wholetext=True).withColumn("path", F.input_file_name())
    key, _ = _member(F.col("path"))
    return files.select(key.alias("key"), F.col("value").alias("text")).where(~F.col("key").startswith("."))


def scan_files(spark: SparkSession, library: str) -> DataFrame:
    """(paper_key, rel_path, bytes, modified) of all members; contents aren't read, as the column is pruned."""
    root = library.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), root.replace("file://", "").rstrip("/") + "/", -1)
    key, rel = F.substring_index(tail, "/", 1), F.regexp_replace(tail, "^[^/]+/", "")
    return files.select(key.alias("paper_key"), rel.alias("rel_path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where(
        ~F.col("paper_key").startswith(".") & (F.col("rel_path") != "checksums.json") & tail.contains("/")
    )


def papers_of(meta: DataFrame, now: Column) -> DataFrame:
    """Rows of ``papers`` of scanned bundles."""
    m = lambda f: F.col(f"meta.{f}")
    same = ["identity_kind", "identity_value", "title", "abstract", "year", "venue", "doi", "arxiv_id", "license", "source_url", "extractor", "source_kind"]
    return meta.select(
        "key",
        *[m(c).alias(c) for c in same],
        m("identity_fingerprint").alias("fingerprint"),
        m("coverage.ratio").alias("coverage_ratio"),
        F.coalesce(m("coverage.ok"), F.lit(False)).alias("coverage_ok"),
        F.lit("indexed").alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.col("key").alias("bundle_path"),
        F.coalesce(m("created_at"), m("updated_at"), now).alias("created_at"),
        F.coalesce(m("updated_at"), now).alias("updated_at"),
        *[m(c).alias(c) for c in ("categories", "primary_category", "bibtex")],
    )


def index_entries(meta: DataFrame) -> DataFrame:
    """(key, entry): the JSON of each index entry, optional fields only where they hold anything."""
    m = lambda f: F.col(f"meta.{f}")
    value = {"coverage_ratio": m("coverage.ratio"), "coverage_ok": m("coverage.ok")}
    full = lambda f: F.when(F.size(m(f)) > 0, m(f)) if f in ("authors", "categories") else F.when(m(f).cast("string") != "", m(f))
    fields = [(value[f] if f in value else m(f)).alias(f) for f in ENTRY_FIELDS] + [full(f).alias(f) for f in ENTRY_OPTIONAL]
    return meta.select("key", F.to_json(F.struct(*fields)).alias("entry"))


def needs_metadata(meta: DataFrame) -> DataFrame:
    """Keys of bundles without authors or year."""
    return meta.where((F.size(F.coalesce("meta.authors", F.array().cast("array<string>"))) == 0) | (F.coalesce("meta.year", F.lit(0)) == 0)).select("key")


def content_chars(documents: DataFrame, key: str, json: str) -> DataFrame:
    """(key, n_blocks, content_chars): characters of the blocks' texts, formulas and inlines, and of their items' texts and inlines.

    From the flat tables of the nested documents: text of leaf inlines and of blocks is added up per document.
    """
    flat = nested.flatten_documents(documents, key, json)
    at = lambda f: F.coalesce(F.length(F.get_json_object("node", f"$.{f}")), F.lit(0))
    path = F.col("node_path")
    block = path.rlike(r"^/blocks/\d+$")
    inline = path.rlike(r"^/blocks/\d+(?:/items/\d+)?/inlines(?:/\d+)?(?:/children(?:/\d+)?)*$") & (F.col("target") == "inline")
    leaf = F.get_json_object("node", "$.children").isNull()
    bare = ~F.ltrim("node").startswith("{")
    n = F.when(block, at("text") + at("tex")).when(inline & bare, F.length("node")).when(inline & leaf, F.when(at("tex") > 0, at("tex")).otherwise(at("text"))).otherwise(0)
    return flat.groupBy(key).agg(F.sum(block.cast("int")).alias("n_blocks"), F.sum(n).alias("content_chars"))


def children_of(spark: SparkSession, library: str, meta: DataFrame, blocks_of: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that belong to papers, made from bundles: authors, sections, blocks, files.

    Blocks come from ``blocks_of`` (paper_key, ordinal, kind, block_id, level, text, as extraction gives them) where a paper has
    any, else from its Markdown: every line that begins with ``#`` opens a section, the text between is one paragraph.
    """
    authors = meta.select(F.col("key").alias("paper_key"), F.posexplode("meta.authors").alias("position", "name"))
    markdown = scan_texts(spark, library, "paper.md").withColumnRenamed("key", "paper_key").join(meta.select(F.col("key").alias("paper_key")), "paper_key", "left_semi")
    if blocks_of is not None:
        markdown = markdown.join(blocks_of.select("paper_key").distinct(), "paper_key", "left_anti")
    cut = outline.markdown_sections(markdown, "paper_key", "text")
    sections = cut.where("section_id IS NOT NULL").select(
        "paper_key", "section_id", F.lit(None).cast("string").alias("parent_id"), F.col("level").cast("int"), "title", F.col("section_no").cast("int").alias("ordinal"),
        F.lit(0).alias("start_block"), F.lit(0).alias("end_block"), F.length("body").alias("char_count"),
    )
    blocks = cut.where("body <> ''").select(
        F.xxhash64("paper_key", "section_no").alias("id"), "paper_key", "section_id", F.col("block_ordinal").cast("int").alias("ordinal"), F.lit("paragraph").alias("kind"), F.col("body").alias("text")
    )
    if blocks_of is not None:
        rows = outline.current_section(blocks_of, "paper_key", "ordinal", F.col("kind") == "heading", "block_id").where(F.col("kind") != "bibliography")
        blocks = blocks.unionByName(
            rows.where(F.col("text") != "").select(F.xxhash64("paper_key", "ordinal").alias("id"), "paper_key", F.col("section").alias("section_id"), "ordinal", "kind", "text")
        )
        heads = outline.heading_parents(blocks_of.where("kind = 'heading'"), "paper_key", "ordinal", "level", "block_id")
        ends = rows.where("section IS NOT NULL").groupBy("paper_key", "section").agg(F.sum(F.length("text")).alias("n"), F.max("ordinal").alias("e"))
        sections = sections.unionByName(
            heads.join(ends.withColumnRenamed("section", "block_id"), ["paper_key", "block_id"], "left").select(
                "paper_key", F.col("block_id").alias("section_id"), F.col("parent").alias("parent_id"), "level", F.col("text").alias("title"), "ordinal",
                F.col("ordinal").alias("start_block"), F.coalesce("e", "ordinal").cast("int").alias("end_block"), F.coalesce("n", F.lit(0)).cast("int").alias("char_count"),
            )
        )
    files = scan_files(spark, library).select("paper_key", "rel_path", F.lit(None).cast("string").alias("sha256"), "bytes", F.lit(None).cast("string").alias("media_type"))
    return {"authors": authors, "sections": sections, "blocks": blocks, "files": files.join(meta.select(F.col("key").alias("paper_key")), "paper_key", "left_semi")}


def replace_children(old: DataFrame, new: DataFrame, owner: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """``old`` with all rows of the given owners taken out and ``new`` put in; columns that only one side has are null."""
    gone = keys.select(F.col(key).alias("__k")).distinct()
    kept = old.join(gone, F.col(owner) == F.col("__k"), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def outline_ranges(blocks: DataFrame) -> DataFrame:
    """(paper_key, block_id, level, title, start, end): each heading with the blocks up to the next heading; the end isn't included."""
    w = Window.partitionBy("paper_key").orderBy("start")
    sizes = blocks.groupBy("paper_key").agg((F.max("ordinal") + 1).alias("n"))
    heads = blocks.where("kind = 'heading'").select("paper_key", "block_id", "level", F.col("text").alias("title"), F.col("ordinal").alias("start"))
    return heads.join(sizes, "paper_key").withColumn("end", F.coalesce(F.lead("start").over(w), "n")).drop("n")


def state_of(index: DataFrame, meta: DataFrame, files: DataFrame, hours: int = 6, now: Column | None = None) -> DataFrame:
    """(paper_key, state): ``missing`` entries without a bundle, ``unindexed`` bundles without an entry, ``orphan`` folders without
    ``meta.json``, and ``stale`` scratch folders (their names begin with a dot) not touched for so many hours."""
    held, there = index.select("key").distinct(), meta.select("key").distinct()
    folders = files.groupBy("paper_key").agg(F.max("modified").alias("modified"))
    tag = lambda df, c, state: df.select(F.col(c).alias("paper_key"), F.lit(state).alias("state"))
    scratch = F.col("paper_key").startswith(".")
    late = F.col("modified") < (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return (
        tag(held.join(there, "key", "left_anti"), "key", "missing")
        .unionByName(tag(there.join(held, "key", "left_anti"), "key", "unindexed"))
        .unionByName(tag(folders.where(~scratch).join(there.withColumnRenamed("key", "paper_key"), "paper_key", "left_anti"), "paper_key", "orphan"))
        .unionByName(tag(folders.where(scratch & late), "paper_key", "stale"))
    )


def asset_report(images: DataFrame) -> DataFrame:
    """(paper_key, images_total, images_downloaded, images_failed, images_reused, bytes_total) of (paper_key, src, ok, bytes), a row a use.

    A source that stands in several figures is loaded once; its further uses are reused, and count as downloaded too.
    """
    per = images.groupBy("paper_key", "src").agg(F.count(F.lit(1)).alias("uses"), F.max("ok").alias("ok"), F.max("bytes").alias("bytes"))
    got = F.coalesce("ok", F.lit(False))
    return per.groupBy("paper_key").agg(
        F.sum("uses").alias("images_total"),
        F.sum(F.when(got, F.col("uses")).otherwise(0)).alias("images_downloaded"),
        F.sum(F.when(got, 0).otherwise(F.col("uses"))).alias("images_failed"),
        F.sum(F.when(got, F.col("uses") - 1).otherwise(0)).alias("images_reused"),
        F.sum(F.when(got, F.coalesce("bytes", F.lit(0))).otherwise(0)).alias("bytes_total"),
    )


def with_crops(floats: DataFrame, crops: DataFrame, pages: DataFrame) -> DataFrame:
    """Figures or tables with ``pdf_page`` and ``crop_path`` of a rendering report, joined on (paper_key, id); others keep theirs."""
    report = pages.select("paper_key", "id", F.col("page").alias("__page")).join(crops.select("paper_key", "id", F.col("path").alias("__path")), ["paper_key", "id"], "full_outer")
    return (
        floats.join(report, ["paper_key", "id"], "left")
        .withColumn("pdf_page", F.coalesce("__page", "pdf_page"))
        .withColumn("crop_path", F.coalesce(none_if_empty(F.col("__path")), "crop_path"))
        .drop("__page", "__path")
    )


def figure_manifest(figures: DataFrame) -> DataFrame:
    """(paper_key, manifest): the JSON list of a paper's figures in order of id, repeats once."""
    entry = F.struct("id", "label", "caption", "images")
    once = figures.select("paper_key", entry.alias("e")).distinct()
    return once.groupBy("paper_key").agg(F.to_json(F.array_sort(F.collect_list("e"))).alias("manifest"))


def project_markdown(markdown: Column, folder: Column) -> Column:
    """Markdown for a project: links to ``figures/`` lead to the paper's own folder of figures."""
    return F.regexp_replace(markdown, F.lit(r"(!\[[^\]]*\]\()(?:[.]/)?figures/"), F.concat(F.lit("$1"), folder, F.lit("/figures/")))
