"""The service layer: one object over a library folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.errors import BadRequest, NotFound, Unreadable
from quillgrid.functions import bibtex, media
from quillgrid.functions.text import escape_html, natural_key
from quillgrid.functions.urls import paper_identity
from quillgrid.operators import bundles, library, search
from quillgrid.operators import outline as reading
from quillgrid.session import cut_lineage
from quillgrid.sources.storage import Store
from quillgrid.sources.tables import current_papers, table

__all__ = ["Library", "NotFound", "connect"]
#: Tables whose rows belong to a paper, and the column that names it.
OWNED = {n: "paper_key" for n in ("authors", "sections", "blocks", "figures", "tables_index", "equations", "files", "annotations")} | {"papers": "key", "refs": "src_key"}


def connect(spark: SparkSession, folder: str, captures: str | None = None) -> "Library":
    """The library of a folder; if it holds no papers yet and ``captures`` names a folder of bundles, it is made from them."""
    lib = Library(spark, folder)
    if captures and (not lib.store.exists("papers.parquet") or lib.table("papers").isEmpty()):
        lib.reindex(captures)
    return lib


class Library:
    """Reads, searches and updates; every answer is a DataFrame unless it is one value."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = Store(spark, folder)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def papers(self) -> DataFrame:
        return current_papers(self.table("papers"))

    def key_of(self, key: str | None = None, url: str | None = None) -> str:
        """The key given, or that of a URL's identity."""
        if key:
            return key.strip().lower()
        return self.spark.range(1).select(paper_identity(F.lit(url))["key"].alias("k")).first().k

    def list_papers(self, query: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return library.list_papers(self.papers(), query, limit, offset)

    def find_papers(self, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
        """As ``list_papers``, but the query is taken as it stands and looked for in the authors too."""
        return library.list_with_authors(library.papers_with_authors(self.papers(), self.table("authors")), query, limit, offset)

    def load_entries(self, path: str, tolerant: bool = False) -> DataFrame:
        """(key, entry) of an index file, one JSON object by key; unreadable raises, or gives no rows if ``tolerant``."""
        text = self.spark.read.text(path, wholetext=True)
        parsed = text.select(F.from_json("value", "map<string,string>").alias("m"), F.try_parse_json("value").isNotNull().alias("ok"))
        if not tolerant and not parsed.where(~F.col("ok") | F.col("m").isNull()).isEmpty():
            raise Unreadable(f"{path} can't be read", "rebuild the index from the bundles")
        return parsed.where("m IS NOT NULL").select(F.explode("m").alias("key", "entry"))

    def get_paper(self, key: str) -> DataFrame:
        return library.papers_with_authors(self.papers().where(F.col("key") == key), self.table("authors").where(F.col("paper_key") == key))

    def stats(self) -> dict[str, DataFrame]:
        names = ("papers", "figures", "tables_index", "equations", "refs")
        return {
            "counts": library.table_counts({n: self.table(n) for n in names}),
            "by_extractor": library.count_by(self.papers(), "extractor", "unknown"),
            "by_year": library.count_by(self.papers(), "year").orderBy("value"),
            "by_category": library.count_by_category(self.papers(), "categories") if "categories" in self.table("papers").columns else self.spark.createDataFrame([], "value string, n long"),
        }

    def outline(self, key: str) -> DataFrame:
        return reading.outline(self.table("sections"), key)

    def read(self, key: str, section: str | None = None, offset: int = 0, max_chars: int = reading.READ_WINDOW) -> DataFrame:
        """One window of a paper's or a section's text: (paper_key, window, total, next_offset)."""
        blocks = self.table("blocks").where(F.col("paper_key") == key)
        if section is not None:
            text = reading.read_section(blocks, key, section).select("paper_key", "text")
        else:
            once = blocks.select("paper_key", "id", "ordinal", "text").where("text IS NOT NULL").distinct()
            parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))), lambda b: b["text"])
            text = once.groupBy("paper_key").agg(F.array_join(parts, "\n\n").alias("text"))
        if text.isEmpty():
            raise NotFound(f"text of {key}" + (f", section {section}" if section else ""), "see the outline")
        return reading.read_window(text, "text", offset, max_chars).drop("text")

    def grep(self, query: str, key: str | None = None, limit: int = 20) -> DataFrame:
        """Blocks that match, best first; scores are those of the whole library also for one paper."""
        docs = self.table("blocks").where("id IS NOT NULL AND text <> ''").select("paper_key", "id", "text").distinct()
        return search.grep(docs, query, ["paper_key", "id"], "text", limit, F.col("paper_key") == key if key else None)

    def _float(self, name: str, key: str, wanted: str) -> DataFrame:
        rows = self.table(name).where(F.col("paper_key") == key).dropDuplicates(["paper_key", "id"])
        found = library.find_float(rows, key, wanted, reading.positional(rows, "paper_key", "id", natural_key(F.col("id"))))
        if found.isEmpty():
            raise NotFound(f"{name} {wanted} of {key}")
        return found

    def get_figure(self, key: str, wanted: str) -> DataFrame:
        """The figure's row with ``image_paths`` and ``crop_file``, below the library's folder."""
        root = F.concat(F.lit(f"{self.folder}/"), F.col("paper_key"), F.lit("/"))
        paths = F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda i: F.concat(root, F.regexp_replace(i, r"^[./\\]+", "")))
        return self._float("figures", key, wanted).withColumn("image_paths", paths).withColumn("crop_file", F.concat(root, F.regexp_replace("crop_path", r"^[./\\]+", "")))

    def get_table(self, key: str, wanted: str) -> DataFrame:
        """The table's row; paths of sidecars that aren't among the bundle's files are null, and then ``html`` holds what is known of it."""
        row = self._float("tables_index", key, wanted)
        plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^[./]+", "")
        held = self.table("files").where(F.col("paper_key") == key).select(plain(F.col("rel_path")).alias("held")).distinct()
        for name in ("html_path", "csv_path"):
            row = row.join(held.withColumn("__there", F.lit(True)), plain(F.col(name)) == F.col("held"), "left").withColumn(name, F.when("__there", F.col(name))).drop("held", "__there")
        text = self.table("blocks").where((F.col("paper_key") == key) & (F.col("kind") == "table")).select("text").distinct()
        said = text.where(F.col("text").isNotNull()).agg(F.collect_list("text").alias("texts"))
        shown = F.concat(F.lit("<table><caption>"), escape_html(F.coalesce("caption", F.lit(""))), F.lit("</caption></table>"))
        caption = F.coalesce("caption", F.lit(""))
        own = F.filter("texts", lambda t: (caption != "") & t.startswith(caption))
        fallback = F.when(F.size(own) > 0, F.concat(F.lit("<pre>"), escape_html(F.get(own, 0)), F.lit("</pre>"))).otherwise(shown)
        return row.join(said).withColumn("html", F.when(F.col("html_path").isNull(), fallback)).drop("texts")

    def figure_payload(self, key: str, wanted: str) -> dict:
        """Images of one figure, base64 with their MIME types, and its caption; raises if none is stored."""
        figure = self.get_figure(key, wanted).first()
        names = [p for p in figure.image_paths if self.store.files.exists(self.store._path(p))]
        if not names:
            raise NotFound(f"image of figure {wanted}", "the bundle may have been pruned")
        read = self.spark.read.format("binaryFile").load(names)
        images = read.select(F.base64("content").alias("data"), media.mime_type(F.col("path")).alias("mimeType")).collect()
        label = figure.label or figure.id
        return {"images": [r.asDict() for r in images], "text": f"{label}: {figure.caption or ''}".strip(": ")}

    def figure_file(self, key: str, name: str) -> bytes:
        """One file of a paper's figures by name; names that lead elsewhere are refused."""
        if not self.spark.range(1).select(media.safe_member(F.lit(name))).first()[0]:
            raise BadRequest(f"{name} is no file name")
        path = f"{self.folder}/{key}/figures/{name}"
        if not self.store.files.exists(self.store._path(path)):
            raise NotFound(f"figure file {name} of {key}")
        return bytes(self.spark.read.format("binaryFile").load(path).first().content)

    def entries(self, keys: list[str] | None = None) -> DataFrame:
        """(key, bibkey, entry) of papers with a title, or with a stored entry, which wins; unknown keys are passed over."""
        papers = self.papers() if keys is None else self.papers().where(F.col("key").isin(list(keys)))
        rows = library.papers_with_authors(papers, self.table("authors"))
        stored = F.col("bibtex") if "bibtex" in rows.columns else F.lit(None).cast("string")
        primary = F.col("primary_category") if "primary_category" in rows.columns else F.lit(None).cast("string")
        base = bibtex.base_key(F.try_element_at("authors", F.lit(1)), F.col("year"), F.col("title"))
        rows = rows.withColumn("base", base).withColumn("held", bibtex.stored_key(stored))
        keyed = bibtex.with_unique_keys(rows, "base", ["key"], "held")
        columns = [F.col(c) for c in ("bibkey", "title", "authors", "year", "venue", "arxiv_id", "doi", "source_url")]
        text = F.coalesce(F.when(F.trim(stored) != "", F.trim(stored)), bibtex.entry(*columns, primary))
        return keyed.select("key", "bibkey", text.alias("entry")).where(F.col("entry") != "")

    def export_bibtex(self, keys: list[str] | None = None) -> DataFrame:
        """(key, bibkey, entry), in order of the key."""
        return self.entries(keys).orderBy("key")

    def bibliography(self, keys: list[str] | None = None) -> str:
        return bibtex.bibliography(self.entries(keys), ["key"]).first().document

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write a table anew and swap it in, while no other writer may."""
        with self.store.lock():
            self.store.replace(f"{name}.parquet", rows)

    def change(self, name: str, make) -> None:
        """Read a table, put ``make(rows)`` in its place; the lock is held over both, so two writers lose no update."""
        with self.store.lock():
            self.store.replace(f"{name}.parquet", make(self.table(name)))

    def reindex(self, captures: str, keys: list[str] | None = None, blocks_of: DataFrame | None = None) -> dict[str, int]:
        """Index all bundles of a folder, or those of the given keys, and drop papers whose bundle is gone; counts of both.

        ``created_at`` of known papers stays; authors, sections, blocks and files of what is indexed are put in anew; annotations stay.
        """
        meta = bundles.scan_meta(self.spark, captures)
        there = meta.select("key")
        if keys is not None:
            meta = meta.where(F.col("key").isin(list(keys)))
        new = bundles.papers_of(meta, F.current_timestamp())
        made = bundles.children_of(self.spark, captures, meta, blocks_of)
        with self.store.lock():
            if self.store.exists("papers.parquet"):
                old = self.table("papers")
                types = dict(new.dtypes)
                old = old.withColumns({c: F.lit(None).cast(types[c]) for c in new.columns if c not in old.columns})
                gone = old.select("key").distinct().join(there, "key", "left_anti") if keys is None else there.where(F.lit(False))
                stale = cut_lineage(gone)  # what it is made from is replaced below
                merged = library.upsert(current_papers(old).select(*new.columns), new, "key", ("created_at",), F.col("updated_at"))
                pruned = stale.count()
                self.store.replace("papers.parquet", merged.join(stale, "key", "left_anti"))
            else:
                stale, pruned = there.where(F.lit(False)), 0
                self.store.replace("papers.parquet", new)
            touched = meta.select("key").unionByName(stale).distinct()
            for name, rows in made.items():
                if self.store.exists(f"{name}.parquet"):
                    rows = bundles.replace_children(self.table(name), rows, "paper_key", touched)
                self.store.replace(f"{name}.parquet", rows)
        return {"indexed": meta.count(), "pruned": pruned}

    def upsert_papers(self, new: DataFrame) -> None:
        self.change("papers", lambda old: library.upsert(current_papers(old), new, "key", ("created_at",), F.col("updated_at")))

    def drop_papers(self, keys: DataFrame, column: str = "key") -> None:
        """Take papers and everything that belongs to them out of all tables."""
        held = {n: (self.table(n), c) for n, c in OWNED.items() if self.store.exists(f"{n}.parquet")}
        for name, rows in library.cascade_drop(held, keys, column).items():
            self.replace(name, rows)

    def annotate(self, key: str, quote: str, note: str) -> None:
        row = self.spark.range(1).select(
            F.expr("uuid()").alias("id"), F.lit(key).alias("paper_key"), F.lit(quote).alias("quote"), F.lit(note).alias("note"), F.current_timestamp().alias("created_at")
        )
        row.write.mode("append").parquet(f"{self.folder}/annotations.parquet")

    def annotations(self, key: str) -> DataFrame:
        return self.table("annotations").where(F.col("paper_key") == key).orderBy("created_at")
