"""Manifests of papers to ingest: JSON, JSONL, CSV, TSV, text, Python literals, Markdown lists."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.text import slug
from quillgrid.functions.urls import host_of, none_if_empty, paper_identity, trimmed

COLUMNS = ["slug", "title", "url", "source", "ord"]


def inline_spec(spec: Column) -> Column:
    """STRUCT(slug, title, url) of ``slug|title|url``, ``title|url`` or ``url``."""
    parts = F.transform(F.split(spec, r"\|", 3), trimmed)
    n = F.size(parts)
    return F.struct(
        F.when(n == 3, parts[0]).alias("slug"),
        F.when(n == 3, F.get(parts, 1)).when(n == 2, parts[0]).alias("title"),
        F.element_at(parts, -1).alias("url"),
    )


def _finish(rows: DataFrame, source: str) -> DataFrame:
    """Rows with a url; the title falls back to the name, then ``paper``; the slug to that of the title."""
    filled = lambda c: none_if_empty(trimmed(F.col(c).cast("string")))
    for c in ("slug", "title", "name", "url"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    title = F.coalesce(filled("title"), filled("name"), F.lit("paper"))
    return (
        rows.where(filled("url").isNotNull())
        .select(F.coalesce(filled("slug"), slug(title)).alias("slug"), title.alias("title"), filled("url").alias("url"), F.lit(source).alias("source"), "ord")
    )


def _from_json(values: DataFrame, source: str) -> DataFrame:
    """``values``: (json, ord), each the JSON of an object or string; anything else is left out."""
    keys = ("slug", "title", "name", "url")
    obj = F.from_json("json", "struct<slug:string,title:string,name:string,url:string>")
    spec = F.get_json_object(F.concat(F.lit('{"v":'), F.col("json"), F.lit("}")), "$.v")
    objects = values.where(F.ltrim("json").startswith("{")).select(obj.alias("o"), "ord").select(*[f"o.{k}" for k in keys], "ord")
    strings = values.where(F.ltrim("json").startswith('"')).select(inline_spec(spec).alias("o"), "ord").select("o.*", F.lit(None).cast("string").alias("name"), "ord")
    return _finish(objects.unionByName(strings), source)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of objects and inline specs; raises if the file holds no list."""
    text = spark.read.text(path, wholetext=True)
    if not text.where(~F.ltrim("value").startswith("[")).isEmpty():
        raise ValueError(f"{path}: a JSON manifest must be a list")
    parsed = text.select(F.variant_get(F.parse_json("value"), "$", "array<variant>").alias("a"))
    return _from_json(parsed.select(F.posexplode("a").alias("ord", "v")).select(F.to_json("v").alias("json"), F.col("ord").cast("long").alias("ord")), path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("ord"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _from_json(_lines(spark, path).where(F.trim("value") != "").select(F.col("value").alias("json"), "ord"), path)


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """With a header; a value can't hold a line break."""
    rows = spark.read.csv(path, header=True, sep=sep).withColumn("ord", F.monotonically_increasing_id())
    return _finish(rows, path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One inline spec per line; blank lines and lines that begin with ``#`` are passed over."""
    lines = _lines(spark, path).withColumn("value", trimmed(F.col("value"))).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return _finish(lines.select(inline_spec(F.col("value")).alias("o"), "ord").select("o.*", "ord"), path)


def _papers_of(code: str) -> list[tuple[str | None, str | None, str | None]]:
    """(slug, title, url) of the calls in a list assigned to PAPERS; only literals count."""
    found = []
    for node in ast.parse(code).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        if not any(isinstance(t, ast.Name) and t.id == "PAPERS" for t in targets) or not isinstance(node.value, ast.List | ast.Tuple):
            continue
        for call in node.value.elts:
            if isinstance(call, ast.Call):
                literal = lambda v: v.value if isinstance(v, ast.Constant) and isinstance(v.value, str) else None
                given = dict(zip(("slug", "title", "url"), map(literal, call.args)))
                given |= {k.arg: literal(k.value) for k in call.keywords if k.arg}
                found.append((given.get("slug"), given.get("title"), given.get("url")))
    return found


def read_python(spark: SparkSession, path: str) -> DataFrame:
    """``PAPERS = [Paper(slug, title, url), …]``, positional or by keyword, with or without annotation. Never run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*p, i) for code in batch["value"] for i, p in enumerate(_papers_of(code))]
            yield pd.DataFrame(rows, columns=["slug", "title", "url", "ord"])

    return _finish(spark.read.text(path, wholetext=True).mapInPandas(run, "slug string, title string, url string, ord long"), path)


READERS = {"json": read_json, "jsonl": read_jsonl, "csv": read_csv, "py": read_python}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "tsv":
        return read_csv(spark, path, "\t")
    return READERS.get(kind, read_text)(spark, path)


def collect_inputs(spark: SparkSession, manifests: list[str] = (), specs: list[str] = (), url_list: list[str] = ()) -> DataFrame:
    """All inputs in order (manifests, inline specs, urls), the first of each paper (by fingerprint) only."""
    parts = [read_manifest(spark, p) for p in manifests]
    for given in (specs, url_list):
        if given:
            rows = spark.createDataFrame([(s, i) for i, s in enumerate(given)], "value string, ord long")
            parts.append(_finish(rows.select(inline_spec(F.col("value")).alias("o"), "ord").select("o.*", "ord"), "arguments"))
    if not parts:
        raise ValueError("no input")
    union = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("part", F.lit(i))
        union = tagged if union is None else union.unionByName(tagged)
    keyed = union.withColumn("identity", paper_identity(F.col("url")))
    w = Window.partitionBy("identity.fingerprint").orderBy("part", "ord")
    return keyed.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


# Labels and hosts of links that are never the paper, and hosts of papers, the best first.
OTHER_LABELS = ["code", "data", "dataset", "demo", "homepage", "page", "project", "video", "website"]
OTHER_HOSTS = ["github.com", "gitlab.com", "huggingface.co", "youtu.be", "youtube.com"]
PREFERRED = [
    "arxiv.org", "openreview.net", "aclanthology.org", "proceedings.mlr.press", "openaccess.thecvf.com", "ncbi.nlm.nih.gov", "doi.org",
    "biorxiv.org", "medrxiv.org",
]


def read_markdown_list(spark: SparkSession, path: str, sections: list[str] = ()) -> DataFrame:
    """Bullets of Markdown lists with ``[[label]](url)`` links: (file, section, title, url, slug, reason, ord).

    The section of a bullet is the last heading before it; ``sections`` are compared without case. Links by label or host that are never the paper are passed
    over; of the others the most preferred host counts, then the first. ``reason`` says why a bullet has no url. Slugs
    are unique within a file. Each file is a document of its own; a window runs over its headings' lines, not over all files.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("line").rlike(r"^#{1,6}\s"), trimmed(F.regexp_replace("line", "^#+", "")))
    rows = files.withColumn("section", F.last(heading, ignorenulls=True).over(w)).where(F.col("line").rlike(r"^\s*[-*+]\s"))
    if sections:
        rows = rows.where(F.lower("section").isin([x.strip().lower() for x in sections]))
    link = r"\[\[([^\]]+)\]\]\((https?://[^)]+)\)"
    host = lambda u: F.regexp_replace(host_of(u), r"^www[.]", "")
    ends = lambda u, names: F.filter(F.array(*map(F.lit, names)), lambda n: host(u).endswith(n))
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(link), 1).alias("label"), F.regexp_extract_all("line", F.lit(link), 2).alias("url"))
    usable = F.filter(pairs, lambda p: ~F.lower(trimmed(p["label"])).isin(OTHER_LABELS) & (F.size(ends(p["url"], OTHER_HOSTS)) == 0))
    rank = lambda u: F.coalesce(F.array_min(F.transform(ends(u, PREFERRED), lambda n: F.array_position(F.array(*map(F.lit, PREFERRED)), n))), F.lit(len(PREFERRED) + 1))
    ranked = F.array_sort(F.transform(usable, lambda p, i: F.struct(rank(p["url"]).cast("int").alias("rank"), i.alias("i"), p["url"].alias("url"))))
    title = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^\s*[-*+]\s+", ""), link, ""), r"^[ .;:–—-]+|[ .;:–—-]+$", "")
    found = (
        rows.select("file", "ord", "section", pairs.alias("pairs"), ranked.alias("ranked"), title.alias("title"))
        .where(F.col("title") != "")
        .withColumn("best", F.get("ranked", 0))
    )
    known = F.col("best.rank") <= len(PREFERRED)
    chosen = found.select(
        "file", "section", "title", F.when(known, F.col("best.url")).alias("url"),
        F.when(F.size("pairs") == 0, "no link").when(F.col("best").isNull(), "only code/data links").when(~known, F.concat(F.lit("no retrievable source ("), host(F.col("best.url")), F.lit(")"))).alias("reason"),
        "ord",
    )
    base = F.coalesce(none_if_empty(F.substring(F.array_join(F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda x: x != ""), "-"), 1, 60)), F.lit("paper"))
    return with_unique(chosen.withColumn("base", F.when(F.col("url").isNotNull(), base)), "base", "slug", ["file"], ["ord"]).drop("base")


def with_unique(rows: DataFrame, base: str, name: str, within: list[str], order: list[str]) -> DataFrame:
    """``name``: the base for its first row, then with ``-2``, ``-3``, …, unless that is a base of its own, which is told apart by one more number."""
    w = Window.partitionBy(*within, base).orderBy(*order)
    numbered = rows.withColumn("__n", F.row_number().over(w))
    numbered = numbered.withColumn("__k", F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("__n"))))
    again = Window.partitionBy(*within, "__k").orderBy("__n", *order)
    return numbered.withColumn("__m", F.row_number().over(again)).withColumn(name, F.when(F.col("__m") == 1, F.col("__k")).otherwise(F.concat("__k", F.lit("-"), F.col("__m")))).drop("__n", "__k", "__m")
