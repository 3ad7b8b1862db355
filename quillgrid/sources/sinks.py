"""Output formats of result lists, and checksums of stored files."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["title", "authors", "year", "venue", "url"]


def format_papers(papers: DataFrame, kind: str) -> DataFrame:
    """(line): ``urls`` one URL a line, ``tsv`` tab-separated with ``;`` between authors, ``json`` an object a line.

    Rows without a URL have no ``urls`` line. Tabs and line breaks within a value become blanks.
    """
    if kind == "urls":
        return papers.where(F.col("url").isNotNull()).select(F.col("url").alias("line"))
    if kind == "tsv":
        flat = [F.array_join("authors", "; ") if c == "authors" else F.col(c).cast("string") for c in FIELDS]
        clean = [F.coalesce(F.regexp_replace(c, r"[\t\r\n]+", " "), F.lit("")) for c in flat]
        return papers.select(F.concat_ws("\t", *clean).alias("line"))
    if kind == "csv":
        quoted = lambda c: F.when(c.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
        flat = [F.array_join(c, ";") if dict(papers.dtypes)[c].startswith("array") else F.col(c).cast("string") for c in papers.columns]
        return papers.select(F.array_join(F.array(*[quoted(F.coalesce(c, F.lit(""))) for c in flat]), ",").alias("line"))
    if kind in ("json", "manifest"):
        return papers.select(F.to_json(F.struct(*papers.columns)).alias("line"))
    raise ValueError(f"unknown format {kind}")


def checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_json(path: str, value: object) -> None:
    """One small JSON file of the driver, keys sorted: written beside, flushed to disk, then renamed, so that no reader sees half of it."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder, prefix=".", suffix=".json")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def write_sidecars(tables: DataFrame, folder: str) -> DataFrame:
    """Write each table's ``table_html`` and ``table_csv`` as files of Parquet-partitioned text below ``folder``; give the manifest rows.

    ``tables``: (paper_key, id, label, caption, table_html, table_csv). The texts go to ``folder/html`` and ``folder/csv``, partitioned by the
    first two signs of the paper's key, (paper_key, id, content) a row, written by the executors.
    """
    bucket = F.substring("paper_key", 1, 2).alias("key_bucket")
    for name in ("html", "csv"):
        part = tables.where(F.col(f"table_{name}").isNotNull()).select("paper_key", "id", F.col(f"table_{name}").alias("content"), bucket)
        part.write.mode("overwrite").partitionBy("key_bucket").parquet(f"{folder}/{name}")
    return tables.select("paper_key", "id", "label", "caption", F.concat(F.lit("html/"), "id").alias("html_path"), F.concat(F.lit("csv/"), "id").alias("csv_path")).distinct()


# An empty manifest with the columns that a reader looks for.
TEMPLATE = {"csv": "slug,title,url\n", "tsv": "slug\ttitle\turl\n", "json": "[]\n", "jsonl": "", "txt": "# slug|title|url\n"}


def manifest_template(path: str) -> None:
    """Write an empty manifest of the kind that the name asks for; an existing file stays."""
    kind = path.rsplit(".", 1)[-1].lower()
    with open(path, "x", encoding="utf-8") as f:
        f.write(TEMPLATE.get(kind, TEMPLATE["txt"]))
