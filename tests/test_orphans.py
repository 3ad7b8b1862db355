from datetime import datetime

from pyspark.sql import functions as F

from quillgrid.operators import orphans

T0 = datetime(2024, 1, 2)
PAPERS = "key string, status string, created_at timestamp, updated_at timestamp, id string"
FIGURES = "id string, paper_key string, crop_path string, indexed_at timestamp, status string"
TABLES = "id string, paper_key string, indexed_at timestamp"
FILES = "paper_key string, rel_path string, indexed_at timestamp"


def library(spark, papers=(), figures=(), tables=(), files=()):
    return [spark.createDataFrame(list(r), s) for r, s in ((papers, PAPERS), (figures, FIGURES), (tables, TABLES), (files, FILES))]


def test_found(spark):
    papers = [
        ("a", "indexed", T0, T0, "x"), ("b", "indexed", T0, T0, "x"), ("b", "dropped", T0, datetime(2024, 3, 1), "x"),
        ("c", "dropped", T0, T0, "x"), ("c", "indexed", T0, datetime(2024, 3, 1), "x"), (None, "indexed", T0, T0, "x"),
    ]
    figures = [
        ("f1", " A\n", "./crops\\f1.png", T0, None), ("f2", "a", "crops/gone.png", T0, None), ("f2", "a", "crops/gone.png", T0, None),
        ("f3", "b", "crops/f3.png", T0, None), ("f4", "", "x", T0, None), ("f5", None, "x", T0, None), ("f6", "c", None, T0, None),
        ("f7", "zz", None, None, None), ("f8", "a", "/", T0, None), ("f9", "c", "crops/p/../f9.png", T0, None),
    ]
    tables = [("t1", "B", T0), (None, "zz", T0)]
    files = [("A", "crops//f1.png", T0), ("c", "/crops/f9.png", T0), ("zz", "paper.pdf", T0), (None, "q", T0)]
    expected = {
        ("figures", "crop_path", "a", "f2"), ("figures", "paper_key", "b", "f3"), ("figures", "paper_key", "zz", "f7"),
        ("tables_index", "paper_key", "b", "t1"), ("tables_index", "paper_key", "zz", None), ("files", "paper_key", "zz", "paper.pdf"),
    }
    tables_in = library(spark, papers, figures, tables, files)
    for split in ({}, {"heavy_rows": 1, "heavy_keys_max": 1}, {"heavy_rows": 1}):
        got = [tuple(r) for r in orphans.found(*tables_in, **split).collect()]
        assert set(got) == expected and len(got) == len(expected)
    months = {(r.ref_table, r.ref_field, r.month): (r.n_rows, r.n_items) for r in orphans.monthly(*tables_in).collect()}
    assert months[("figures", "crop_path", "2024-01")] == (2, 1)
    assert months[("figures", "paper_key", None)] == (1, 1)


def test_empty(spark):
    assert orphans.found(*library(spark)).count() == 0
    none = orphans.found(*library(spark, figures=[("f", "k", "p", T0, None)]))
    assert [tuple(r) for r in none.collect()] == [("figures", "paper_key", "k", "f")]


def test_hot_key_counts(spark):
    refs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.lit("t").alias("g"))
    parents = spark.createDataFrame([("k1",), ("k1",)], "k string")
    got = orphans.orphan_counts(refs, parents, ["k"], ["g"], F.lit("p"), heavy_rows=500)
    counts = {r.k: r.n_refs for r in got.collect()}
    assert counts["hot"] == 1000 and "k1" not in counts and sum(counts.values()) == 3000 - refs.where("k = 'k1'").count()
