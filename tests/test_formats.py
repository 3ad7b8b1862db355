import hashlib

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import geometry
from quillgrid.sources import sinks


def test_crop_margins(spark):
    rows = [(1, [10.0, 20.0, 60.0, 90.0]), (2, [-5.0, 0.0, 500.0, 10.0]), (3, [5.0, 5.0, 5.0, 9.0]), (4, None), (5, [1.0])]
    df = spark.createDataFrame(rows, "id int, box array<double>")
    got = {r.id: r.m and tuple(r.m) for r in df.select("id", geometry.crop_margins(F.col("box"), F.lit(100.0), F.lit(200.0)).alias("m")).collect()}
    assert got == {1: (10.0, 110.0, 40.0, 20.0), 2: (0.0, 190.0, 0.0, 0.0), 3: None, 4: None, 5: None}


def test_formats(spark):
    df = spark.createDataFrame([("A\tb", ["X", "Y"], 2020, None, "u"), (None, None, None, None, None)], "title string, authors array<string>, year int, venue string, url string")
    assert [r.line for r in sinks.format_papers(df, "urls").collect()] == ["u"]
    assert [r.line for r in sinks.format_papers(df, "tsv").collect()] == ["A b\tX; Y\t2020\t\tu", "\t\t\t\t"]
    assert sinks.format_papers(df, "json").count() == 2
    with pytest.raises(ValueError):
        sinks.format_papers(df, "xml")


def test_checksums(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    row = sinks.checksums(spark, str(tmp_path), "*.txt").first()
    assert (row.bytes, row.sha256) == (5, hashlib.sha256(b"hello").hexdigest())
