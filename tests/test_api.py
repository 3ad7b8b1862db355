import shutil

import pytest
from pyspark.sql import functions as F

from quillgrid.api import Library, NotFound

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def lib(spark, tmp_path):
    for n in ("papers", "authors", "sections", "blocks", "figures", "tables_index", "equations", "files", "refs"):
        shutil.copy(f"{DATA}/{n}.parquet", tmp_path / f"{n}.parquet")
    return Library(spark, str(tmp_path))


def test_reads(lib):
    key = lib.table("sections").groupBy("paper_key").count().orderBy("count").first().paper_key
    assert lib.get_paper(key).count() <= 1 and lib.outline(key).count() > 0
    window = lib.read(key, max_chars=50).first()
    assert len(window.window) <= 50 and (window.next_offset == 50) == (window.total > 50)
    with pytest.raises(NotFound):
        lib.read("none")
    assert lib.grep("the evaluation", limit=3).count() <= 3
    figure = lib.table("figures").first()
    assert lib.get_figure(figure.paper_key, figure.id).first().id == figure.id
    assert lib.export_bibtex().where("entry LIKE '@%'").count() > 0
    assert {r.name for r in lib.stats()["counts"].collect()} == {"papers", "figures", "tables_index", "equations", "refs"}


def test_writes(lib):
    one = lib.papers().limit(1)
    before = one.first()
    lib.upsert_papers(one.withColumn("title", F.lit("New")).withColumn("created_at", F.current_timestamp()))
    after = lib.papers().where(F.col("key") == before.key).first()
    assert after.title == "New" and after.created_at == before.created_at
    lib.drop_papers(lib.spark.createDataFrame([(before.key,)], "key string"))
    assert lib.papers().where(F.col("key") == before.key).isEmpty() and lib.table("blocks").where(F.col("paper_key") == before.key).isEmpty()
    lib.annotate("k", "q", "n")
    assert lib.annotations("k").first().note == "n"


def test_streaming(spark, tmp_path):
    from quillgrid.streaming import events

    rows = spark.read.parquet(f"{DATA}/events.parquet")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = events.read_stream(spark, str(tmp_path / "in"), rows)
    query = events.ingest(stream, str(tmp_path / "cp"), lambda batch, _: seen.append(batch.count()))
    query.awaitTermination(120)
    assert sum(seen) == rows.count() and events.progress(query)["state"] == "done"
    counted = events.windowed_counts(rows).agg(F.sum("n")).first()[0]
    assert counted == rows.count()
