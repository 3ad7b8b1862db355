"""Parquet tables of a library folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_papers(papers: DataFrame, key: str = "key") -> DataFrame:
    """One row per key, the one with the newest ``updated_at``.

    Null ``updated_at`` counts as oldest; ties are broken by ``created_at``, then by the whole row's
    content, so that the choice doesn't depend on the order of rows. Null keys are left out: they
    name no paper. One aggregation, combined on the map side; a key with a third of all rows
    sends one row per map task.
    """
    order = [F.col("updated_at"), F.col("created_at"), F.col("status")]
    order += [F.col(c) for c in papers.columns if c not in ("updated_at", "created_at", "status")]
    newest = F.max(F.struct(*order)).alias("newest")
    return (
        papers.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(newest)
        .select(*[F.col("newest")[c].alias(c) for c in papers.columns])
    )
