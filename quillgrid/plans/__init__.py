"""Registered queries: each takes (spark, folder of Parquet tables) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrid.plans import case_queries, library_quality, library_queries

MODULES = (library_queries, library_quality, case_queries)


def all_queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: q for m in MODULES for name, q in m.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return library_quality.p3_monthly(spark, folder)
