"""Registered queries: every operator applied to whole tables, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ("tabular", "texts", "ledgers", "sources", "streams")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    for name in MODULES:
        importlib.import_module(f"assay.plans.{name}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
