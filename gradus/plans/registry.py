"""All queries of the engine and the SQL that checks them, by name."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

MODULES = ("series", "gates", "marts", "texts", "identity", "serving", "models", "sources", "exams", "choices", "web", "rules", "upkeep")


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"gradus.plans.{name}")
