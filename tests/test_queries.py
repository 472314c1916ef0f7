"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

from gradus.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()
MODELS = {"gbt_forecast", "model_selection_table", "model_acceptance", "model_importances", "forecast_scores", "recommend_answer_trained"}  # in test_models.py


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v


def rows(columns, data):
    return Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, [r.asDict() for r in df.collect()])
    assert got == rows(want.columns, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE) - MODELS - {"stream_dedup_agg"}))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
