"""Checks of rows against themselves hold when the rows' means come out otherwise each time that they are summed."""

import pytest
from pyspark.sql import functions as F

from gradus.plans import gates, series

ROWS = [(n, s, "1-URGENT", y) for n in (1, None) for s in ("A", None) for y in (1992, 1993, 1995, 1996, None)]


@pytest.fixture
def unsteady(monkeypatch, spark):
    """Series whose targets differ whenever they are computed, as sums of doubles in the order of a shuffle do."""
    rows = spark.createDataFrame(ROWS, "nation int, segment string, combo string, year int").repartition(3)
    target = F.expr("hash(reflect('java.util.UUID', 'randomUUID')) / 7.0D")
    for module in (series, gates):
        monkeypatch.setattr(module, "series", lambda *_: rows.withColumn("target", target))


def test_lags_check_themselves(spark, unsteady):
    got = series.exact_lag_selfcheck(spark, "").collect()
    assert [tuple(r) for r in got] == [(len(ROWS), 0)]


def test_gates_see_no_other_year(spark, unsteady, tmp_path):
    spark.createDataFrame([(1, 1, 5.0), (2, 2, 7.0)], "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1,), (2,)], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.gate: r.failures for r in gates.invariant_gates(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and set(got.values()) == {0}
