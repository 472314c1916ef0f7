"""Exact quantiles by selection against NumPy."""

import numpy as np
import pytest

from gradus.operators import quantiles as q


@pytest.mark.parametrize("cells", [16, 4096])
def test_quantiles_of_groups(spark, monkeypatch, cells):
    monkeypatch.setattr(q, "CELLS", cells)
    rng = np.random.default_rng(0)
    groups = {
        "hot": np.concatenate([rng.normal(size=1500), [1e300, -1e300, 5e-324]]),
        "steps": rng.integers(0, 3, 200).astype(float),
        "one": np.array([4.5]),
        "two": np.array([1.0, 2.0]),
        "powers": 2.0 ** np.arange(-40, 40),
        None: rng.exponential(size=70),
    }
    rows = [(k, float(v), "x") for k, vs in groups.items() for v in vs]
    rows += [("hot", None, "x"), ("one", float("nan"), "x"), ("two", float("inf"), "x"), ("none", None, "x")]
    df = spark.createDataFrame(rows, "k string, v double, n string").repartition(5)
    probs = [0, 0.05, 0.25, 0.5, 0.95, 1]
    got = {r.k: (r.n, r.q) for r in q.quantiles(df, ["k"], "v", probs).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k][0] == len(vs) and got[k][1] == pytest.approx(np.quantile(vs, probs).tolist(), rel=1e-12, abs=0)


def test_quantiles_of_tables_and_columns(spark):
    df = spark.createDataFrame([(i % 2, float(i), None if i < 3 else -2.0 * i) for i in range(9)], "k int, a double, b double")
    row = q.with_quantiles(df.limit(1), [], ["a", "b"], [0.5], df).first()
    assert row.q_a == [4.0] and row.q_b == [-11.0]
    assert {r.q_a[0] for r in q.with_quantiles(df, ["k"], ["a"], [0.25]).collect()} == {2.0, 2.5}
    assert q.with_quantiles(df.limit(0), [], ["a"], [0.5]).count() == 0
    assert q.quantiles(df.where("a is null"), [], "a", [0.5]).count() == 0
    none = q.with_quantiles(df.limit(1), [], ["b"], [0.5], df.where("b is null")).first()
    assert none.q_b is None
