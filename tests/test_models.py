"""Preparation, ridge and least squares against NumPy; selection, gate and scoring on small rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import least_squares
from gradus.operators import regression as ml
from gradus.plans import models, registry

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    out = []
    for i in range(240):
        a, b = float(draw.normal()), None if i % 7 == 0 else float(draw.normal())
        kind = None if i % 40 == 0 else ("x", "y", "rare")[0 if i % 3 else (1 if i % 30 else 2)]
        split = "train" if i < 160 else "validation" if i < 200 else "test"
        out.append((a, b, kind, 10 + 2 * a + (b or 0.0) + (kind == "x") + 0.1 * float(draw.normal()), split, i % 5 == 0, 10.0, 10.0))
    return spark.createDataFrame(out, "a double, b double, kind string, target double, split string, cold boolean, base double, hybrid double").persist()


def arrays(ready, df):
    got = ready.model.transform(df).select("features", "target").collect()
    return np.array([r.features.toArray() for r in got]), np.array([r.target for r in got])


def test_levels_rare_unknown_and_null(spark, rows):
    ready = ml.prepare(rows, ["a", "b"], ["kind"], min_frequency=20)
    assert ready.names == ["kind=x", "kind=y", "kind=__RARE__", "a", "b", "b_missing"]
    new = spark.createDataFrame([(0.0, 0.0, k, 0.0) for k in ("x", "y", "rare", None, "unseen")], "a double, b double, kind string, target double")
    assert arrays(ready, new)[0][:, :3].tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1], [0, 0, 0]]


def test_scale_is_the_population_deviation(rows):
    x, _ = arrays(ml.prepare(rows, ["a", "b"], [], scale=True), rows)
    assert np.allclose(x.std(axis=0), 1)


@pytest.mark.parametrize("alpha", [1.0, 100.0])
def test_ridge_is_the_closed_form(rows, alpha):
    ready = ml.prepare(rows, ["a", "b"], ["kind"], scale=True)
    x, y = arrays(ready, rows)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    model = ml.estimator("ridge", {"alpha": alpha}, ml.size(rows)).fit(ready.model.transform(rows))
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)


def plain_least_squares(rows, features, test):
    """The original's form: medians, standard scores and missing flags, solved by NumPy."""
    x = np.array([[np.nan if r[c] is None else r[c] for c in features] for r in rows], float)
    known = [v[~np.isnan(v)] for v in x.T]
    medians = np.array([np.median(v) if len(v) else 0.0 for v in known])
    filled = np.where(np.isnan(x), medians, x)
    means, scales = filled.mean(axis=0), filled.std(axis=0)
    scales[scales == 0] = 1

    def design(x):
        return np.column_stack([np.ones(len(x)), (np.where(np.isnan(x), medians, x) - means) / scales, np.isnan(x).astype(float)])

    beta, _, rank, _ = np.linalg.lstsq(design(x), np.array([r["target"] for r in rows]), rcond=1e-9)
    return beta, rank, design(np.array([[np.nan if r[c] is None else r[c] for c in features] for r in test], float)) @ beta


def test_least_squares_on_collinear_columns(spark):
    draw = np.random.default_rng(11)
    rows = []
    for i in range(300):
        a, b = float(draw.normal()), float(draw.normal(100, 5))
        rows.append((a, b if i % 9 else None, 3 * a - 2.0, b if i % 9 else None, None, 4.0, 2 * a - b / 50 + float(draw.normal()), i))
    names = ["a", "b", "c", "d", "none", "fixed"]
    df = spark.createDataFrame([*rows, (1.0, 1.0, 1.0, 1.0, None, 1.0, None, 999)], ", ".join(f"{n} double" for n in [*names, "target"]) + ", id int").repartition(4)
    model = least_squares.fit(df, names, "target")
    plain = [dict(zip([*names, "target"], r, strict=False)) for r in rows]
    beta, rank, want = plain_least_squares(plain, names, plain)
    assert model.rank == rank < 1 + 2 * len(names) and model.rows == 300
    assert np.allclose([model.intercept, *model.weights, *model.missing], beta, atol=1e-7)
    got = {r.id: r.p for r in df.where("id < 999").select("id", model.predict().alias("p")).collect()}
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-7)
    with pytest.raises(ValueError, match="No rows"):
        least_squares.fit(df.where("id < 0"), names, "target")


def test_least_squares_query_is_lstsq(spark):
    df = models.frame(spark, SF)
    rows, rest = ([r.asDict() for r in df.where(w).collect()] for w in ("split = 'train'", "split <> 'train'"))
    _, _, want = plain_least_squares(rows, models.NUMERIC, rest)
    got = {(r.nation, r.segment, r.combo, r.year): r.prediction for r in registry.QUERIES["ols_baseline"](spark, SF).collect()}
    keys = [(r["nation"], r["segment"], r["combo"], r["year"]) for r in rest]
    assert got.keys() == set(keys) and got
    assert all(abs(got[k] - min(30, max(0, w))) < 2e-4 for k, w in zip(keys, want, strict=True))


def test_patience_follows_the_curve():
    assert ml.best_round([3.0, 2.0, 2.5, 1.0, 1.1, 1.2, 0.5], 2) == (4, True)  # a later, lower error isn't waited for
    assert ml.best_round([3.0, 2.0, 2.5, 1.0, 1.1, 1.2, 0.5], 3) == (7, False)
    assert ml.best_round([1.0, 1.0, 1.0], 2) == (1, True) and ml.best_round([1.0], 75) == (1, False)


def test_boosting_stops_by_absolute_error(rows):
    ready = ml.prepare(rows, ["a", "b"], ["kind"])
    ready_rows = lambda split: ready.model.transform(rows.where(F.col("split") == split)).select("features", "target").persist()
    learn, held = ready_rows("train"), ready_rows("validation")
    params = {"maxDepth": 3, "stepSize": 0.9, "subsamplingRate": 0.9}
    model, best = ml.patient(params, ml.size(learn), learn, held, 40, 3)
    longest = ml.estimator("boosted", params, ml.size(learn), rounds=16).fit(learn)
    x, y = [r.features for r in held.collect()], np.array([r.target for r in held.collect()])
    staged, curve = np.zeros(len(y)), []
    for tree, weight in zip(longest.trees, longest.treeWeights, strict=True):  # one stage after the other
        staged = staged + weight * np.array([tree.predict(v) for v in x])
        curve.append(np.abs(y - staged).mean())
    want = 0
    for i, e in enumerate(curve):
        if e < curve[want]:
            want = i
        elif i - want >= 3:
            break
    assert best == want + 1 == model.getNumTrees < 16
    assert np.allclose([model.predict(v) for v in x], sum(w * np.array([t.predict(v) for v in x]) for t, w in zip(longest.trees[:best], longest.treeWeights[:best], strict=True)))


def test_choice_refit_gate_and_importances(rows):
    light = ml.lighter(ml.CANDIDATES, 3, 3)
    done = ml.train(rows, ["a", "b"], ["kind"], "cold", "kind", "base", "hybrid", candidates=[light[0], light[3], light[6]], most=3, patience=2)
    whole = {r["name"]: r["mae"] for r in done.records if r["part"] == "all"}
    assert done.selected == min(whole, key=whole.get) == "ridge_alpha_1"
    assert {r["part"]: r["n_rows"] for r in done.test} == {"all": 40, "cold_start": 8, "known_history": 32}
    assert done.gate["status"] == "accepted" and done.gate["test_mae_vs_hybrid"] < 0
    assert ml.importances(done)[0][0] == "a"


def test_test_rows_do_not_touch_the_choice(rows):
    other = rows.withColumn("target", F.when(F.col("split") == "test", -F.col("target")).otherwise(F.col("target"))).withColumn("hybrid", F.col("target"))
    a, b = (ml.train(d, ["a", "b"], ["kind"], "cold", "kind", "base", "hybrid", candidates=ml.CANDIDATES[:3]) for d in (rows, other))
    assert (a.selected, a.records) == (b.selected, b.records)
    assert b.gate["status"] == "candidate_saved_not_promoted" and not b.gate["no_severe_test_degradation"]


def test_no_candidate_beats_the_history(rows):
    perfect = rows.withColumn("base", F.col("target"))
    with pytest.raises(RuntimeError, match="No candidate"):
        ml.train(perfect, ["a", "b"], [], "cold", "kind", "base", "hybrid", candidates=ml.CANDIDATES[:1])


def test_no_rows(rows):
    with pytest.raises(ValueError, match="No rows"):
        ml.prepare(rows.limit(0), ["a"], [])


def test_scoring_contract(spark, rows):
    ready = ml.prepare(rows, ["a", "b"], ["kind"])
    model = ml.PipelineModel([*ready.model.stages, ml.estimator("ridge", {"alpha": 1.0}, ml.size(rows)).fit(ready.model.transform(rows))])
    new = spark.createDataFrame([(99.0, "unseen", 0, None), (-99.0, "x", 3, "cold_start"), (0.0, None, None, "cold_start")], "a double, kind string, historical_count int, history_segment string")
    with pytest.raises(ValueError, match="Missing required feature columns: b"):
        ml.score(model, new, ["a", "b", "kind"], "v1")
    got = ml.score(model, new, ["a", "b", "kind"], "v1", aliases={"b": ("a",)}).collect()
    assert [(r.predicted, r.is_cold_start) for r in got[:2]] == [(30.0, True), (0.0, False)]
    assert got[2].is_cold_start and 0 <= got[2].predicted <= 30 and got[2].model_version == "v1"


def test_aliases_fill_in_order(spark):
    df = spark.createDataFrame([("s", None, "m", float("nan"), 3.0, None), (None, None, None, 1.0, 2.0, 9.0)], "program_series_key string, major_code string, major_admission_code string, major_group_historical_mean double, global_historical_mean double, last_observed_cutoff double")
    got = ml.derive(df, ml.ALIASES).select("canonical_program_id", "canonical_major_code", "group_mean_feature", "hybrid_baseline_feature").collect()
    assert [tuple(r) for r in got] == [("s", "m", 3.0, 3.0), (None, None, 1.0, 9.0)]


@pytest.mark.parametrize("name", ["gbt_forecast", "model_selection_table", "model_acceptance", "model_importances", "forecast_scores", "recommend_answer_trained"])
def test_registered(spark, name):
    got = registry.QUERIES[name](spark, SF).collect()
    assert got
    if name == "model_selection_table":
        assert len({r.model for r in got}) == 7 and len({r.model for r in got if r.selected}) == 1
    if name in ("gbt_forecast", "forecast_scores"):
        assert all(0 <= r[-3 if name == "forecast_scores" else -1] <= 30 for r in got)
