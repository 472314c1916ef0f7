"""Trained forecasts: least squares, candidates chosen by validation error, gate, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import least_squares
from ..operators import regression as ml
from ..operators import series as ops
from ..sources.files import store
from . import choices
from .registry import query
from .series import KEYS, METRICS, PARTS, PRIOR, SPLIT, series, split

NUMERIC = ["year", "lag_1_year", "lag_2_year", "prior_mean", "prior_std", "prior_count", "of_combo_mean"]
CATEGORICAL = ["nation_text", "segment", "combo"]
VERSION = "series-forecast-1"
#: The queries' forests and boosting are smaller than the candidates' own values: the series here hold
#: a few thousand rows, on which hundreds of trees 24 levels deep cost minutes of scheduling alone.
TREES, DEPTH, ROUNDS, PATIENCE = 30, 8, 40, 5


def frame(spark, sf_dir):
    base = series(spark, sf_dir)
    df = ops.prior_stats(ops.lag_features(base, KEYS), KEYS)
    df = ops.prior_group_history(df, ["combo"], "of_combo", base=base)
    return df.withColumns({
        "split": split(),
        "nation_text": F.col("nation").cast("string"),
        "cold": F.col("prior_count") == 0,
        "hybrid": F.coalesce("last_observed", "prior_mean", "of_combo_mean"),
    })


_TRAINED: dict[tuple[str, str], ml.Trained] = {}


def trained(spark, sf_dir) -> ml.Trained:
    """The candidates' outcome, kept for the queries of one application that share it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _TRAINED:
        for old in [k for k in _TRAINED if k[0] != key[0]]:  # models of an ended session can't be used
            del _TRAINED[old]
        _TRAINED[key] = ml.train(store(frame(spark, sf_dir), "model-frame"), NUMERIC, CATEGORICAL, "cold", "nation_text", "prior_mean", "hybrid", strict=False, candidates=ml.lighter(ml.CANDIDATES, TREES, DEPTH), most=ROUNDS, patience=PATIENCE)
    return _TRAINED[key]


def _least_squares(spark, sf_dir):
    """Validation and test rows with the least-squares prediction learnt from split 'train', within 0 and 30."""
    df = store(frame(spark, sf_dir), "model-frame")
    model = least_squares.fit(df.where("split = 'train'"), NUMERIC, "target")
    return ml.clipped(df.where("split <> 'train'").withColumn("prediction", model.predict()), digits=None)


def _ols_sql() -> str:
    """Gauss-Jordan steps over the products of the columns; a column that depends on earlier ones is passed over."""
    k = len(NUMERIC)
    p = 2 * k + 1
    medians = ", ".join(f"coalesce(median({c}), 0) AS m{i}" for i, c in enumerate(NUMERIC))
    fills = ", ".join(f"coalesce({c}, m{i})::DOUBLE AS f{i}, ({c} IS NULL)::INT::DOUBLE AS n{i}" for i, c in enumerate(NUMERIC))
    stats = ", ".join(f"avg(f{i}) AS a{i}, coalesce(nullif(stddev_pop(f{i}), 0), 1) AS s{i}" for i in range(k))
    xs = ", ".join(["1.0::DOUBLE", *[f"(f{i} - a{i}) / s{i}" for i in range(k)], *[f"n{i}" for i in range(k)]])
    return f"""WITH RECURSIVE {PRIOR.strip()}, frame AS (
      SELECT p.*, {SPLIT.replace("year", "p.year")} AS split, a.target AS lag_1_year, b.target AS lag_2_year, (SELECT avg(x.target) FROM series x WHERE x.combo = p.combo AND x.year < p.year) AS of_combo_mean,
        row_number() OVER (ORDER BY p.nation, p.segment, p.combo, p.year) AS r
      FROM prior p LEFT JOIN series a ON a.nation = p.nation AND a.segment = p.segment AND a.combo = p.combo AND a.year = p.year - 1
        LEFT JOIN series b ON b.nation = p.nation AND b.segment = p.segment AND b.combo = p.combo AND b.year = p.year - 2
    ), medians AS (SELECT {medians} FROM frame WHERE split = 'train'), filled AS (SELECT frame.*, {fills} FROM frame, medians),
    stats AS (SELECT {stats} FROM filled WHERE split = 'train'), design AS (SELECT filled.*, [{xs}] AS x FROM filled, stats),
    cells AS (SELECT r, unnest(range({p + 1})) AS i, unnest(list_append(x, target)) AS v FROM design WHERE split = 'train'),
    gram AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM cells a JOIN cells b USING (r) WHERE a.i < {p} GROUP BY ALL),
    elim AS (
      SELECT 0 AS k, i, j, v, (SELECT v FROM gram WHERE i = 0 AND j = 0) AS n FROM gram
      UNION ALL
      SELECT k + 1, i, j, CASE WHEN abs(pivot_v) < 1e-9 * n THEN v WHEN i = k THEN v / pivot_v ELSE v - of_row * of_column / pivot_v END, n
      FROM (SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER () AS pivot_v, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS of_column, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS of_row FROM elim WHERE k < {p})
    ), beta AS (SELECT i, max(CASE WHEN j = {p} THEN v END) * CASE WHEN abs(max(CASE WHEN j = i THEN v END) - 1) < 0.5 THEN 1 ELSE 0 END AS b FROM elim WHERE k = {p} GROUP BY i),
    done AS (SELECT d.nation, d.segment, d.combo, d.year, d.split, d.prior_count, d.target, greatest(0, least(30, (SELECT sum(d.x[i + 1] * b) FROM beta))) AS prediction FROM design d WHERE split <> 'train')"""


@query(f"{_ols_sql()} SELECT nation, segment, combo, year, split, round(target, 4) AS target, round(prediction, 4) AS prediction FROM done")
def ols_baseline(spark, sf_dir):
    done = _least_squares(spark, sf_dir)
    return done.select(*KEYS, F.col("year").cast("int").alias("year"), "split", F.round("target", 4).alias("target"), F.round("prediction", 4).alias("prediction"))


@query(f"""{_ols_sql()}, cubed AS (SELECT *, 'all' AS part FROM done UNION ALL SELECT *, 'known' FROM done WHERE prior_count > 0 UNION ALL SELECT *, 'cold' FROM done WHERE prior_count = 0
    UNION ALL SELECT *, 'known_1_year' FROM done WHERE prior_count = 1 UNION ALL SELECT *, 'known_2plus' FROM done WHERE prior_count >= 2)
  SELECT split, part, {METRICS.replace("guess", "prediction")} FROM cubed GROUP BY ALL""")
def ols_metrics_cube(spark, sf_dir):
    """The least-squares baseline in the five segments of baseline_metrics_cube."""
    done = _least_squares(spark, sf_dir)
    return done.withColumn("part", F.explode(F.expr(PARTS))).where("part is not null").groupBy("split", "part").agg(*ops.regression_metrics("target", "prediction"))


@query()
def gbt_forecast(spark, sf_dir):
    """Boosted trees learnt from split 'train', as many rounds as the validation rows' absolute error asks for."""
    name, family, params = ml.CANDIDATES[-1]
    df = store(frame(spark, sf_dir), "model-frame")
    first, rest = df.where("split = 'train'"), df.where("split <> 'train'")
    ready = ml.prepare(first, NUMERIC, CATEGORICAL)
    learn = ready.model.transform(first).select("features", "target")
    held = ready.model.transform(df.where("split = 'validation'")).select("features", "target")
    model, _ = ml.patient(params, ml.size(first), learn, held, ROUNDS, PATIENCE)
    done = ml.clipped(model.transform(ready.model.transform(rest)), digits=None)
    return done.select(*KEYS, F.col("year").cast("int").alias("year"), "split", "target", F.bround("prediction", 2).alias("prediction"))


@query()
def model_selection_table(spark, sf_dir):
    """Validation metrics of the seven candidates by segment; the least error of all rows is selected."""
    done = trained(spark, sf_dir)
    rows = [(r["name"], r["family"], r["part"], r["n_rows"], r["mae"], r["rmse"], r["r2"], r["rounds"], r["name"] == done.selected) for r in done.records]
    return spark.createDataFrame(rows, "model string, family string, part string, n_rows bigint, mae double, rmse double, r2 double, rounds int, selected boolean")


@query()
def model_acceptance(spark, sf_dir):
    """The selected model, refitted on train and validation, on the test rows, with the gate."""
    done = trained(spark, sf_dir)
    g = done.gate
    rows = [
        (done.selected, r["part"], r["n_rows"], r["mae"], r["rmse"], r["r2"], g["beats_historical_mean_on_validation"], g["no_severe_test_degradation"], g["not_concentrated_in_few_groups"], g["test_mae_vs_hybrid"], g["status"])
        for r in done.test
    ]
    shape = "model string, part string, n_rows bigint, mae double, rmse double, r2 double, beats_historical_mean boolean, no_severe_degradation boolean, not_concentrated boolean, test_mae_vs_hybrid double, status string"
    return spark.createDataFrame(rows, shape)


@query()
def model_importances(spark, sf_dir):
    """The fifteen features that weigh most in the selected model, by rank."""
    top = ml.importances(trained(spark, sf_dir))[:15]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(top, 1)], "place int, feature string, importance double")


@query()
def recommend_answer_trained(spark, sf_dir):
    """recommend_answer with the selected model's forecasts."""
    chosen = trained(spark, sf_dir).model

    def predict(features):
        return ml.score(chosen, features, [*NUMERIC, *CATEGORICAL], VERSION, aliases={}, count="prior_count")

    return choices._answer(spark, sf_dir, predict, VERSION)


@query()
def forecast_scores(spark, sf_dir):
    """Next year's rows scored by the selected model under the scoring contract."""
    base = series(spark, sf_dir)
    every = ops.prior_stats(ops.lag_features(ops.future_rows(base, KEYS), KEYS), KEYS)
    every = ops.prior_group_history(every, ["combo"], "of_combo", base=ops.future_rows(base, KEYS))
    last = base.agg(F.max("year").alias("last_year"))
    new = every.join(F.broadcast(last), F.col("year") > F.col("last_year")).withColumn("nation_text", F.col("nation").cast("string"))
    done = ml.score(trained(spark, sf_dir).model, new, [*NUMERIC, *CATEGORICAL], VERSION, aliases={}, count="prior_count")
    return done.select(*KEYS, "year", "predicted", "model_version", "is_cold_start")
