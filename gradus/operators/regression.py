"""Regression over prepared frames: learned preparation, candidates, selection, gate, importances.

Everything learned comes of the rows that a fit is given: medians, deviations, frequent levels.
Driver-side state is the levels of the categories and a few numbers for each candidate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles_of

MISSING, RARE = "__MISSING__", "__RARE__"
#: Levels with fewer rows at the fit share one column; levels unknown at the fit have none.
MIN_FREQUENCY = 10
LOW, HIGH = 0.0, 30.0
SEED = 42
# Boosting rounds at most, and rounds without a smaller error after which it stops.
ROUNDS, PATIENCE = 2500, 75
#: The candidates' names, families and parameters.
CANDIDATES = (
    ("ridge_alpha_1", "ridge", {"alpha": 1.0}),
    ("ridge_alpha_10", "ridge", {"alpha": 10.0}),
    ("ridge_alpha_100", "ridge", {"alpha": 100.0}),
    ("random_forest_1", "forest", {"numTrees": 180, "maxDepth": 18, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.85}),
    ("random_forest_2", "forest", {"numTrees": 240, "maxDepth": 24, "minInstancesPerNode": 4, "featureSubsetStrategy": "0.2", "subsamplingRate": 0.85}),
    ("boosted_1", "boosted", {"maxDepth": 6, "stepSize": 0.05, "minInstancesPerNode": 5, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.8"}),
    ("boosted_2", "boosted", {"maxDepth": 4, "stepSize": 0.04, "minInstancesPerNode": 3, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"}),
)


def lighter(candidates, trees: int, depth: int):
    """The candidates with forests of at most so many trees of at most that depth."""
    cap = lambda p: {**p, "numTrees": min(p["numTrees"], trees), "maxDepth": min(p["maxDepth"], depth)}
    return tuple((name, family, cap(p) if family == "forest" else p) for name, family, p in candidates)


#: Limits of the acceptance gate.
DEGRADED, ABOVE_HYBRID, GROUP_SPREAD, TOP_GROUPS = 1.75, 1.15, 1.5, 10


@dataclass
class Prepared:
    """Fitted preparation (raw columns to `features`) and the features' names, in order."""

    model: PipelineModel
    names: list[str]


@dataclass
class Trained:
    """Outcome of `train`: validation records, the chosen name, its refitted model, test figures."""

    records: list[dict]
    selected: str
    model: PipelineModel
    names: list[str]
    test: list[dict]
    gate: dict = field(default_factory=dict)


def prepare(fit: DataFrame, numeric: list[str], categorical: list[str], scale: bool = False, min_frequency: int = MIN_FREQUENCY) -> Prepared:
    """Medians for nulls with indicators, population scaling without centring, one-hot levels.

    Null categories are a level of their own. A column null in every row gets zero. No rows:
    ValueError.
    """
    real = {c: F.col(c).cast("double") for c in numeric}
    found = fit.agg(F.count(F.lit(1)).alias("rows"), *[F.count(v).alias(f"known_{i}") for i, v in enumerate(real.values())]).first()
    n = found["rows"]
    if not n:
        raise ValueError("No rows to learn from.")
    middle = quantiles_of(fit, [], numeric, [0.5]).first() if numeric else None
    medians = [float((middle and middle[f"q_{c}"] or [0.0])[0]) for c in numeric]
    lost = [i for i in range(len(numeric)) if found[f"known_{i}"] < n]
    spread = [1.0] * len(numeric)
    if scale and numeric:
        row = fit.agg(*[F.stddev_pop(F.coalesce(v, F.lit(m))).alias(f"s{i}") for i, (v, m) in enumerate(zip(real.values(), medians, strict=True))]).first()
        spread = [x or 1.0 for x in row]
    parts = [f"coalesce(cast(`{c}` as double), {m!r}D) / {s!r}D AS p_n{i}" for i, (c, m, s) in enumerate(zip(numeric, medians, spread, strict=True))]
    for i in lost:
        p = found[f"known_{i}"] / n
        unit = (p * (1 - p)) ** 0.5 if scale else 1.0
        parts.append(f"cast(`{numeric[i]}` is null as double) / {unit or 1.0!r}D AS p_m{i}")
    parts += [f"coalesce(cast(`{c}` as string), '{MISSING}') AS p_c{j}" for j, c in enumerate(categorical)]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")] if parts else []
    names: list[str] = []
    if categorical:
        ids = range(len(categorical))
        index = StringIndexer(inputCols=[f"p_c{j}" for j in ids], outputCols=[f"p_i{j}" for j in ids], handleInvalid="keep", stringOrderType="frequencyDesc")
        cuts = []
        for j, c in enumerate(categorical):
            level = F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("level")
            counts = fit.groupBy(level).count().agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("count") >= min_frequency).alias("often")).first()
            often, every = counts["often"], counts["all"]
            cuts.append(f"CASE WHEN p_i{j} < {often} THEN p_i{j} WHEN p_i{j} < {every} THEN {often}D ELSE {often + 1}D END AS p_b{j}")
            names.append((c, often, every))
        bucket = SQLTransformer(statement=f"SELECT *, {', '.join(cuts)} FROM __THIS__")
        hot = OneHotEncoder(inputCols=[f"p_b{j}" for j in ids], outputCols=[f"p_v{j}" for j in ids], handleInvalid="keep", dropLast=True)
        stages += [index, bucket, hot]
    inputs = [*[f"p_v{j}" for j in range(len(categorical))], *[f"p_n{i}" for i in range(len(numeric))], *[f"p_m{i}" for i in lost]]
    model = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(fit)
    levels = model.stages[1].labelsArray if categorical else []
    shown = [f"{c}={x}" for (c, often, every), labels in zip(names, levels, strict=True) for x in [*labels[:often], *[RARE] * (every > often)]]
    return Prepared(model, [*shown, *numeric, *[f"{numeric[i]}_missing" for i in lost]])


def size(df: DataFrame, target: str = "target") -> tuple[int, float]:
    """Rows and the target's population deviation (one, if it has none)."""
    row = df.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    return row[0], row[1] or 1.0


def estimator(family: str, params: dict, rows: tuple[int, float], target: str = "target", rounds: int = ROUNDS):
    """An unfitted model; rows: the `size` of what it will be fitted on.

    Ridge adds alpha times the squared weights to the sum of squared errors. Spark averages the
    errors and measures them in deviations of the target, hence the factor.
    """
    base = {"featuresCol": "features", "labelCol": target, "predictionCol": "prediction"}
    if family == "ridge":
        return LinearRegression(**base, regParam=params.get("alpha", 0.0) * rows[1] / rows[0], standardization=False, solver="auto")
    if family == "forest":
        return RandomForestRegressor(**base, **params, seed=SEED)
    if family == "boosted":
        return GBTRegressor(**base, **params, maxIter=rounds, seed=SEED)
    raise ValueError(f"Unknown family: {family}")


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """(rounds up to the least error before the wait ends, whether it ended) along a curve of errors by round."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def patient(params: dict, rows: tuple[int, float], learn: DataFrame, held: DataFrame, most: int = ROUNDS, patience: int = PATIENCE):
    """(boosted model, rounds): as many rounds as give the least absolute error on held.

    It stops once the error hasn't fallen for patience rounds, at most rounds in all. The trees
    of fewer rounds are the first ones of more, so a fit that the wait outlives is done again
    with twice the rounds: work is at most about twice that of the last fit.
    """
    rounds = min(most, 2 * patience + 2)
    while True:
        model = estimator("boosted", params, rows, rounds=rounds).fit(learn)
        best, ended = best_round(model.evaluateEachIteration(held, "absolute"), patience)
        if ended or rounds >= most:
            break
        rounds = min(most, 2 * rounds)
    return (model if best == rounds else estimator("boosted", params, rows, rounds=best).fit(learn)), best


def clipped(df: DataFrame, low: float = LOW, high: float = HIGH, digits: int | None = 2) -> DataFrame:
    value = F.greatest(F.lit(low), F.least(F.lit(high), F.col("prediction")))
    return df.withColumn("prediction", value if digits is None else F.bround(value, digits))


def segment_metrics(df: DataFrame, cold: str, target: str = "target", guess: str = "prediction") -> list[dict]:
    """Rows, MAE, RMSE and R2 of all rows, those with a known history and cold starts."""
    part = F.explode(F.array(F.lit("all"), F.when(F.col(cold), "cold_start").otherwise("known_history"))).alias("part")
    gap = F.col(target) - F.col(guess)
    rows = df.select(target, guess, part).groupBy("part").agg(
        F.count(gap).alias("n_rows"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (1 - F.sum(gap * gap) / F.nullif(F.var_pop(target) * F.count(gap), F.lit(0.0))).alias("r2"),
    )
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["part"])


def train(df: DataFrame, numeric: list[str], categorical: list[str], cold: str, group: str, history: str, hybrid: str, strict: bool = True, candidates=CANDIDATES, most: int = ROUNDS, patience: int = PATIENCE) -> Trained:
    """Fit on split 'train', choose by MAE on 'validation', refit on both, test once, judge.

    df: the features, `target`, `split`, the boolean column cold, a column to group the test by, and
    the two baseline guesses that the gate compares with. Boosting takes the rounds of least
    absolute error on the validation rows, and so does the refit. strict: raise RuntimeError if
    no candidate beats the history's mean. Rows of no target are left out.
    """
    df = df.where("target is not null")
    first, check = df.where("split = 'train'"), df.where("split = 'validation'")
    rows, records, rounds = size(first), [], {}
    for scale in (True, False):
        wanted = [c for c in candidates if (c[1] == "ridge") is scale]
        if not wanted:
            continue
        ready = prepare(first, numeric, categorical, scale)
        both = ready.model.transform(df.where("split <> 'test'")).select("features", "target", cold, (F.col("split") == "validation").alias("held")).persist()
        try:
            learn, held = both.where("not held"), both.where("held")
            for name, family, params in wanted:
                if family == "boosted":
                    model, rounds[name] = patient(params, rows, learn, held, most, patience)
                else:
                    model = estimator(family, params, rows).fit(learn)
                records += [{"name": name, "family": family, "rounds": rounds.get(name), **m} for m in segment_metrics(clipped(model.transform(held), digits=None), cold)]
        finally:
            both.unpersist()
    whole = [r for r in records if r["part"] == "all"]
    if not whole:
        raise ValueError("No validation rows to choose by.")
    best = min(whole, key=lambda r: r["mae"])
    base = check.agg(F.avg(F.abs(F.col("target") - F.col(history)))).first()[0]
    if strict and base is not None and best["mae"] >= base:
        raise RuntimeError("No candidate beats the mean of the history on the validation rows.")
    name, family, params = next(c for c in candidates if c[0] == best["name"])
    known = df.where("split <> 'test'")  # the choice is made: the test rows are read below only
    ready = prepare(known, numeric, categorical, family == "ridge")
    fitted = estimator(family, params, size(known), rounds=rounds.get(name, most)).fit(ready.model.transform(known).select("features", "target"))
    model = PipelineModel([*ready.model.stages, fitted])
    tested = clipped(model.transform(df.where("split = 'test'")), digits=None).select("target", "prediction", cold, group, hybrid).persist()
    try:
        test = segment_metrics(tested, cold)
        gap = F.abs(F.col("target") - F.col("prediction"))
        groups = tested.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mae")).orderBy(F.desc("n"), group).limit(TOP_GROUPS)
        spread = groups.agg(F.percentile("mae", F.lit(0.5))).first()[0]  # of TOP_GROUPS rows
        hybrid_mae = tested.agg(F.avg(F.abs(F.col("target") - F.col(hybrid)))).first()[0]
    finally:
        tested.unpersist()
    gate = _gate(records, best, test, base, hybrid_mae, spread)
    return Trained(records, name, model, ready.names, test, gate)


def _gate(records, best, test, base, hybrid_mae, spread) -> dict:
    mae = {r["part"]: r["mae"] for r in test}.get("all")
    history = next((r["mae"] for r in records if r["name"] == best["name"] and r["part"] == "known_history"), None)
    beats = None not in (history, base) and history < base
    limit = max(best["mae"] * DEGRADED, (hybrid_mae or 0.0) * ABOVE_HYBRID)
    steady = mae is not None and mae <= limit
    even = None not in (spread, mae) and spread <= mae * GROUP_SPREAD
    return {
        "beats_historical_mean_on_validation": beats,
        "no_severe_test_degradation": steady,
        "not_concentrated_in_few_groups": even,
        "test_mae_vs_hybrid": None if None in (mae, hybrid_mae) else mae - hybrid_mae,
        "status": "accepted" if beats and steady and even else "candidate_saved_not_promoted",
    }


def importances(trained: Trained) -> list[tuple[str, float]]:
    """(feature, gain or absolute weight), largest first, ties in the features' order."""
    model = trained.model.stages[-1]
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    pairs = zip(trained.names, [abs(float(v)) for v in values.toArray()], strict=True)
    return sorted(pairs, key=lambda p: -p[1])


#: Columns that stand in for one that a row lacks, tried in order.
ALIASES = {
    "canonical_program_id": ("program_series_key",),
    "canonical_major_code": ("major_code", "major_admission_code"),
    "major_group": ("major_group_normalized",),
    "group_mean_feature": (
        "school_combination_historical_mean",
        "major_group_combination_historical_mean",
        "school_historical_mean",
        "major_group_historical_mean",
        "combination_historical_mean",
        "global_historical_mean",
    ),
    "hybrid_baseline_feature": ("last_observed_cutoff", "group_mean_feature"),
}


def derive(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Fill null or absent columns from the first alias that has a value; aliases may build on earlier ones."""
    for name, others in aliases.items():
        there = [c for c in (name, *others) if c in df.columns]
        if there:
            df = df.withColumn(name, F.coalesce(*[F.nanvl(F.col(c), F.lit(None)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c) for c in there]))
    return df


def score(model, df: DataFrame, required: list[str], version: str, aliases: dict | None = None, count: str = "historical_count", segment: str = "history_segment") -> DataFrame:
    """Adds predicted (clipped to 0-30, two digits), model_version and is_cold_start.

    A required column that is neither there nor derived: ValueError that names all of them.
    Cold start: a count of none, where the count is known; else the segment's name.
    """
    df = derive(df, ALIASES if aliases is None else aliases)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required feature columns: {', '.join(missing)}")
    kept = df.columns
    cold = F.col(segment) == "cold_start" if segment in kept else F.lit(False)
    if count in kept:
        cold = F.coalesce(F.col(count) <= 0, cold)
    done = clipped(model.transform(df))
    return done.select(*kept, F.col("prediction").alias("predicted"), F.lit(version).alias("model_version"), F.coalesce(cold, F.lit(False)).alias("is_cold_start"))
