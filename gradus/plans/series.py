"""Series features, fallbacks, forecasts and their metrics over yearly order values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as ops
from ..operators.quantiles import with_quantiles
from .registry import query, table

KEYS = ["nation", "segment", "combo"]

CTE = """
series AS (
  SELECT c_nationkey AS nation, c_mktsegment AS segment, o_orderpriority AS combo,
    year(o_orderdate)::INT AS year, avg(o_totalprice) / 19997 AS target
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
)"""


def series(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("combo"), F.year("o_orderdate").alias("year")
    ).agg((F.avg("o_totalprice") / 19997).alias("target"))


def rounded(df, keep, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if c not in keep and t == "double" else F.col(c) for c, t in df.dtypes])


LAGGED = (
    CTE
    + """, lagged AS (
  SELECT s.*, a.target AS lag_1_year, b.target AS lag_2_year, c.target AS lag_3_year,
    lag(s.target) OVER w AS last_observed, s.year - lag(s.year) OVER w AS years_since_last
  FROM series s
  LEFT JOIN series a ON a.nation = s.nation AND a.segment = s.segment AND a.combo = s.combo AND a.year = s.year - 1
  LEFT JOIN series b ON b.nation = s.nation AND b.segment = s.segment AND b.combo = s.combo AND b.year = s.year - 2
  LEFT JOIN series c ON c.nation = s.nation AND c.segment = s.segment AND c.combo = s.combo AND c.year = s.year - 3
  WINDOW w AS (PARTITION BY s.nation, s.segment, s.combo ORDER BY s.year)
)"""
)


@query(f"""WITH {LAGGED} SELECT nation, segment, combo, year, round(target, 4) AS target, round(lag_1_year, 4) AS lag_1_year,
  round(lag_2_year, 4) AS lag_2_year, round(lag_3_year, 4) AS lag_3_year, round(last_observed, 4) AS last_observed,
  years_since_last, round(lag_1_year - lag_2_year, 4) AS lag_change, lag_1_year IS NOT NULL AS has_lag_1 FROM lagged""")
def series_exact_lags(spark, sf_dir):
    df = ops.lag_features(series(spark, sf_dir), KEYS)
    df = df.withColumn("lag_change", F.col("lag_1_year") - F.col("lag_2_year")).withColumn("has_lag_1", F.col("lag_1_year").isNotNull())
    return rounded(df, KEYS)


PRIOR = (
    CTE
    + """, prior AS (
  SELECT *, count(target) OVER w AS prior_count, avg(target) OVER w AS prior_mean, median(target) OVER w AS prior_median,
    min(target) OVER w AS prior_min, max(target) OVER w AS prior_max,
    CASE WHEN count(target) OVER w >= 2 THEN stddev_pop(target) OVER w END AS prior_std,
    CASE WHEN count(target) OVER w >= 2 THEN regr_slope(target, year) OVER w END AS prior_slope,
    CASE WHEN count(target) OVER w >= 2 THEN (last(target) OVER w - first(target) OVER w) / (count(target) OVER w - 1) END AS prior_mean_change
  FROM series
  WINDOW w AS (PARTITION BY nation, segment, combo ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
)


@query(f"""WITH {PRIOR} SELECT nation, segment, combo, year, prior_count, round(prior_mean, 4) AS prior_mean, round(prior_median, 4) AS prior_median,
  round(prior_min, 4) AS prior_min, round(prior_max, 4) AS prior_max, round(prior_max - prior_min, 4) AS prior_range,
  round(prior_std, 4) AS prior_std, round(prior_slope, 4) AS prior_slope, round(prior_mean_change, 4) AS prior_mean_change FROM prior""")
def series_prior_stats(spark, sf_dir):
    df = ops.prior_stats(series(spark, sf_dir), KEYS).drop("target")
    return rounded(df.withColumn("prior_range", F.col("prior_max") - F.col("prior_min")), KEYS)


SETS = {"g_segment": ["segment"], "g_combo": ["combo"], "g_nation": ["nation"], "g_pair": ["segment", "combo"], "g_all": []}


def _prev_sql():
    joins, cols = "", ""
    for name, keys in SETS.items():
        by = "".join(f"{k}, " for k in keys)
        on = "".join(f" AND {name}.{k} = s.{k}" for k in keys)
        joins += f" LEFT JOIN (SELECT {by}year, avg(target) AS m, count(*) AS n FROM series GROUP BY {by}year) {name} ON {name}.year = s.year - 1{on}"
        cols += f", round({name}.m, 4) AS {name}_mean, {name}.n AS {name}_size"
    return f"WITH {CTE} SELECT s.nation, s.segment, s.combo, s.year{cols} FROM series s{joins}"


@query(_prev_sql())
def group_prev_year_mean(spark, sf_dir):
    df = base = series(spark, sf_dir)
    for name, keys in SETS.items():
        df = ops.previous_year_group(df, keys, name, base=base)
    return rounded(df.drop("target"), KEYS)


HISTORY = SETS | {"g_place": ["nation", "segment"]}


def _history_sql():
    joins, cols = "", ""
    for name, keys in HISTORY.items():
        on = "".join(f" AND x.{k} = s.{k}" for k in keys)
        joins += f" LEFT JOIN LATERAL (SELECT avg(x.target) AS m, count(*) AS n FROM series x WHERE x.year < s.year{on}) {name} ON true"
        blank = f"CASE WHEN trim(coalesce(s.segment, '')) = '' THEN NULL ELSE round({name}.m, 4) END" if "segment" in keys else f"round({name}.m, 4)"
        cols += f", {blank} AS {name}_mean, {name}.n AS {name}_size"
    return f"WITH {CTE} SELECT s.nation, s.segment, s.combo, s.year{cols} FROM series s{joins}"


@query(_history_sql())
def group_prior_history(spark, sf_dir):
    df = base = series(spark, sf_dir)
    for name, keys in HISTORY.items():
        df = ops.prior_group_history(df, keys, name, base=base)
        if "segment" in keys:  # a blank label is no group
            df = df.withColumn(f"{name}_mean", F.when(F.trim(F.coalesce("segment", F.lit(""))) != "", F.col(f"{name}_mean")))
    return rounded(df.drop("target"), KEYS)


COLD = (
    LAGGED
    + """, typed AS (
  SELECT l.*, CASE WHEN lag_1_year IS NOT NULL THEN 'not_cold_start' WHEN last_observed IS NULL THEN 'new_series' ELSE 'history_gap' END AS cold_start,
    (SELECT avg(x.target) FROM series x WHERE x.segment = l.segment AND x.combo = l.combo AND x.year = l.year - 1) AS pair_mean,
    (SELECT avg(x.target) FROM series x WHERE x.combo = l.combo AND x.year = l.year - 1) AS combo_mean,
    (SELECT avg(x.target) FROM series x WHERE x.year = l.year - 1) AS all_mean
  FROM lagged l
)"""
)


def _cold(df):
    lagged = ops.lag_features(df, KEYS)
    kind = F.when(F.col("lag_1_year").isNotNull(), "not_cold_start").when(F.col("last_observed").isNull(), "new_series").otherwise("history_gap")
    lagged = lagged.withColumn("cold_start", kind)
    for name, keys in {"pair": ["segment", "combo"], "combo": ["combo"], "all": []}.items():
        lagged = ops.previous_year_group(lagged, keys, name if name != "combo" else "only_combo", base=df).withColumnRenamed("only_combo_mean", "combo_mean")
    return lagged


@query(f"""WITH {COLD} SELECT nation, segment, combo, year, cold_start,
  round(coalesce(lag_1_year, last_observed, pair_mean, combo_mean, all_mean), 4) AS fallback,
  CASE WHEN lag_1_year IS NOT NULL THEN 'exact_lag' WHEN last_observed IS NOT NULL THEN 'last_observed' WHEN pair_mean IS NOT NULL THEN 'pair'
    WHEN combo_mean IS NOT NULL THEN 'combo' WHEN all_mean IS NOT NULL THEN 'all' END AS fallback_level FROM typed""")
def cold_start_fallback(spark, sf_dir):
    df = _cold(series(spark, sf_dir))
    levels = [("exact_lag", "lag_1_year"), ("last_observed", "last_observed"), ("pair", "pair_mean"), ("combo", "combo_mean"), ("all", "all_mean")]
    value, label = ops.first_available([(name, F.col(c)) for name, c in levels])
    return df.select(*KEYS, "year", "cold_start", F.round(value, 4).alias("fallback"), label.alias("fallback_level"))


@query(f"""WITH {CTE}, last AS (SELECT max(year) AS y FROM series), every AS (
    SELECT * FROM series UNION ALL SELECT nation, segment, combo, year + 1, NULL FROM series, last WHERE year = y)
  SELECT e.nation, e.segment, e.combo, e.year, round(a.target, 4) AS lag_1_year, round(b.target, 4) AS lag_2_year,
    (SELECT count(*) FROM series x WHERE x.nation = e.nation AND x.segment = e.segment AND x.combo = e.combo AND x.year < e.year) AS prior_count,
    (SELECT round(avg(x.target), 4) FROM series x WHERE x.nation = e.nation AND x.segment = e.segment AND x.combo = e.combo AND x.year < e.year) AS prior_mean
  FROM every e, last
  LEFT JOIN series a ON a.nation = e.nation AND a.segment = e.segment AND a.combo = e.combo AND a.year = e.year - 1
  LEFT JOIN series b ON b.nation = e.nation AND b.segment = e.segment AND b.combo = e.combo AND b.year = e.year - 2
  WHERE e.year = y + 1""")
def forecast_future_rows(spark, sf_dir):
    df = series(spark, sf_dir)
    every = ops.prior_stats(ops.lag_features(ops.future_rows(df, KEYS), KEYS), KEYS)
    last = every.agg(F.max("year").alias("future"))
    new = every.join(F.broadcast(last), F.col("year") == F.col("future"))
    return rounded(new.select(*KEYS, "year", "lag_1_year", "lag_2_year", "prior_count", "prior_mean"), KEYS)


@query(f"""WITH {LAGGED} SELECT count(*) AS n_rows, count(*) FILTER (WHERE l.lag_1_year IS DISTINCT FROM s.target) AS mismatches
  FROM lagged l LEFT JOIN series s ON s.nation = l.nation AND s.segment = l.segment AND s.combo = l.combo AND s.year = l.year - 1""")
def exact_lag_selfcheck(spark, sf_dir):
    base = ops.store_rows(series(spark, sf_dir))  # both sides read the same means: summed twice in any order, they differ in the last digits
    before = base.select(*KEYS, (F.col("year") + 1).alias("year"), F.col("target").alias("want"))
    both = ops.null_safe(ops.lag_features(base, KEYS), before, [*KEYS, "year"])
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("lag_1_year").eqNullSafe(F.col("want"))).alias("mismatches"))


SEGMENT = "CASE WHEN prior_count = 0 THEN 'cold' WHEN prior_count < 3 THEN 'short' ELSE 'long' END"
SPLIT = "CASE WHEN year <= 1998 THEN 'train' WHEN year = 1999 THEN 'validation' ELSE 'test' END"


def split(year="year"):
    return F.when(F.col(year) <= 1998, "train").when(F.col(year) == 1999, "validation").otherwise("test")


def segment(count="prior_count"):
    return F.when(F.col(count) == 0, "cold").when(F.col(count) < 3, "short").otherwise("long")


@query(f"""WITH {PRIOR} SELECT {SPLIT} AS split, {SEGMENT} AS history, count(*) AS n_rows, round(avg(target), 4) AS mean_target FROM prior GROUP BY ALL""")
def time_split_segments(spark, sf_dir):
    df = ops.prior_stats(series(spark, sf_dir), KEYS)
    return df.groupBy(split().alias("split"), segment().alias("history")).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("target"), 4).alias("mean_target"))


MODELS = ["historical_mean", "last_value", "group_mean", "hybrid"]
METRICS = """count(*) AS n_rows, round(count(guess) / count(*), 4) AS coverage, round(avg(abs(target - guess)), 4) AS mae,
  round(sqrt(avg((target - guess) ** 2)), 4) AS rmse,
  round(1 - sum((target - guess) ** 2) / nullif(var_pop(CASE WHEN guess IS NOT NULL THEN target END) * count(guess), 0), 4) AS r2"""
GUESSES = (
    PRIOR
    + f""", guesses AS (
  SELECT p.*, {SPLIT} AS split, p.prior_mean AS historical_mean,
    lag(target) OVER (PARTITION BY nation, segment, combo ORDER BY year) AS last_value,
    (SELECT avg(x.target) FROM series x WHERE x.combo = p.combo AND x.year < p.year) AS group_mean
  FROM prior p
), long AS (
  SELECT split, segment, nation, year, prior_count, target, unnest(['historical_mean', 'last_value', 'group_mean', 'hybrid']) AS model,
    unnest([historical_mean, last_value, group_mean, coalesce(last_value, historical_mean, group_mean)]) AS guess
  FROM guesses WHERE split <> 'train'
)"""
)


def guesses(df):
    df = ops.prior_group_history(ops.lag_features(ops.prior_stats(df, KEYS), KEYS), ["combo"], "of_combo", base=df)
    df = df.withColumns({"split": split(), "historical_mean": F.col("prior_mean"), "last_value": F.col("last_observed"), "group_mean": F.col("of_combo_mean")})
    df = df.withColumn("hybrid", F.coalesce("last_value", "historical_mean", "group_mean")).where("split <> 'train'")
    return ops.unpivot(df, ["split", "segment", "nation", "year", "prior_count", "target"], MODELS, "model", "guess")


#: The five segments that a row may count in; null for a cold start's depth.
PARTS = """array('all', CASE WHEN prior_count > 0 THEN 'known' ELSE 'cold' END,
  CASE WHEN prior_count = 1 THEN 'known_1_year' WHEN prior_count >= 2 THEN 'known_2plus' END)"""


@query(f"""WITH {GUESSES}, cubed AS (
    SELECT *, 'all' AS part FROM long UNION ALL SELECT *, 'known' FROM long WHERE prior_count > 0 UNION ALL SELECT *, 'cold' FROM long WHERE prior_count = 0
    UNION ALL SELECT *, 'known_1_year' FROM long WHERE prior_count = 1 UNION ALL SELECT *, 'known_2plus' FROM long WHERE prior_count >= 2)
  SELECT split, part, model, {METRICS} FROM cubed GROUP BY ALL""")
def baseline_metrics_cube(spark, sf_dir):
    part = F.explode(F.expr(PARTS))
    return guesses(series(spark, sf_dir)).withColumn("part", part).where("part is not null").groupBy("split", "part", "model").agg(*ops.regression_metrics("target", "guess"))


@query(f"""WITH {GUESSES}, top AS (SELECT segment, count(*) AS n FROM long GROUP BY segment ORDER BY n DESC, segment LIMIT 10)
  SELECT segment, {METRICS} FROM long SEMI JOIN top USING (segment) WHERE model = 'hybrid' GROUP BY segment""")
def top_groups_metrics(spark, sf_dir):
    df = guesses(series(spark, sf_dir))
    top = df.groupBy("segment").count().orderBy(F.desc("count"), "segment").limit(10)
    return df.join(F.broadcast(top), "segment", "left_semi").where("model = 'hybrid'").groupBy("segment").agg(*ops.regression_metrics("target", "guess"))


@query(f"""WITH {CTE} SELECT nation, segment, combo, year, count(DISTINCT year) OVER w AS n_years, min(year) OVER w AS first_year, max(year) OVER w AS last_year
  FROM series WINDOW w AS (PARTITION BY nation, segment, combo)""")
def series_span(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS)
    df = series(spark, sf_dir)
    return df.select(*KEYS, "year", F.size(F.collect_set("year").over(w)).cast("bigint").alias("n_years"), F.min("year").over(w).alias("first_year"), F.max("year").over(w).alias("last_year"))


@query("""WITH bounds AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
  SELECT c_custkey, c_mktsegment, c_acctbal < q1 - 0.5 * (q3 - q1) OR c_acctbal > q3 + 0.5 * (q3 - q1) AS outlier
  FROM customer JOIN bounds USING (c_mktsegment)""")
def iqr_outliers_by_group(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    q1, q3 = F.col("q_c_acctbal")[0], F.col("q_c_acctbal")[1]
    wide = (q3 - q1) * 0.5
    outlier = (F.col("c_acctbal") < q1 - wide) | (F.col("c_acctbal") > q3 + wide)
    return with_quantiles(df, ["c_mktsegment"], ["c_acctbal"], [0.25, 0.75]).select("c_custkey", "c_mktsegment", outlier.alias("outlier"))


@query("""SELECT year(o_orderdate)::INT AS year, count(o_totalprice) AS n, round(min(o_totalprice), 4) AS least, round(avg(o_totalprice), 4) AS mean,
  round(median(o_totalprice), 4) AS median, round(max(o_totalprice), 4) AS most FROM orders GROUP BY GROUPING SETS ((year(o_orderdate)::INT), ())""")
def stats_overall_and_by_year(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    aggs = [F.count("o_totalprice").alias("n"), *[F.round(f("o_totalprice"), 4).alias(n) for f, n in ((F.min, "least"), (F.avg, "mean"), (F.max, "most"))]]
    each = with_quantiles(df.groupBy("year").agg(*aggs), ["year"], ["o_totalprice"], [0.5], df)
    whole = with_quantiles(df.agg(F.lit(None).cast("int").alias("year"), *aggs), [], ["o_totalprice"], [0.5], df)
    return each.unionByName(whole).withColumn("median", F.round(F.col("q_o_totalprice")[0], 4)).drop("q_o_totalprice")


EXAMS = """exams AS (
  SELECT user_id % 10 AS province, year(ts)::INT AS year, event_type AS subject, count(value) AS n, round(avg(value), 4) AS mean
  FROM events GROUP BY ALL)"""


@query(f"""WITH {EXAMS} SELECT year, subject, sum(n)::BIGINT AS n, round(sum(mean * n) / sum(n), 4) AS weighted_mean FROM exams WHERE mean IS NOT NULL AND n > 0 GROUP BY ALL""")
def weighted_mean_long(spark, sf_dir):
    keys = (F.col("user_id") % 10).alias("province"), F.year("ts").alias("year"), F.col("event_type").alias("subject")
    long = table(spark, sf_dir, "events").groupBy(*keys).agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean")).where("mean is not null and n > 0")
    return long.groupBy("year", "subject").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 4).alias("weighted_mean"))


@query("""WITH counts AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1)
  SELECT CASE WHEN n >= 30 THEN p_name ELSE '__rare__' END AS level, count(*) AS n_levels, sum(n)::BIGINT AS n_rows FROM counts GROUP BY 1""")
def rare_level_bucketing(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_name").count()
    level = F.when(F.col("count") >= 30, F.col("p_name")).otherwise("__rare__")
    return counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n_levels"), F.sum("count").alias("n_rows"))


@query(f"""WITH {GUESSES}, scored AS (SELECT model, {METRICS} FROM long WHERE split = 'validation' GROUP BY model),
  best AS (SELECT * FROM scored WHERE coverage = 1.0 ORDER BY mae, model LIMIT 1)
  SELECT model, unnest(['mae', 'rmse', 'r2']) AS metric, unnest([mae, rmse, r2]) AS amount FROM best""")
def best_row_and_unpivot(spark, sf_dir):
    scored = guesses(series(spark, sf_dir)).where("split = 'validation'").groupBy("model").agg(*ops.regression_metrics("target", "guess"))
    best = scored.where("coverage = 1.0").orderBy("mae", "model").limit(1)
    return ops.unpivot(best, ["model"], ["mae", "rmse", "r2"], "metric", "amount")
