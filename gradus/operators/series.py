"""Time-series operators over (series key, integer year) rows with gaps.

A series' year is unique. Nothing here reads a row's own or later targets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import store


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match; right's key columns are dropped."""
    names = {k: f"__{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    if not keys:
        return left.crossJoin(right)  # right is one row
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right, on, how).drop(*names.values())


def store_rows(df: DataFrame) -> DataFrame:
    """Rows that many later steps read, written once."""
    return store(df, "series")


def exact_lag(target: str, keys: list[str], k: int, year: str = "year") -> Column:
    """The target of year - k exactly; null if that year is missing."""
    return F.max(target).over(Window.partitionBy(*keys).orderBy(year).rangeBetween(-k, -k))


def prior_window(keys: list[str], year: str = "year"):
    return Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)


def lag_features(df: DataFrame, keys: list[str], target: str = "target", year: str = "year") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(year)
    for k in (1, 2, 3):
        df = df.withColumn(f"lag_{k}_year", exact_lag(target, keys, k, year))
    return df.withColumn("last_observed", F.lag(target).over(w)).withColumn("years_since_last", F.col(year) - F.lag(year).over(w))


def prior_stats(df: DataFrame, keys: list[str], target: str = "target", year: str = "year") -> DataFrame:
    """Count, mean, median, min, max, deviation, slope and mean change of earlier rows."""
    w = prior_window(keys, year)
    n = F.count(target).over(w)
    some = lambda c: F.when(n >= 2, c)
    first, last = F.first(target).over(w), F.last(target).over(w)
    return df.select(
        "*",
        n.alias("prior_count"),
        F.avg(target).over(w).alias("prior_mean"),
        F.percentile(target, F.lit(0.5)).over(w).alias("prior_median"),
        F.min(target).over(w).alias("prior_min"),
        F.max(target).over(w).alias("prior_max"),
        some(F.stddev_pop(target).over(w)).alias("prior_std"),
        some(F.regr_slope(target, year).over(w)).alias("prior_slope"),
        some((last - first) / (n - 1)).alias("prior_mean_change"),
    )


def previous_year_group(df: DataFrame, keys: list[str], name: str, target: str = "target", year: str = "year", base: DataFrame | None = None) -> DataFrame:
    """Adds the mean target and size of the same group one year before.

    base: the rows to sum, where df has gathered other joins, so that plans grow with the number of joins alone.
    """
    sums = (df if base is None else base).groupBy(*keys, year).agg(F.avg(target).alias(f"{name}_mean"), F.count(F.lit(1)).alias(f"{name}_size"))
    return null_safe(df, sums.withColumn(year, F.col(year) + 1), [*keys, year])


def prior_group_history(df: DataFrame, keys: list[str], name: str, target: str = "target", year: str = "year", base: DataFrame | None = None) -> DataFrame:
    """Adds the mean and size of all strictly earlier years of the group, summed at its years' grain; base as above."""
    sums = (df if base is None else base).groupBy(*keys, year).agg(F.sum(target).alias("s"), F.count(target).alias("c"), F.count(F.lit(1)).alias("n"))
    w = prior_window(keys, year)
    total = lambda c: F.sum(c).over(w)
    sums = sums.select(*keys, year, (total("s") / F.nullif(total("c"), F.lit(0))).alias(f"{name}_mean"), F.coalesce(total("n"), F.lit(0)).alias(f"{name}_size"))
    return null_safe(df, sums, [*keys, year])


def future_rows(df: DataFrame, keys: list[str], target: str = "target", year: str = "year") -> DataFrame:
    """The last year's rows once more for the year after, with no target, beside all rows."""
    last = df.agg(F.max(year).alias("last_year"))
    new = df.crossJoin(F.broadcast(last)).where(F.col(year) == F.col("last_year")).drop("last_year")
    empty = F.lit(None).cast(df.schema[target].dataType)
    return df.unionByName(new.withColumn(year, (F.col(year) + 1).cast(df.schema[year].dataType)).withColumn(target, empty))


def first_available(values: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(first value that isn't null, its label)."""
    label = reduce(lambda c, v: c.when(v[1].isNotNull(), F.lit(v[0])), values[1:], F.when(values[0][1].isNotNull(), F.lit(values[0][0])))
    return F.coalesce(*[v for _, v in values]), label


def regression_metrics(truth: str, guess: str) -> list[Column]:
    """Rows, coverage, MAE, RMSE and R2 over the rows that have a guess."""
    has = F.col(guess).isNotNull()
    gap = F.when(has, F.col(truth) - F.col(guess))
    kept = F.when(has, F.col(truth))
    n = F.count(gap)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.round(n / F.count(F.lit(1)), 4).alias("coverage"),
        F.round(F.avg(F.abs(gap)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(gap * gap)), 4).alias("rmse"),
        F.round(1 - F.sum(gap * gap) / F.nullif(F.var_pop(kept) * n, F.lit(0.0)), 4).alias("r2"),
    ]


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)
