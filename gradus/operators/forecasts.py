"""Forecasts attached to options by trimmed keys, with what is known where there is none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import first_wins

FALLBACK = "historical_fallback"


def join_key(c: Column) -> Column:
    """A key as trimmed text, null as empty: codes aren't made numbers."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def attach(options: DataFrame, features: DataFrame, keys: list[str], predict: Callable[[DataFrame], DataFrame], source: str, order: list[Column]) -> DataFrame:
    """options with predicted, forecast_source, forecast_year, model_version and is_cold_start.

    features: rows of the year to come with the keys and forecast_year; the first of a key in
    the order counts. predict adds predicted, model_version and is_cold_start. Options without
    features stay, with nulls and the source FALLBACK. Lacking keys: ValueError.
    """
    lacking = [k for k in keys if k not in options.columns]
    if lacking:
        raise ValueError(f"options lack the keys {', '.join(lacking)}")
    names = [f"__{k}" for k in keys]
    known = first_wins(features.withColumns({n: join_key(F.col(k)) for n, k in zip(names, keys, strict=True)}), names, order)
    found = predict(known).select(*names, "predicted", F.col("forecast_year"), "model_version", "is_cold_start")
    asked = options.withColumns({n: join_key(F.col(k)) for n, k in zip(names, keys, strict=True)})
    joined = asked.join(found, names, "left").drop(*names)
    return joined.withColumn("forecast_source", F.when(F.col("predicted").isNotNull(), source).otherwise(FALLBACK))
