"""Column expressions for scores, labels and bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row; a plain column is computed anew wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def round_binary(x: Column, digits: int) -> Column:
    """A double rounded half away from zero by its binary value times a power of ten, as SQL engines do.

    Spark's round goes by the shortest decimal form: 6.484999999999999 is 6.48 to it and 6.49
    here, as a hundred times it is 648.5 to the last bit.
    """
    power = 10.0**digits
    return F.round(x * power, 0) / power


def scale_quantiles(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low) within 0 and 1; 0.5 where the bounds don't differ."""
    return F.when(high <= low, F.lit(0.5)).otherwise(clip(F.try_divide(x - low, high - low), 0.0, 1.0))


def label_by_thresholds(x: Column, steps: list[tuple[float, str]], lowest: str, missing: str | None) -> Column:
    """The first label whose threshold x reaches."""
    out = F.when(x.isNull(), F.lit(missing))
    for least, name in steps:
        out = out.when(x >= least, name)
    return out.otherwise(lowest)


def sum_all_or_null(*parts: Column) -> Column:
    """Null unless every part is there."""
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def months(text: Column) -> Column:
    """'2 years' -> 24, '6 months' -> 6, 'none' -> 0, else null."""
    n = F.try_element_at(F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+)\s*(?:year|month)"), F.lit(1)), F.lit(1)).cast("int")
    low = F.lower(text)
    return F.when(low.contains("none"), 0).when(low.rlike(r"[0-9]+\s*year"), n * 12).when(low.rlike(r"[0-9]+\s*month"), n)
