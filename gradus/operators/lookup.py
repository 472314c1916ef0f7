"""Lookups by ordered keys: first hit wins, conflicts are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(value: str, order: str) -> Column:
    """The first non-null value of a group in a declared order."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def rule_chain(rules: list[tuple[str, str]], text: Column, default: str | None = None) -> Column:
    """The name of the first (name, pattern) rule that a text matches."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(default)) if default is not None else out


def conflict_safe(pairs: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, the only value of each key (null where there are several) and whether there are several."""
    grouped = pairs.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    several = F.col("__a") != F.col("__b")
    return grouped.select(*keys, F.when(~several, F.col("__a")).alias(out), several.alias(f"{out}_conflict"))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def cascade(base: DataFrame, past: DataFrame, levels: list[list[str]], value: str, year: str, years: tuple[int, ...], out: str) -> DataFrame:
    """base with past's value of each year by the first key level that the year has, and ambiguous.

    Levels come finest first. A level with several values yields null and isn't passed over;
    ambiguous tells whether that was so in any year. Keys compare trimmed and in upper case,
    null as empty. One aggregate and one join a level, whatever the number of years.
    """
    key = lambda c: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    names = sorted({c for level in levels for c in level})
    df = base.withColumns({f"__k_{c}": key(c) for c in names})
    for k, level in enumerate(levels):
        each = []
        for y in years:
            at = F.when(F.col(year) == y, F.col(value))
            each += [(F.count_if(F.col(year) == y) > 0).alias(f"__has{k}_{y}"), F.min(at).alias(f"__low{k}_{y}"), F.max(at).alias(f"__high{k}_{y}")]
        grouped = past.select(year, value, *[key(c).alias(f"__k_{c}") for c in level]).groupBy(*[f"__k_{c}" for c in level]).agg(*each)
        df = df.join(grouped, [f"__k_{c}" for c in level], "left")
    found, clash = {}, F.lit(False)
    for y in years:
        pick = several = None
        for k in range(len(levels)):
            has, low, high = F.col(f"__has{k}_{y}"), F.col(f"__low{k}_{y}"), F.col(f"__high{k}_{y}")
            one = F.when(low == high, low)
            pick = F.when(has, one) if pick is None else pick.when(has, one)
            several = F.when(has, low != high) if several is None else several.when(has, low != high)
        found[f"{out}{y}"] = pick
        clash = clash | F.coalesce(several, F.lit(False))
    return df.select(*base.columns, *[c.alias(n) for n, c in found.items()], clash.alias("ambiguous"))


def recent_trend(df: DataFrame, now: str, before: list[str]) -> DataFrame:
    """Adds years_observed, and mean, population deviation and trend of the last three years.

    before: columns of earlier years, oldest first. An ambiguous history has neither deviation nor trend.
    """
    there = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    recent, years = there(*before[-2:], now), F.size(there(*before, now))
    mean = F.aggregate(recent, F.lit(0.0), lambda s, x: s + x) / F.size(recent)
    spread = F.sqrt(F.aggregate(recent, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(recent))
    change = F.coalesce(*[(F.col(now) - F.col(c)) / (k + 1) for k, c in enumerate(reversed(before))])
    trend = F.when(F.col("ambiguous") | (years < 2) | change.isNull(), "unknown").when(change > 0.5, "up").when(change < -0.5, "down").otherwise("stable")
    return df.withColumns({
        "years_observed": years.cast("bigint"),
        "avg_recent": F.round(F.when(F.col("ambiguous"), F.col(now)).when(F.size(recent) > 0, mean), 2),
        "std_recent": F.when(~F.col("ambiguous") & (F.size(recent) >= 2), F.round(spread, 2)),
        "trend": trend,
    })
