"""Exact quantiles by distributed selection: count by ranges, then refine the ranges that hold the ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import store
from .series import null_safe

#: Parts that a range is cut into in a pass; ranges that are broadcast at most.
CELLS, BROADCAST = 4096, 50_000


def quantiles(df: DataFrame, keys: list[str], value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """keys, n and out: the exact interpolated quantiles of each group's finite values, one for each of probs.

    Ranks are wanted at p * (n - 1), between the two nearest values. A pass counts the rows of
    each open range in CELLS equal parts (partial sums, so only counts are shuffled), and keeps
    of each the part that holds the rank, closed in to the values that are there. A range ends
    when it holds one value; a range of n values takes about log(n) / log(CELLS) + 1 passes,
    and after the first pass few rows are in any. No task sees a group's values together.
    Groups without finite values are left out; without keys such a table gives no row.
    """
    v, at = F.col("__v"), F.col("__rank")
    finite = F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < F.lit(float("inf")))
    rows = store(df.select(*keys, F.col(value).cast("double").alias("__v")).where(finite), "quantile-rows")
    groups = store(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")).where("n > 0"), "quantile-groups")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)) for p in probs])))
    wanted = groups.select(*keys, "__low", "__high", F.explode(ranks).alias("__rank"), F.lit(0).cast("bigint").alias("__below"))
    found = None
    while True:
        wanted = store(wanted, "quantile-ranges")
        done = wanted.where("__low = __high").select(*keys, "__rank", F.col("__low").alias("__value"))
        found = done if found is None else found.unionByName(done)
        left = wanted.where("__low < __high")
        ranges = left.select(*keys, "__low", "__high").distinct()
        few = ranges.limit(BROADCAST + 1).count()
        if not few:
            break
        span = [*keys, "__low", "__high"]
        held = _within(rows, F.broadcast(ranges) if few <= BROADCAST else ranges, keys)
        part = F.least(F.lit(CELLS - 1), F.floor((v / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2) * CELLS)).alias("__cell")
        counts = held.groupBy(*span, part).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
        before = Window.partitionBy(*span).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS rows
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        joined = null_safe(left, counts, span, "inner")
        inside = (at >= F.col("__below") + F.col("__before")) & (at < F.col("__below") + F.col("__before") + F.col("__n"))
        wanted = joined.where(inside).select(*keys, F.col("__from").alias("__low"), F.col("__to").alias("__high"), "__rank", (F.col("__below") + F.col("__before")).alias("__below"))
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__values"))  # two a probability at most
    whole = null_safe(groups.select(*keys, "n"), values, keys, "inner") if keys else groups.select("n").crossJoin(values)

    def at_share(p: float):
        place = (F.col("n") - 1) * F.lit(p)
        low, high = F.col("__values")[F.floor(place)], F.col("__values")[F.ceil(place)]
        return low + (high - low) * (place - F.floor(place))

    return whole.select(*keys, "n", F.array(*map(at_share, probs)).alias(out))


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the range of their group that holds them."""
    names = {k: f"__r_{k}" for k in keys}
    ranges = ranges.withColumnsRenamed(names)
    on = (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high"))
    for k, name in names.items():
        on = F.col(k).eqNullSafe(F.col(name)) & on
    return rows.join(ranges, on).drop(*names.values())


def quantiles_of(df: DataFrame, keys: list[str], values: list[str], probs: Sequence[float]) -> DataFrame:
    """keys and q_<value> of several columns, found together; null where a column has no finite value."""
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("__of"), F.col(c).cast("double").alias("__value_of")) for c in values])))
    q = quantiles(long, [*keys, "__of"], "__value_of", probs)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("__of") == c, F.col("q"))).alias(f"q_{c}") for c in values])


def with_quantiles(df: DataFrame, keys: list[str], values: list[str], probs: Sequence[float], of: DataFrame | None = None) -> DataFrame:
    """df with q_<value> of its group for each column; of: the table whose values they are, df unless given."""
    q = quantiles_of(df if of is None else of, keys, values, probs)
    if keys:
        return null_safe(df, q, keys)
    return df.join(F.broadcast(q), F.lit(True), "left")  # one row
