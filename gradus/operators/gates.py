"""Row gates: reasons for rejection, splits, duplicates, first-wins and invariant checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(masks: dict[str, Column]) -> Column:
    """Names of the masks that hold, in declared order, joined by |; null if none."""
    held = F.array_compact(F.array(*[F.when(mask, F.lit(name)) for name, mask in masks.items()]))
    return F.when(F.size(held) > 0, F.array_join(held, "|"))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a declared order; null keys form one group."""
    (mark,) = ("__first",)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(mark, rank).where(F.col(mark) == 1).drop(mark)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every member of a key that occurs more than once."""
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("__n", count).where("__n > 1").drop("__n")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Raise with up to five examples if a key repeats."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"keys {keys} repeat: {[tuple(r) for r in bad]}")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys match, after a check that right's keys are unique."""
    from .series import null_safe

    assert_unique(right, keys)
    return null_safe(left, right, keys)


def violations(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows whose text isn't blank and doesn't parse as kind."""
    text = F.nullif(F.trim(F.col(column)), F.lit(""))
    return df.where(text.isNotNull() & text.try_cast(kind).isNull())


def distinct_join(column: str, sep: str = ";") -> Column:
    """Sorted distinct values of a group, joined; nulls left out."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


YES, NO = ["true", "1", "yes"], ["false", "0", "no"]


def strictly(df: DataFrame, kinds: dict[str, str], source: str) -> DataFrame:
    """Text columns parsed as their kinds; blank is null. A value of another form stops the job.

    kinds: double, boolean (YES or NO, in any case) or another type's name. The error names the
    source, the column and up to five such values of the batch that it was found in. Rows are
    checked as they stream by: there is no pass of its own.
    """
    import pyarrow as pa

    def parsed(name: str, kind: str) -> Column:
        text = F.nullif(F.trim(F.col(name)), F.lit(""))
        if kind == "boolean":
            return F.when(F.lower(text).isin(YES), True).when(F.lower(text).isin(NO), False)
        return text.try_cast(kind)

    def wrong(name: str, kind: str) -> Column:
        return F.when(F.nullif(F.trim(F.col(name)), F.lit("")).isNotNull() & parsed(name, kind).isNull(), F.col(name))

    out = [parsed(c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns]
    checked = df.select(*out, *[wrong(c, k).alias(f"__wrong_{i}") for i, (c, k) in enumerate(kinds.items())])

    def run(batches):
        for batch in batches:
            for i, c in enumerate(kinds):
                bad = batch.column(f"__wrong_{i}").drop_null()
                if len(bad):
                    raise ValueError(f"{source}: {c} has values that aren't {kinds[c]}: {bad.slice(0, 5).to_pylist()}")
            yield pa.RecordBatch.from_arrays(batch.columns[: -len(kinds)], schema=pa.schema(list(batch.schema)[: -len(kinds)]))

    return checked.mapInArrow(run, checked.drop(*[f"__wrong_{i}" for i in range(len(kinds))]).schema)
