"""Quality rules: fixed base rules, then robust multivariate outliers (DataFrame functions only).

Statistics of each whole text are array expressions on its own row; no shuffle. Documents
that pass the base rules are judged against a minimum-covariance-determinant estimate of
their language and source. Groups under MIN_GROUP documents are judged by their language's
estimate, over all its documents; languages under it by that of all documents; if those are
fewer, nothing is rejected.

The vector: ln(mean word length), ln(1 + 100 symbols a word character), ln(1 + repeated
lines), ln(1 + 10 * share of words in repeated windows). FLOORS are least standard deviations,
as most documents have no symbols or repeats at all and exact zeros make scatter singular;
their squares are added to the scatter (the regularised form of the estimator).

Estimates rest on counts of vectors rounded to steps of 1 / GRID, so a step of the method
costs as much as there are distinct rounded vectors. From four starts (medians with median
deviations, all rows' moments, moments of the half nearest to the medians, spatial signs)
concentration steps take the H share of nearest documents and their moments again, until no
start's determinant changes by more than a millionth, or MAX_STEPS. The start with the least
determinant stands. Verdicts use the vectors as they are.

Every step is a mergeable aggregate over all documents. Quantiles are exact percentiles of
values rounded to fixed steps, whose buffers hold counts by distinct step, so one group may
hold any share of the rows. Estimates (a row a group and start) are written to the shared
folder.

Defined cases: null, empty and blank texts have no words and fail the base rule; null
language or source is a group of its own; repeated rows count and repeat; an empty table
gives an empty result; further columns are ignored (kept by keep).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import broadcast_small, exact, fresh, materialize, word_split

#: Share of a group's documents that an estimate rests on, most concentration steps, smallest group, steps a unit of rounding.
H, MAX_STEPS, MIN_GROUP, GRID = 0.75, 30, 40, 64
#: Squared distances over this are rejected: beyond the 1 - 1e-9 quantile of chi-squared, 4 df.
CUT = 49.0
#: Medians of chi-squared with 4 degrees of freedom; least standard deviations by coordinate.
#: Each coordinate can reach the cut alone: 6 % of symbols, 11 repeated lines, half the words in repeats.
MEDIAN_4, FLOORS = 3.3567, (0.06, 0.25, 0.35, 0.25)
P = len(FLOORS)
#: Estimates (rows of some 200 bytes) that are broadcast; more are joined by a shuffle.
BROADCAST = 50_000
MIN_WORDS, MAX_REPEAT = 50, 50


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more; windows sorted, so n log n."""

    def windows(w):
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(grams):
        by_text = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        places = let(
            by_text,
            lambda s: F.transform(
                F.filter(s, lambda e, k: (F.get(s, k - 1)["g"] == e["g"]) | (F.get(s, k + 1)["g"] == e["g"])), lambda e: e["i"]
            ),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i + 3 - acc["end"])).alias("n"), (i + 3).alias("end"))
        return F.aggregate(F.array_sort(places), start, step, lambda acc: acc["n"])

    return let(windows(words), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return let(
        word_split(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            symbols.cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _repeat_words(w).cast("bigint").alias("n_repeat_words"),
        ),
    )


def base_failed(s=F.col) -> Column:
    """s gives a statistic's column by its name."""
    return (s("n_words") < MIN_WORDS) | (100 * s("n_repeat_words") > MAX_REPEAT * s("n_words"))


def _vector(s=F.col) -> list[Column]:
    n, chars = F.greatest(s("n_words"), F.lit(1)), F.greatest(s("word_chars"), F.lit(1))
    return [
        F.log(chars / n),
        F.log1p(100 * s("n_symbols") / chars),
        F.log1p(s("n_dup_lines").cast("double")),
        F.log1p(10 * s("n_repeat_words") / n),
    ]


def _distance(x: list[Column], m: list[Column], low: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    z: list[Column] = []
    for i in range(P):
        rest = x[i] - m[i]
        for j in range(i):
            rest = rest - low[i][j] * z[j]
        z.append(rest / low[i][i])
    return sum((v * v for v in z[1:]), z[0] * z[0])


_X, _M = [f"x_{i}" for i in range(P)], [f"m_{i}" for i in range(P)]
_C = [f"c_{i}{j}" for i in range(P) for j in range(i + 1)]
_L = [[f"l_{i}{j}" for j in range(i + 1)] for i in range(P)]
_LOWER = [c for r in _L for c in r]


def _factor(est: DataFrame, scale: Column) -> DataFrame:
    """Adds the Cholesky factor l_ij of scale * cov + floors, and the logarithm of its determinant."""
    for i in range(P):
        for j in range(i + 1):
            a = F.coalesce(F.col(f"c_{i}{j}"), F.lit(0.0)) * scale + (F.lit(FLOORS[i] ** 2) if i == j else 0)
            for k in range(j):
                a = a - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            est = est.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(a, F.lit(FLOORS[i] ** 2))) if i == j else a / F.col(f"l_{j}{j}"))
    return est.withColumn("det", sum((2 * F.log(f"l_{i}{i}") for i in range(1, P)), 2 * F.log("l_00")))


def _with_distance(points: DataFrame, est: DataFrame, hint=broadcast_small) -> DataFrame:
    """points with each estimate of their group and d, the rounded logarithm of their squared distance from it."""
    d = _distance([F.col(c) for c in _X], [F.col(c) for c in _M], [[F.col(c) for c in r] for r in _L])
    return points.join(hint(est), "g").withColumn("d", F.round(F.log(F.greatest(d, F.lit(1e-9))) * 64))


def _moments() -> list[Column]:
    """Means m_i and covariances c_ij of x_i, rows counted n times."""
    n = F.sum("n")
    mean = [F.sum(F.col("n") * F.col(x)) / n for x in _X]
    cross = [(F.sum(F.col("n") * F.col(_X[i]) * F.col(_X[j])) / n - mean[i] * mean[j]).alias(f"c_{i}{j}") for i in range(P) for j in range(i + 1)]
    return [m.alias(_M[i]) for i, m in enumerate(mean)] + cross


def _step(points: DataFrame, est: DataFrame, h: float, hint=broadcast_small) -> DataFrame:
    """A concentration step: moments of the h share of rows nearest to each estimate (g, start).

    hint: broadcasts estimates, where they have been counted.
    """
    near = _with_distance(points, est.select("g", "start", *_M, *_LOWER), hint).select("g", "start", *_X, "n", "d")
    cut = near.groupBy("g", "start").agg(F.percentile("d", F.lit(h), F.col("n")).alias("cut"))
    near = near.join(hint(cut), ["g", "start"]).where(F.col("d") <= F.col("cut"))
    return materialize(_factor(near.groupBy("g", "start").agg(*_moments()), F.lit(1.0)), "quality-est")


def _starts(points: DataFrame, min_group: int) -> DataFrame:
    """Four estimates a group: g, start, m_i, l_ij, det."""
    medians = points.groupBy("g").agg(F.sum("n").alias("rows"), *[F.percentile(x, F.lit(0.5), F.col("n")).alias(m) for x, m in zip(_X, _M, strict=True)])
    medians = materialize(medians.where(F.col("rows") >= min_group), "quality-est")
    gaps = points.join(broadcast_small(medians.select("g", *_M)), "g")
    spread = gaps.groupBy("g").agg(*[F.first(m).alias(m) for m in _M], *[(1.4826 * F.percentile(F.abs(F.col(x) - F.col(m)), F.lit(0.5), F.col("n"))).alias(f"s_{i}") for i, (x, m) in enumerate(zip(_X, _M, strict=True))])
    spread = materialize(spread, "quality-est")
    plain = spread.select("g", F.lit(0).alias("start"), *_M, *[F.col(f"s_{i}") * F.col(f"s_{i}") if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)]).toDF("g", "start", *_M, *_C)
    plain = materialize(_factor(plain, F.lit(1.0)), "quality-est")
    every = points.join(broadcast_small(medians.select("g")), "g").groupBy("g").agg(*_moments()).select("g", F.lit(1).alias("start"), *_M, *_C)
    half = _step(points, plain, 0.5).select("g", F.lit(2).alias("start"), *_M, *_C)
    scaled = [F.greatest(F.col(f"s_{i}"), F.lit(FLOORS[i])) for i in range(P)]
    z = [(F.col(x) - F.col(m)) / w for x, m, w in zip(_X, _M, scaled, strict=True)]
    length = F.greatest(sum((v * v for v in z[1:]), z[0] * z[0]), F.lit(1e-12))
    cross = [F.sum(F.col("n") * z[i] * z[j] * scaled[i] * scaled[j] / length) / F.sum("n") for i in range(P) for j in range(i + 1)]
    signs = points.join(broadcast_small(spread), "g").groupBy("g").agg(*[F.first(m).alias(m) for m in _M], *[c.alias(n) for c, n in zip(cross, _C, strict=True)])
    signs = signs.select("g", F.lit(3).alias("start"), *_M, *_C)
    rest = _factor(every.unionByName(half).unionByName(signs), F.lit(1.0))
    return materialize(plain.unionByName(rest), "quality-est")


def _points(good: DataFrame, min_group: int) -> tuple[DataFrame, DataFrame]:
    """(group name g of each lang and source; g, rounded vector, number of documents)."""
    rounded = [(F.round(v * GRID) / GRID).alias(x) for v, x in zip(_vector(), _X, strict=True)]
    cells = materialize(good.select("lang", "source", *rounded).groupBy("lang", "source", *_X).agg(F.count(F.lit(1)).alias("n")), "quality-cells")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("count"))
    by_lang = cells.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("pool"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("?"))
    groups = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("of"))).select(
        "lang",
        "source",
        F.when(F.col("count") >= min_group, F.concat_ws("\x1f", F.lit("s"), text("lang"), text("source")))
        .when(F.col("pool") >= min_group, F.concat_ws("\x1f", F.lit("l"), text("lang")))
        .otherwise(F.lit("all"))
        .alias("g"),
    )
    groups = materialize(groups, "quality-groups")
    used = broadcast_small(groups.select("g").distinct())
    levels = [F.concat_ws("\x1f", F.lit("s"), text("lang"), text("source")), F.concat_ws("\x1f", F.lit("l"), text("lang")), F.lit("all")]
    points = cells.select(F.explode(F.array(*levels)).alias("g"), *_X, "n").join(used, "g")
    return groups, materialize(points.groupBy("g", *_X).agg(F.sum("n").alias("n")), "quality-points")


def estimates(stats: DataFrame, h: float = H, max_steps: int = MAX_STEPS, min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """(group name of each lang and source, MCD estimate of each group).

    stats: lang, source and the five statistics; documents that fail the base rules don't count.
    """
    groups, points = _points(stats.where(~base_failed()), min_group)
    est = _starts(points, min_group)
    hint = F.broadcast if est.limit(BROADCAST + 1).count() <= BROADCAST else lambda df: df
    for k in range(max_steps):
        after = _step(points, est, h, hint)
        if k:
            old = est.select("g", "start", F.col("det").alias("old"))
            moved = after.join(old, ["g", "start"]).where(F.abs(F.col("det") - F.col("old")) > 1e-6)
            if moved.isEmpty():
                break
        est = after
    least = F.min_by(F.struct(*_M, *_C), F.struct("det", "start")).alias("e")
    best = materialize(_factor(after.groupBy("g").agg(least).select("g", "e.*"), F.lit(1.0)), "quality-est")
    mid = _with_distance(points, best).groupBy("g").agg(F.percentile("d", F.lit(0.5), F.col("n")).alias("mid"))
    scale = F.greatest(F.lit(1.0), F.exp(F.col("mid") / 64) / MEDIAN_4)
    final = _factor(best.select("g", *_M, *_C).join(mid, "g").withColumn("scale", scale), F.col("scale"))
    return groups, materialize(final.select("g", *_M, *_LOWER), "quality-est")


def _limits(stats: DataFrame) -> DataFrame:
    """q_lang, q_source and the estimate that judges them (nulls where none does)."""
    groups, est = estimates(stats)
    limits = groups.join(est, "g").select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), *_M, *_LOWER)
    return broadcast_small(materialize(limits, "quality-limits"))


def _verdict(s=F.col, limit=F.col) -> Column:
    """s and limit give columns of the statistics and of the estimate."""

    def near(x):
        d = _distance([x[f"x_{i}"] for i in range(P)], [limit(c) for c in _M], [[limit(c) for c in r] for r in _L])
        return F.coalesce(d <= CUT, F.lit(True))

    return ~base_failed(s) & let(F.struct(*[v.alias(f"x_{i}") for i, v in enumerate(_vector(s))]), near)


def _stats(docs: DataFrame) -> DataFrame:
    cut = docs.select(exact(docs, "doc_id").alias("doc_id"), exact(docs, "lang").alias("lang"), exact(docs, "source").alias("source"), statistics(exact(docs, "text")).alias("s"))
    return materialize(cut.select("doc_id", "lang", "source", "s.*"), "quality-stats")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five statistics, base_failed and kept of every row."""
    stats = _stats(docs)
    limits = _limits(stats)
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("q_lang")) & F.col("source").eqNullSafe(F.col("q_source")), "left")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select("doc_id", *names, base_failed().alias("base_failed"), _verdict().alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows that judge keeps, with all their columns.

    Rows are written once with their statistics, which cost more than a copy; texts are never shuffled.
    """
    (mark,) = fresh(docs, "quality_statistics")
    wide = materialize(docs.withColumn(mark, statistics(exact(docs, "text"))), "quality-rows")
    lang, source = exact(docs, "lang"), exact(docs, "source")
    limits = _limits(wide.select(lang.alias("lang"), source.alias("source"), f"{mark}.*"))
    names = {c: n for c, n in zip(limits.columns, fresh(wide, *[f"quality_{c}" for c in limits.columns]), strict=True)}
    joined = wide.join(broadcast_small(limits.withColumnsRenamed(names)), lang.eqNullSafe(F.col(names["q_lang"])) & source.eqNullSafe(F.col(names["q_source"])), "left")
    kept = joined.where(_verdict(lambda c: F.col(mark)[c], lambda c: F.col(names[c])))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
