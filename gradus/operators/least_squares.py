"""Least squares of least norm, from one aggregate of the products of the columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles_of

#: Directions whose share of the largest eigenvalue is below count as none: sums of products
#: hold about half of a double's digits.
CUTOFF = 1e-10


@dataclass
class LinearModel:
    """Weights of an intercept, of each feature (medians for nulls, standardised) and of whether it is missing."""

    features: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    weights: list[float]
    missing: list[float]
    intercept: float
    rank: int
    rows: int

    def design(self) -> list[Column]:
        return _design(self.features, self.medians, self.means, self.scales)

    def predict(self) -> Column:
        """The prediction as an expression of the features."""
        out = F.lit(self.intercept)
        for weight, x in zip([*self.weights, *self.missing], self.design()[1:], strict=True):
            out = out + F.lit(weight) * x
        return out


def _design(features, medians, means, scales) -> list[Column]:
    real = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features]
    filled = [(F.coalesce(x, F.lit(m)) - F.lit(a)) / F.lit(s) for x, m, a, s in zip(real, medians, means, scales, strict=True)]
    return [F.lit(1.0), *filled, *[x.isNull().cast("double") for x in real]]


def fit(df: DataFrame, features: list[str], target: str) -> LinearModel:
    """The weights of least norm among those of least squared error; right on collinear columns.

    Medians, means and deviations are those of df. A column null in every row counts as zero.
    Rows without a target are left out; no rows: ValueError. The driver solves a system as wide
    as the columns, whatever the number of rows.
    """
    df = df.where(F.col(target).isNotNull())
    found = quantiles_of(df, [], features, [0.5]).first()
    medians = [float((found and found[f"q_{c}"] or [0.0])[0]) for c in features]
    zero, one = [0.0] * len(features), [1.0] * len(features)
    plain = _design(features, medians, zero, one)[1 : 1 + len(features)]
    row = df.agg(F.count(F.lit(1)), *map(F.avg, plain), *map(F.stddev_pop, plain)).first()
    n, k = row[0], len(features)
    if not n:
        raise ValueError("No rows to learn from.")
    means, scales = list(row[1 : 1 + k]), [s or 1.0 for s in row[1 + k :]]
    columns = [*_design(features, medians, means, scales), F.col(target).cast("double")]
    wide = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    sums = wide.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
    gram = np.zeros((len(columns), len(columns)))
    for (i, j), s in zip(pairs, sums, strict=True):
        gram[i, j] = gram[j, i] = s
    values, vectors = np.linalg.eigh(gram[:-1, :-1])
    kept = values > CUTOFF * values.max()
    inverse = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T
    beta = (inverse @ gram[:-1, -1]).tolist()
    return LinearModel(features, medians, means, scales, beta[1 : 1 + k], beta[1 + k :], beta[0], int(kept.sum()), n)
