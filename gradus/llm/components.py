"""Connected components by alternating large and small stars.

Everything stays distributed: a round is two group-minimum aggregations, each joined back
to the edges (equi-joins, which adaptive execution splits where a hub is skewed), and its
edges are written to the shared folder, where they replace the last round's. The driver sees
a count and a checksum a round; where those rest, the edges themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node it is connected with) of every node with an edge to another.

    Edges may repeat, run either way or from a node to itself; null ends are left out; no
    edge gives an empty result.
    """
    edges = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    now = materialize(edges.where("a is not null and b is not null and a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        last, now = now, materialize(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        same = state == before and now.subtract(last).isEmpty()  # neither repeats an edge
        discard(last)
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
