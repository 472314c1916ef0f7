"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto the axes of ROTATIONS random orthonormal bases. Each DIMS axes
of a basis, shifted, carry one Hilbert curve. A curve tells near from far best where it is
sparse, so a vector is listed on the LISTED curves on which its projection is longest, and
a query looks on its PROBED longest ones. The orderings are range-partitioned in Spark and
cut into blocks of BLOCK places; a query goes to the blocks that its windows, a radius of
places to either side, touch. There the window's vectors rank by exact distance; a task
merges its queries' short lists before they leave it, and the lists of all tasks merge again.

The radius follows the data: for SAMPLE queries the exact neighbours are found by one pass
over all rows, and the radius is the least at which TARGET of those neighbours lie in a
window of their query. Data without structure thus get wider windows instead of a low
recall. If no radius reaches TARGET, or windows would cover the table, or it has no more
than BLOCK distinct vectors, every vector is compared.

Equal vectors are one entry, with as many of their smallest ids as an answer can hold, so
any share of the rows may be copies. Centre and scale are fitted on FIT vectors, the first
by a hash of their id; every row is indexed. A task holds one block at a time and the short
lists of HELD queries.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without an id or vectors whose length isn't the table's most frequent one
(the larger, if tied); a repeated id with one vector counts once; ties go to the smaller id;
with fewer candidates than k all are returned; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import broadcast_small, exact, materialize

ROTATIONS, DIMS, BITS, LISTED, PROBED, BLOCK = 16, 4, 15, 12, 96, 256
#: Bounded samples: vectors that centre and scale are fitted on; queries that the radius is fitted on.
FIT, SAMPLE, TARGET = 4096, 96, 0.95
#: Queries whose short lists a task holds before it hands them on; rows projected at a time.
HELD, SLICE = 20_000, 1024
SEED, K, EVERY = 7, 10, 100


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of cells (n, dims), coordinates under 2**bits.

    Gray-code and rotation passes from the highest bit down, then the bits interleave.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            up = (x[:, i] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


class Curves:
    """The projections, fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS, dims: int = DIMS, bits: int = BITS, listed: int = LISTED, seed: int = SEED):
        rng, width = np.random.default_rng(seed), sample.shape[1]
        self.bits, self.dims = bits, min(dims, width)
        each = width // self.dims
        if each < 4:  # the few curves of a basis tell little apart: every vector is on every curve
            rotations = -(-listed // each)
        self.mean = sample.mean(axis=0)
        self.scale = max(float((sample - self.mean).std()), 1e-300)
        self.axes = np.hstack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, : each * self.dims] for _ in range(rotations)])
        self.count = rotations * each
        self.shifts = rng.random((self.count, self.dims))

    def longest(self, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, curve, key) of each vector on the curves where its projection is longest."""
        most = min(most, self.count)
        seen = ((vectors - self.mean) / self.scale @ self.axes).reshape(len(vectors), self.count, self.dims)
        curves = np.argsort(-(seen * seen).sum(axis=2), axis=1, kind="stable")[:, :most]
        rows = np.repeat(np.arange(len(vectors)), most)
        curves = curves.ravel()
        y = seen[rows, curves]
        y = y / (1 + np.abs(y)) / 2 + 0.5  # any length has a cell
        top = (1 << self.bits) - 1
        return rows, curves, hilbert_keys(((7 * y + self.shifts[curves]) / 8 * top).astype(np.int64), self.bits)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _vectors(table: DataFrame) -> DataFrame:
    """id and vec (array of float or double, as in the table) of rows that take part."""
    kind = "float" if table.select(exact(table, "embedding")).dtypes[0][1] == "array<float>" else "double"
    rows = table.select(exact(table, "vec_id").cast("bigint").alias("id"), exact(table, "embedding").cast(f"array<{kind}>").alias("vec"))
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    widths = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    rows = rows.where(F.size("vec") == (widths.w if widths else 0))
    return rows.select("id", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind)).alias("vec"))  # no negative zeros


def _entries(vectors: DataFrame, k: int) -> DataFrame:
    """One row a distinct vector: rep (its smallest id), members (its k + 1 smallest ids), vec."""
    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    few = vectors.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    members = F.slice(F.sort_array(F.collect_set("id")), 1, k + 1)
    return few.groupBy("vec").agg(F.min("id").alias("rep"), members.alias("members")).select("rep", "members", "vec")


def _keyed(curves: Curves, most: int, probe: bool):
    def run(batches):
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            rows, curve, key = curves.longest(_matrix(batch.column(1)), most)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(curve, pa.int32()), pa.array(key), pa.array([probe] * len(rows))]
            yield pa.record_batch(columns, ["rep", "curve", "key", "probe"])

    return run


def _placed(batches):
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.record_batch([*batch.columns, pa.array([part] * n, pa.int64()), pa.array(np.arange(at, at + n))], ["rep", "curve", "probe", "part", "at"])
        at += n


def _places(entries: DataFrame, asked: DataFrame, curves: Curves) -> DataFrame:
    """rep, curve, probe (a query's place, not a listed vector's) and at, counted along the orderings one after another."""
    form = "rep bigint, curve int, key bigint, probe boolean"
    keyed = entries.select("rep", "vec").mapInArrow(_keyed(curves, LISTED, False), form)
    keyed = keyed.unionByName(asked.select("rep", "vec").mapInArrow(_keyed(curves, PROBED, True), form))
    order = ["curve", "key", "rep", "probe"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("rep", "curve", "probe")
    placed = materialize(ordered.mapInArrow(_placed, "rep bigint, curve int, probe boolean, part bigint, at bigint"), "ann-places")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg((F.max("at") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(broadcast_small(parts), "part").select("rep", "curve", "probe", (F.col("base") + F.col("at")).alias("at"))


def _nearest(ids: np.ndarray, squares: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by distance, then id."""
    if len(ids) > k:
        limit = np.partition(squares, k - 1)[k - 1]
        some = np.flatnonzero(squares <= limit)
        return some[np.lexsort((ids[some], squares[some]))][:k]
    return np.lexsort((ids, squares))


class _Lists:
    """The k nearest found so far to each of some queries."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, query: int, ids: np.ndarray, squares: np.ndarray) -> None:
        old, far = self.of.get(query, (ids[:0], squares[:0]))
        if len(old) == self.k:
            near = squares <= far[-1]
            ids, squares = ids[near], squares[near]
            if not len(ids):
                return
        ids, first = np.unique(np.concatenate((old, ids)), return_index=True)
        squares = np.concatenate((far, squares))[first]
        best = _nearest(ids, squares, self.k)
        self.of[query] = ids[best], squares[best]

    def rows(self):
        """The lists as (query, rep, square), which are then empty again."""
        if self.of:
            queries = np.repeat([*self.of], [len(x[0]) for x in self.of.values()])
            columns = [queries, *(np.concatenate(x) for x in zip(*self.of.values(), strict=True))]
            self.of = {}
            yield pa.record_batch([pa.array(x) for x in columns], ["query", "rep", "square"])


_FOUND = "query bigint, rep bigint, square double"


def _brute(ids: np.ndarray, queries: np.ndarray, k: int):
    """Each partition's k nearest to each of a few queries."""

    def run(batches):
        lists = _Lists(k)
        for batch in batches:
            reps, vectors = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for q, query in zip(ids.tolist(), queries, strict=True):
                lists.add(q, reps, ((vectors - query) ** 2).sum(axis=1))
        yield from lists.rows()

    return run


def _search(k: int):
    """Rows (block, ask, low, high, rep, vec) sorted by block, vectors by place first: each query's k nearest of the task's windows.

    low: a vector's place, or the first of a window; high: the place after the window's last.
    """

    def run(batches):
        lists, now, held, asks = _Lists(k), None, [], []

        def finish():
            if held and asks:
                at, _, reps, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                for low, high, queries, points in asks:
                    begins, ends = np.searchsorted(at, low), np.searchsorted(at, high)
                    for q, point, s, e in zip(queries.tolist(), points, begins.tolist(), ends.tolist(), strict=True):
                        if s < e:
                            lists.add(q, reps[s:e], ((vectors[s:e] - point) ** 2).sum(axis=1))

        for batch in batches:
            blocks, ask, low, high, reps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            vectors = _matrix(batch.column(5))
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(ask) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if s == e:
                    continue
                if blocks[s] != now:
                    finish()
                    now, held, asks = blocks[s], [], []
                    if len(lists.of) >= HELD:
                        yield from lists.rows()
                (asks if ask[s] else held).append(tuple(x[s:e].copy() for x in (low, high, reps, vectors)))
        finish()
        yield from lists.rows()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("square", "rep")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def _radius(entries: DataFrame, asked: DataFrame, places: DataFrame, k: int, sample: int, target: float) -> int | None:
    """The least radius at which target of the sampled queries' true neighbours lie in a window; None if none does."""
    rows = asked.orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    if not rows:
        return 0
    ids, vectors = np.array([r.rep for r in rows]), np.array([r.vec for r in rows], np.float64)
    true = _best(entries.select("rep", "vec").mapInArrow(_brute(ids, vectors, k + 1), _FOUND), k + 1).where("query <> rep")
    true = F.broadcast(materialize(true.select("query", "rep"), "ann-true"))  # at most sample * (k + 1) pairs
    one = places.where("probe").join(true, places.rep == true.query).select("query", true.rep, "curve", F.col("at").alias("a"))
    one = F.broadcast(one)  # at most sample * (k + 1) * PROBED rows
    two = places.where("not probe").select("rep", "curve", F.col("at").alias("b"))
    gaps = two.join(one, ["rep", "curve"]).groupBy("query", "rep").agg(F.min(F.abs(F.col("a") - F.col("b"))).alias("gap"))
    found = sorted(r.gap for r in gaps.collect())
    need = int(np.ceil(target * true.count()))
    return found[need - 1] if 0 < need <= len(found) else None if need else 0


def search(table: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (distance) of the k nearest found to each query.

    is_query: condition on the column id.
    """
    vectors = materialize(_vectors(table), "ann-vectors")
    entries = materialize(_entries(vectors, k), "ann-entries")
    fit = [r.vec for r in entries.orderBy(F.xxhash64("rep"), "rep").limit(FIT).select("vec").collect()]
    queries = vectors.where(is_query).distinct().join(entries.select("rep", "vec"), "vec").select("id", "rep", "vec")
    queries = materialize(queries, "ann-queries")
    asked = materialize(queries.select("rep", "vec").dropDuplicates(["rep"]), "ann-asked")
    curves = Curves(np.array(fit, np.float64) if fit else np.zeros((1, 1)))
    places = materialize(_places(entries, asked, curves), "ann-at")
    radius, last = _radius(entries, asked, places, k, sample, target), places.agg(F.max("at")).first()[0] or 0
    cut = lambda at: F.floor(at / block).cast("bigint")
    held = places.where("not probe").join(entries.select("rep", "vec"), "rep")
    held = held.select(cut(F.col("at")).alias("block"), F.lit(0).alias("ask"), F.col("at").alias("low"), F.col("at").alias("high"), "rep", "vec")
    if radius is None or 2 * radius * min(PROBED, curves.count) >= last or entries.limit(block + 1).count() <= block:
        windows = asked.select("rep", F.lit(0).alias("low"), F.lit(last + 1).alias("high"))
    else:
        windows = places.where("probe").select("rep", F.greatest(F.col("at") - radius, F.lit(0)).alias("low"), (F.col("at") + radius + 1).alias("high"))
    windows = windows.select("rep", "low", "high", F.explode(F.sequence(cut(F.col("low")), cut(F.col("high") - 1))).alias("block"))
    asks = windows.join(asked, "rep").select("block", F.lit(1).alias("ask"), "low", "high", "rep", "vec")
    rows = held.unionByName(asks).repartition("block").sortWithinPartitions("block", "ask", "low")
    found = _best(rows.mapInArrow(_search(k + 1), _FOUND), k + 1)
    each = found.join(entries.select("rep", "members"), "rep").select("query", "square", F.explode("members").alias("vec_id"))
    each = queries.select(F.col("id").alias("query_id"), F.col("rep").alias("query")).join(each, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("square", "vec_id"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.sqrt("square").alias("score"))


def op5_ann(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % EVERY == 0)
