"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits over the XXH64 (seed 42) of 3-word shingles; a bit is set if more than
half the shingles set it. Documents whose fingerprints differ in at most 2 bits are linked;
components are what links connect.

The anchors are a covering code: the product of three binary Golay codes [23, 12, 7] on bits
0-22, 23-45 and 46-63 (the last padded with five zeros). Each is perfect with radius 3, so
every 64-bit word lies within 9 bits of an anchor. A fingerprint x goes to every anchor that
covers a word within one bit of x; all of these lie within the covering radius plus the
threshold. Two fingerprints at distance 2 or less have a word z within one bit of both, so
both go to the anchor that covers z: no link is lost. About 16 anchors come of a
fingerprint, and an anchor is one of 2^36, so buckets stay small.

Only distinct fingerprints are compared; copies are one row with their smallest doc_id. A
bucket emits a spanning forest of its links (at most its size less one), never all pairs.
Buckets over SPLIT fingerprints are dealt out further by bands of bits: of 3, then 4, then
6 bands, all but two are equal in a linked pair, so it shares a choice of bands; the same
exact comparison follows in each. The last leaves 22 free bits, which bounds a bucket.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any
other; repeated rows repeat in the result; a null doc_id takes part in links, but is only
the component's id if no other is in it; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import exact, fresh, materialize
from .components import connected

THRESHOLD = 2
SHINGLE = 3
SEED = 42
#: The generator polynomial of the binary Golay code,
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and the bits of its three blocks.
GENERATOR = 0b110001110101
BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints that a bucket compares in one task.
SPLIT = 4096
#: Bands of bits that larger buckets are dealt out by, one after another.
BANDS = (3, 4, 6)
#: A chunk of shingles counted at once; bounds memory on very long texts.
CHUNK = 1 << 18


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        return h(joined, SEED)  # one shingle: its bits are the majority
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends, n = starts[: n - SHINGLE + 1], ends[SHINGLE - 1 :], n - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = [h(joined[s:e], SEED) for s, e in zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, with_hash: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row; with_hash: a hash of the text too."""
    from pyspark.sql.pandas.types import to_arrow_type

    text = exact(docs, "text").cast("string")
    more = [F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash")] * with_hash
    source = docs.select(exact(docs, "doc_id").alias("doc_id"), text.alias("text"), *more)
    kind = source.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            rest = [batch.column("hash")] if with_hash else []
            yield pa.record_batch([batch.column("doc_id").cast(id_type), pa.array(fps), *rest], ["doc_id", "fp", *["hash"] * with_hash])

    return source.mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint" + ", hash bigint" * with_hash)


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit, and the error pattern of each syndrome."""
    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    single = np.array([remainder(1 << i) for i in range(23)], np.int64)
    pattern = np.zeros(2048, np.int64)
    for i in range(23):
        pattern[single[i]] = 1 << i
        for j in range(i):
            pattern[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                pattern[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return single, pattern


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor that covers a word within one bit of a fingerprint."""
    single, pattern = golay()
    fps = fps.view(np.uint64)
    own, near = [], []
    for at, width in BLOCKS:
        x = (fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        syndrome = np.zeros(len(x), np.int64)
        for i in range(width):
            syndrome ^= np.where(x >> i & 1, single[i], 0)
        own.append((x ^ pattern[syndrome]) >> 11)
        flipped = x[:, None] ^ (np.int64(1) << np.arange(width))
        near.append((flipped ^ pattern[syndrome[:, None] ^ single[:width]]) >> 11)
    key = own[0] | own[1] << 12 | own[2] << 24
    rows, keys = [np.arange(len(fps))], [key]
    for k, n in enumerate(near):
        other = (key & ~(np.int64(4095) << 12 * k))[:, None] | n << 12 * k
        rows.append(np.repeat(np.arange(len(fps)), n.shape[1]))
        keys.append(other.ravel())
    both = np.unique(np.stack([np.concatenate(rows), np.concatenate(keys)]), axis=1)
    return both[0], both[1]


def _replicate(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for i in range(0, len(fps), 4096):
            part = fps[i : i + 4096]
            rows, keys = anchors(part)
            yield pa.record_batch([pa.array(keys), pa.array(part[rows])], ["anchor", "fp"])


def forest(fps: np.ndarray, threshold: int = THRESHOLD, pairwise: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one it is connected with) of those connected with another of these."""
    fps = np.unique(fps.view(np.uint64))
    n = len(fps)
    root = np.arange(n)
    if n <= pairwise:
        links = [np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= threshold) + i + 1 for i in range(n - 1)]
        left = np.repeat(np.arange(len(links)), [len(x) for x in links])
        found = [(left, np.concatenate(links) if links else left)]
    else:  # look up each word within the threshold instead
        bits = [np.uint64(1) << np.uint64(i) for i in range(64)]
        masks = [c for r in range(1, threshold + 1) for c in combinations(bits, r)]
        found = []
        for mask in masks:
            other = fps ^ np.bitwise_xor.reduce(mask)
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            hit = np.flatnonzero((fps[at] == other) & (at > np.arange(n)))
            if len(hit):
                found.append((hit, at[hit]))
    changed = True
    while changed:
        before = root.copy()
        for a, b in found:
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
        root = root[root]
        changed = (root != before).any()
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved].view(np.int64), fps[root[moved]].view(np.int64)


def _compare(split: int | None):
    """Rows (bucket columns..., fp) sorted by bucket: each bucket's forest, as (a, b, null...).

    A bucket over split is handed on unchanged instead, row by row (a = fp, b null, bucket
    columns kept), so a task never holds more.
    """

    def run(batches):
        now, held, size, over, names = None, [], 0, False, None

        def rows(key, a, b):
            columns = [pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())]
            columns.append(pa.array([key] * len(a), pa.int64()))
            return pa.record_batch(columns, ["a", "b", "bucket"])

        def done():
            if size > 1 and not over:
                a, b = forest(np.concatenate(held))
                if len(a):
                    yield rows(None, a, b)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(fps):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for s, e in zip([0, *cuts], [*cuts, len(fps)], strict=True):
                if keys[s] != now:
                    yield from done()
                    now, held, size, over = keys[s], [], 0, False
                held.append(fps[s:e].copy())
                size += e - s
                if split and (over or size > split):
                    over = True
                    yield rows(int(now), np.concatenate(held), None)
                    held = []
        yield from done()

    return run


def _banded(equal: int, bands: int):
    """(bucket, fp) of a bucket that is too large: again by its key and each choice of equal bands."""

    def run(batches):
        from xxhash import xxh64_intdigest as h

        cut = np.linspace(0, 64, bands + 1).astype(int)
        masks = [sum(((1 << int(cut[i + 1] - cut[i])) - 1) << int(cut[i]) for i in c) for c in combinations(range(bands), equal)]
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            old = batch.column("bucket").to_numpy(zero_copy_only=False).astype(np.int64)
            for n, mask in enumerate(masks):
                left = fps & np.uint64(mask)
                keys = [h(f"{n}:{a}:{b}") & (2**63 - 1) for a, b in zip(old.tolist(), left.tolist(), strict=True)]
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(fps.view(np.int64))], ["bucket", "fp"])

    return run


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b): edges among distinct fingerprints (column fp) that connect what is connected.

    Colliding keys of buckets only add fingerprints to a comparison, which is exact.
    """
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fingerprints are small, their copies many
    # By a hash, as a second deal by fp itself would be dropped and its partitions merged again.
    buckets = fps.repartition(tasks, F.xxhash64("fp")).mapInArrow(_replicate, "bucket bigint, fp bigint")
    out = None
    for bands in (*BANDS, None):
        sorted_rows = buckets.repartition("bucket").sortWithinPartitions("bucket", "fp")
        found = materialize(sorted_rows.mapInArrow(_compare(split if bands else None), "a bigint, b bigint, bucket bigint"), "links")
        part = found.where("bucket is null").select("a", "b")
        out = part if out is None else out.unionByName(part)
        rest = found.where("bucket is not null").select("bucket", F.col("a").alias("fp"))
        if bands is None or rest.isEmpty():
            return out
        buckets = rest.mapInArrow(_banded(bands - THRESHOLD, bands), "bucket bigint, fp bigint")
    return out


def _roots(each: DataFrame, split: int) -> DataFrame:
    """fp and root (a fingerprint that stands for the component) of distinct fingerprints."""
    nodes = each.select("fp").distinct()
    roots = connected(links(nodes, split)).select(F.col("node").alias("fp"), "root")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    each = materialize(fingerprints(docs), "fingerprints")
    nodes = each.groupBy("fp").agg(F.min("doc_id").alias("least")).join(_roots(each, split), "fp")
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "root").select("fp", "component_id")
    return each.join(nodes, "fp").select("doc_id", "fp", "component_id")


def keep(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (null last).

    Of rows that tie in doc_id, the one whose text has the smaller hash; of equal rows, one.
    """
    doc_id, text = exact(docs, "doc_id"), exact(docs, "text").cast("string")
    each = materialize(fingerprints(docs, with_hash=True), "fingerprints")
    first = each.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("k"))  # copies meet before the join
    kept = first.join(_roots(each, split), "fp").groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.hash").alias("kept_hash"))
    names = dict(zip(kept.columns, fresh(docs, *kept.columns), strict=True))
    kept = kept.withColumnsRenamed(names)
    same = doc_id.eqNullSafe(F.col(names["kept_id"])) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(names["kept_hash"]))
    rows = docs.join(kept, same, "left_semi")
    if each.groupBy("doc_id", "hash").count().where("count > 1").isEmpty():
        return rows
    (mark,) = fresh(docs, "simhash_of")
    marked = rows.withColumn(mark, F.struct(doc_id.alias("i"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")))
    return marked.dropDuplicates([mark]).drop(mark)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    done = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
