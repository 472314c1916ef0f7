"""Merkle manifest of a dataset: a tree of three per source, a tree over sources, a proof a row.

A row's leaf is a hash of its fields, made where the row stands; only hashes move from there.
Leaves are sorted by source and doc_id over ranges, numbered by prefix sums over the ranges,
and cut into aligned blocks of 3**HEIGHT, which are whole subtrees: a source may hold any
share of the rows. Roots of blocks are the leaves of the next storey, until a source has one
node, its subroot; subroots make one more tree in the same way.

Proofs come back down storey by storey. Within a block they are made by traversal: each level
keeps the run of nodes that holds the current leaf's ancestor, and a treehash stack that
builds the next run meanwhile. As many leaves as there are levels go to the stacks at each
step, always to the stack whose last node is lowest, so few nodes are held at a time. The path
above a block is the same for all its leaves: it comes as the block's first row, and is
appended to each.

Defined cases: a null field is "-" in its leaf; a null source is a source, before all others;
null doc_ids come first, and are never tampered with; rows that repeat source and doc_id are
ordered by leaf; an empty table gives an empty result; further columns are ignored; a text is
hashed whole, one at a time.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import broadcast_small, exact, materialize

#: Nodes that make one of the next level; levels of a block.
ARITY, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """Builds the nodes of one level over leaves at..end-1, holding fewer than ARITY a level below."""

    def __init__(self, level: int, at: int, end: int):
        self.level, self.at, self.end = level, at, end
        self.held: list[list[str]] = [[] for _ in range(level + 1)]

    def lowest(self) -> int:
        """Level of the lowest node held; its own level before it begins."""
        return next((h for h, nodes in enumerate(self.held) if nodes), self.level)

    def step(self, leaves: list[str]) -> None:
        node, h = leaves[self.at], 0
        self.at += 1
        self.held[0].append(node)
        while h < self.level and len(self.held[h]) == ARITY:
            node, self.held[h] = digest(self.held[h]), []
            h += 1
            self.held[h].append(node)
        if self.at == self.end:  # the last run of a level may be shorter
            for h in range(self.level):
                if self.held[h]:
                    self.held[h + 1].append(digest(self.held[h]))
                    self.held[h] = []

    def complete(self, leaves: list[str]) -> list[str]:
        while self.at < self.end:
            self.step(leaves)
        return self.held[self.level]


def paths(leaves: list[str], height: int):
    """For each leaf, its siblings level by level: a list of (those left of it, those right of it).

    The list is the same object each time, changed in place.
    """
    n, spans = len(leaves), [ARITY ** (h + 1) for h in range(height)]
    runs = [Treehash(h, 0, min(s, n)).complete(leaves) for h, s in enumerate(spans)]
    coming = [Treehash(h, s, min(2 * s, n)) for h, s in enumerate(spans)]
    path: list[tuple[str, str]] = [("", "")] * height
    for i in range(n):
        for h, span in enumerate(spans):
            if i and i % span == 0:
                runs[h] = coming[h].complete(leaves)
                coming[h] = Treehash(h, i + span, min(i + 2 * span, n))
            if i % (span // ARITY):
                break
            j = i * ARITY // span % ARITY
            path[h] = "".join(runs[h][:j]), "".join(runs[h][j + 1 :])
        yield path
        for _ in range(height):
            open_ = [t for t in coming if t.at < t.end]
            if not open_:
                break
            min(open_, key=lambda t: (t.lowest(), t.level)).step(leaves)


def fold(node: str, path) -> str:
    for left, right in path:
        node = digest([left, node, right])
    return node


def _height(n: int, block_height: int) -> int:
    """Levels of a block in a group of n nodes: all if there are several blocks, else as many as it takes."""
    h = 0
    while h < block_height and ARITY**h < n:
        h += 1
    return h


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf and, where tampering changes the text, the tampered leaf (bad); both binary."""
    doc_id, source, lang, n_chars, text = (exact(docs, c) for c in FIELDS)
    text = text.cast("string")

    def leaf(text):
        return F.unhex(F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256))

    hit = (F.crc32(doc_id.cast("string")) % 2 == 0) & text.contains("\n")
    return docs.select(source.cast("string").alias("source"), doc_id.alias("doc_id"), leaf(text).alias("leaf"), F.when(hit, leaf(F.replace(text, F.lit("\n"), F.lit("")))).alias("bad"))


def _number(kind: pa.DataType):
    """Adds to sorted rows the number of their partition and their place in it among rows of the same source."""

    def run(batches):
        from pyspark import TaskContext

        shard, source, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for s in batch.column("source").to_pylist():
                if s != source:
                    source, place = s, 0
                places.append(place)
                place += 1
            columns = [batch.column(c) for c in ("source", "doc_id", "leaf", "bad")]
            columns[1] = columns[1].cast(kind)
            yield pa.record_batch([*columns, pa.array([shard] * len(places), pa.int64()), pa.array(places, pa.int64())], ["source", "doc_id", "leaf", "bad", "shard", "place"])

    return run


def place(rows: DataFrame) -> DataFrame:
    """g, i, n, doc_id, node and bad of every leaf: its source's number in order, its own in it, the leaves there."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["doc_id"].dataType
    rows = materialize(rows, "merkle-leaves")
    keys = ["source", "doc_id", "leaf"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = f"source string, doc_id {kind.simpleString()}, leaf binary, bad binary, shard bigint, place bigint"
    ordered = materialize(ordered.mapInArrow(_number(to_arrow_type(kind)), schema), "merkle-order")
    # Sources in order, numbered by ranges as the rows are.
    counts = materialize(ordered.groupBy("source", "shard").agg(F.count("*").alias("rows")), "merkle-counts")
    totals = counts.groupBy("source").agg(F.sum("rows").alias("n")).repartitionByRange("source").sortWithinPartitions("source")
    totals = materialize(totals.select("source", "n", F.monotonically_increasing_id().alias("number")), "merkle-sources")
    part = F.shiftright("number", 33)
    earlier = totals.groupBy(part.alias("part")).agg(F.count("*").alias("sources"))
    earlier = earlier.select("part", F.coalesce(F.sum("sources").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    totals = totals.withColumn("part", part).join(earlier, "part").select(F.col("source").alias("s"), "n", (F.col("before") + F.col("number").bitwiseAND((1 << 33) - 1)).alias("g"))
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("source", "shard", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("base"))
    bases = bases.join(totals, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("shard").alias("at"), "base", "n", "g")
    bases = broadcast_small(materialize(bases, "merkle-bases"))
    placed = ordered.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("at")))
    return placed.select("g", (F.col("base") + F.col("place")).alias("i"), "n", "doc_id", F.col("leaf").alias("node"), "bad")


def _by_block(nodes: DataFrame, size: int, *more: str) -> DataFrame:
    return nodes.select("g", F.expr(f"i div {size}").alias("block"), "i", "n", "node", *more)


def _groups(batches, columns: list[str]):
    """(g, block), its rows, of sorted batches; a block's rows are at most the block's size and its header."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[:2] != now:
                if rows:
                    yield now, rows
                now, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield now, rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def climb(nodes: DataFrame, block_height: int = HEIGHT) -> list[DataFrame]:
    """[roots of the blocks of nodes, roots of the blocks of those, ...]: g, i, n, node; a group ends where its n is 1."""
    from pyspark.sql.pandas.types import to_arrow_schema

    size, schema = ARITY**block_height, "g bigint, i bigint, n bigint, node binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        found = []
        for (g, block), rows in _groups(batches, ["g", "block", "n", "node"]):
            tree = Treehash(_height(rows[0][0], block_height), 0, len(rows))
            (root,) = tree.complete([node.hex() for _, node in rows])
            found.append((g, block, -(-rows[0][0] // size), bytes.fromhex(root)))
            if len(found) >= 4096:
                yield _batch(found, arrow)
                found = []
        if found:
            yield _batch(found, arrow)

    out, below = [], nodes
    while True:
        blocks = _by_block(below, size).repartition("g", "block").sortWithinPartitions("g", "block", "i")
        out.append(materialize(blocks.mapInArrow(run, schema), "merkle-storey"))
        below = out[-1].where("n > 1")
        if below.isEmpty():
            return out


def _traverse(nodes: DataFrame, headers: DataFrame, block_height: int, out: str, finish, *more: str) -> DataFrame:
    """finish(row, path, header) -> values of out, for every node; headers: g, block, up, subroot."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = _by_block(nodes, ARITY**block_height, *more)
    stream = rows.unionByName(headers.withColumn("i", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    columns = ["g", "block", "i", "n", "node", "up", "subroot", *more]
    stream = stream.select(columns).repartition("g", "block").sortWithinPartitions("g", "block", "i")
    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        found = []
        for (g, _), (head, *rows) in _groups(batches, columns):
            up = list(zip(head[3][::2], head[3][1::2], strict=True))
            header = up, "".join(head[3]), head[4], {}
            nodes = [r[2].hex() for r in rows]
            for row, node, path in zip(rows, nodes, paths(nodes, _height(rows[0][1], block_height)), strict=True):
                found.append(finish(g, row, node, path, header))
                if len(found) >= 4096:
                    yield _batch(found, arrow)
                    found = []
        if found:
            yield _batch(found, arrow)

    return stream.mapInArrow(run, out)


def _up(g, row, node, path, header):
    """Path of a node up to the root of all, flat: left, right, left, right, ..."""
    return g, row[0], [side for pair in path for side in pair] + [side for pair in header[0] for side in pair], header[2]


def descend(storeys: list[DataFrame], crown: DataFrame, block_height: int = HEIGHT) -> DataFrame:
    """g, block, up, subroot of every block below the first storey; crown: g, up, subroot of every group."""
    headers = None
    for storey in reversed(storeys):
        whole = storey.where("n = 1").select("g", F.lit(0).cast("bigint").alias("block")).join(crown, "g")
        if headers is not None:
            split = _traverse(storey.where("n > 1"), headers, block_height, "g bigint, block bigint, up array<string>, subroot string", _up)
            whole = whole.unionByName(split)
        headers = materialize(whole, "merkle-headers")
    return headers


def _proof(g, row, node, path, header):
    up, up_text, subroot, folded = header
    proof = sha256(("".join(left + right for left, right in path) + up_text).encode()).hexdigest()
    top = fold(row[6].hex() if row[6] is not None else node, path)
    if top not in folded:  # one entry a block, and one a tampered leaf
        folded[top] = fold(top, up)
    return row[5], node, subroot, proof, folded[top]


def manifest(docs: DataFrame, block_height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    spark, kind = docs.sparkSession, docs.select(exact(docs, "doc_id").alias("doc_id")).schema["doc_id"].dataType
    placed = place(leaves(docs))
    storeys = climb(placed.select("g", "i", "n", "node"), block_height)
    subroots = storeys[0].where("n = 1")
    for storey in storeys[1:]:
        subroots = subroots.unionByName(storey.where("n = 1"))
    sources = subroots.count()
    top = subroots.select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("i"), F.lit(sources).cast("bigint").alias("n"), "node")
    top_storeys = climb(top, block_height)
    last = top_storeys[-1].where("n = 1").first()
    root = last.node.hex() if last else None
    whole = spark.createDataFrame([(0, [], root)], "g bigint, up array<string>, subroot string")
    of_sources = _traverse(top, descend(top_storeys, whole, block_height), block_height, "g bigint, i bigint, up array<string>, subroot string", _up)
    crown = of_sources.select(F.col("i").alias("g"), "up").join(subroots.select("g", F.lower(F.hex("node")).alias("subroot")), "g")
    headers = descend(storeys, materialize(crown, "merkle-crown"), block_height)
    out = f"doc_id {kind.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string"
    done = _traverse(placed, headers, block_height, out, _proof, "doc_id", "bad")
    root = F.lit(root).cast("string")
    return done.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Trees grow by recursion, a level at a time; every leaf is folded with the other nodes of its runs.
ORACLE = r"""
WITH RECURSIVE crcs AS (
  -- Bytes of the id and, after each, eight shifts (-1); the checksum's last complement turns its lowest bit.
  SELECT *, list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) % 2 = 1 AS hit
  FROM documents
), fields AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS bad_text
  FROM crcs
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(bad_text) || ':' || bad_text, '-')) AS bad,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g
  FROM fields
), tree AS (
  SELECT g, 0 AS h, i, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT g, h + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, h, i // 3
), subroots AS (SELECT g, h AS height, node FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS h, g AS i, node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT h + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM crown WHERE n > 1 GROUP BY h, i // 3
), runs AS (
  -- Each node with the others of its run, of source trees and, above their heights, of the crown.
  SELECT a.g, a.h, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS lefts,
    coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS rights
  FROM tree a JOIN tree b ON a.g = b.g AND a.h = b.h AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL
), crown_runs AS (
  SELECT a.h, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS lefts,
    coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS rights
  FROM crown a JOIN crown b ON a.h = b.h AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL
), steps AS (
  SELECT g, h, i, lefts, rights FROM runs
  UNION ALL
  SELECT s.g, s.height + c.h, c.i, c.lefts, c.rights FROM subroots s JOIN crown_runs c ON c.i = s.g // (3 ** c.h)::BIGINT
), folded AS (
  SELECT l.doc_id, l.g, l.leaf, s.height, 0 AS h, l.i, l.bad AS node, '' AS proof FROM leaves l JOIN subroots s USING (g)
  UNION ALL
  SELECT f.doc_id, f.g, f.leaf, f.height, f.h + 1, CASE WHEN f.h + 1 = f.height THEN f.g ELSE s.i // 3 END,
    sha256(s.lefts || f.node || s.rights), f.proof || s.lefts || s.rights
  FROM (SELECT * REPLACE (CASE WHEN h = height THEN g ELSE i END AS i) FROM folded) f JOIN steps s ON f.g = s.g AND f.h = s.h AND f.i = s.i
)
SELECT f.doc_id, f.leaf, s.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM folded f JOIN subroots s USING (g), (SELECT node, h FROM crown WHERE n = 1) r WHERE f.h = f.height + r.h
"""
