"""Packing documents into sequences of a fixed length by hierarchical best fit.

Documents are encoded where they stand: each part of a word that a Python worker meets for the
first time goes through the tokenizers library, later ones come from its bounded memory. The
end id is added. A longer document is cut into full pieces, its first one taking the rest.
From there only pieces move, a few integers each; ids are known by their checksum.

1. A piece of full length is a sequence.
2. The others are dealt evenly, each partition sorted by falling length, and packed one by one
   into the fullest bin that holds them. A partition keeps a count of open bins by room left,
   so a step takes constant time.
3. Bins with at most SLACK tokens of room are final. The rest become items, as long as they
   are full: FAN neighbouring partitions are merged and packed by best fit again, and so on up
   the tree, until one group is left or groups hold ITEMS bins each. Any two bins of a group
   hold more than one sequence together, so each group leaves at most one bin of under half.

A bin that is put into another keeps its place in it; places add up along the tree.

Defined cases: null text is empty (the end id alone, one piece); repeated doc_ids are pieces
of their own; an empty table gives an empty result; further columns are ignored; a text is
encoded whole, one at a time.
"""

from __future__ import annotations

import sys
from array import array
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import exact, materialize, small_batches
from .bpe import SLICE, _special, default_tokenizer, load_tokenizer, split_words

LENGTH, END = 2048, 0
#: Room at which a bin counts as full; groups merged at a time; most items of a group.
SLACK, FAN, ITEMS = 16, 8, 250_000
#: Small tables are dealt over groups of so many pieces, up to SPREAD groups.
LEAST, SPREAD = 8192, 64
#: Words a Python worker remembers with their ids.
MEMO = 400_000
_ID_BITS = 36


class _Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, from the library when it is new."""

    def __init__(self, tok):
        self.tok = tok

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = array("I", self.tok.encode(word, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        out = self[word] = ids.tobytes()
        return out


#: Memories by tokenizer file; tasks of one Python worker share them.
_KNOWN: dict[str, _Words] = {}


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document of n ids: all full but the first."""
    first = n % length or length
    edges = [0, *range(min(first, n), n + 1, length)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _encode(path: str, length: int, end: int, kind: pa.DataType):
    def run(batches):
        tok = load_tokenizer(path)
        special, words, stop = _special(tok), _KNOWN.setdefault(path, _Words(tok)), end.to_bytes(4, "little")
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            rows, which = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = b"".join(map(words.__getitem__, split_words(text, special))) + stop if text else stop
                view = memoryview(ids)
                for piece, (a, b) in enumerate(cut(len(ids) // 4, length)):
                    rows.append((piece, a, b - a, crc32(view[4 * a : 4 * b])))
                    which.append(k)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            columns[0] = columns[0].cast(pa.int32())
            yield pa.record_batch([batch.column(0).cast(kind).take(pa.array(which, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(exact(docs, "doc_id").alias("doc_id"), exact(docs, "text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType
    run = _encode(tokenizer_path or default_tokenizer(), length, end, to_arrow_type(kind))
    cut_up = source.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")
    with small_batches(docs.sparkSession):
        return materialize(cut_up, "pack-pieces")


class BestFit:
    """Bins of one group; the fullest bin that holds an item takes it."""

    def __init__(self, length: int):
        self.length = length
        self.open: list[list[int]] = [[] for _ in range(length + 1)]  # bins by room left
        self.rooms = 0  # bit r: there is a bin with room r

    def put(self, item: int, size: int) -> tuple[int, int]:
        """(bin, place in it) of an item; a bin is named after its first item."""
        fits = self.rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bins = self.open[room]
            taken = bins.pop()
            if not bins:
                self.rooms ^= 1 << room
        else:
            room, taken = self.length, item
        left = room - size
        if left:
            self.open[left].append(taken)
            self.rooms |= 1 << left
        return taken, self.length - room


def _pack(length: int, columns: list[str], schema: pa.Schema):
    """Rows sorted by group and falling length, each with its bin and place; bins don't cross groups.

    Rows are numbered within their partition if they have no column item.
    """

    def run(batches):
        from pyspark import TaskContext

        group, fit, next_id = None, None, TaskContext.get().partitionId() << _ID_BITS
        for batch in batches:
            bins, places = [], []
            ids = batch.column("item").to_pylist() if "item" in columns else range(next_id, next_id + batch.num_rows)
            next_id += batch.num_rows
            groups = batch.column("grp").to_pylist() if "grp" in columns else [0] * batch.num_rows
            for g, item, size in zip(groups, ids, batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, fit = g, BestFit(length)
                found, at = fit.put(item, size)
                bins.append(found)
                places.append(at)
            values = [batch.column(c) for c in columns] + [pa.array(bins, pa.int64()), pa.array(places, pa.int64())]
            yield pa.record_batch([v.cast(f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    return run


def _packed(rows: DataFrame, length: int, name: str) -> DataFrame:
    """rows (dealt and sorted) with bin and place, written."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + ["bin bigint, place bigint"]))
    return materialize(rows.mapInArrow(_pack(length, rows.columns, to_arrow_schema(schema)), schema), name)


def _bins(packed: DataFrame, first_group) -> DataFrame:
    """item, length and grp of the bins of a packed table."""
    return packed.groupBy("bin").agg(F.sum("length").alias("length")).select(F.col("bin").alias("item"), "length", first_group.alias("grp"))


def pack(items: DataFrame, length: int = LENGTH, slack: int = SLACK, most: int = ITEMS, least: int = LEAST) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces, each of at most the given length."""
    full = items.where(F.col("length") == length).select("*", (F.monotonically_increasing_id() + (1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = items.where(F.col("length") < length)
    n = rest.count()
    groups = max(1, -(-n // most), min(SPREAD, -(-n // least)))
    ties = [c for c in rest.columns if c != "length"]
    packed = _packed(rest.repartition(groups).sortWithinPartitions(F.desc("length"), *ties), length, "pack-bins")
    part = F.shiftright("bin", _ID_BITS)
    under = materialize(_bins(packed, part).where(F.col("length") < length - slack), "pack-underfull")
    moves: list[DataFrame] = []
    while groups > 1:
        bins = under.count()
        merged = max(-(-groups // FAN), -(-bins // most))
        if merged >= groups or bins < 2:
            break
        fan, groups = -(-groups // merged), merged
        dealt = under.withColumn("grp", F.expr(f"grp div {fan}")).repartition(groups, "grp")
        again = _packed(dealt.sortWithinPartitions("grp", F.desc("length"), "item"), length, "pack-round")
        moved = again.where("place > 0").select("item", "bin", "place")
        moves.append(moved)
        under = materialize(again.groupBy("bin").agg(F.sum("length").alias("length"), F.first("grp").alias("grp")).where(F.col("length") < length - slack).select(F.col("bin").alias("item"), "length", "grp"), "pack-underfull")
    whole = None  # item -> the bin that holds it at last and its place there
    for step in reversed(moves):
        if whole is not None:
            later = whole.select(F.col("item").alias("bin"), F.col("bin").alias("top"), F.col("place").alias("more"))
            step = step.join(later, "bin", "left").select("item", F.coalesce("top", "bin").alias("bin"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
            step = step.unionByName(whole)
        whole = materialize(step, "pack-moves")
    if whole is not None:
        later = whole.select(F.col("item").alias("bin"), F.col("bin").alias("top"), F.col("place").alias("more"))
        packed = packed.join(later, "bin", "left").withColumns({"bin": F.coalesce("top", "bin"), "place": F.col("place") + F.coalesce("more", F.lit(0))})
    placed = packed.select(*items.columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return placed.unionByName(full)


def op13_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
