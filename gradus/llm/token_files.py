"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by doc_id and sorted; each partition encodes its documents
in order and writes one shard in the shared folder: `ids-*.bin`, the little-endian unsigned
integers of all its documents one after another (16 bits wide if the vocabulary allows, else
32), and `offsets-*.bin`, the little-endian unsigned 64-bit place of each document's first
id and of the end. A shard is written under a name of its own attempt and counts only once
its task has succeeded, so lost executors leave no half shard in the manifest. The manifest
(one row a shard: path, rows, ids and, by prefix sums, the ids before it) is small.

The format is read back by memory mapping where the store is a mounted folder, else by
ranges of the file.

The tokenizers library's model encodes a part of a word when a Python worker first meets it
(its memory is bounded); parts are what the tokenizer's own splitter makes. Texts with
characters for which that isn't certain go to the library whole.

Defined cases: null text is empty (the end id alone); repeated doc_ids are ordered by text;
null doc_ids come first; an empty table gives no shards and an empty result; further columns
are ignored. Texts are encoded whole, one document in memory at a time.
"""

from __future__ import annotations

import re
import sys
import uuid
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import exact, materialize, open_fs, shared_dir, small_batches
from .bpe import load_tokenizer

END = 1
#: Parts of words a Python worker remembers with their ids; rows it turns into Python objects
#: at a time.
MEMO, SLICE = 400_000, 256

_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž"
_MARKS = r"\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7‐-‧‰-⁞€"
#: Texts of these characters only are in normal form C, in lower case letter by letter, and
#: have ASCII white space only.
_PLAIN = re.compile(rf"[\t-\r \x21-\x7e{_LATIN}{_MARKS}]*+\Z")
_WORDS = re.compile(rf"[{_LATIN}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t-\r {_LATIN}0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte -> character of the byte-level alphabet.
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class _Memo(dict):
    """Part of a word -> bytes of its ids, from the library's model when it is new."""

    def __init__(self, tok, dtype: str):
        self.tokenize, self.code = tok.model.tokenize, "H" if dtype == "<u2" else "I"

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = self[part] = self.packed([t.id for t in self.tokenize(part.encode().decode("latin-1").translate(_BYTES))])
        return out


#: Memories by tokenizer file and width; tasks of one Python worker share them.
_KNOWN: dict[tuple[str, str], _Memo] = {}


def encoder(path: str, dtype: str):
    """text -> bytes of its ids, as the library encodes it without special tokens."""
    tok = load_tokenizer(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    memo = _KNOWN.setdefault((path, dtype), _Memo(tok, dtype))

    def encode(text: str) -> bytes:
        if not _PLAIN.match(text) or any(s in text for s in special):
            return memo.packed(tok.encode(text, add_special_tokens=False).ids)
        return b"".join(map(memo.__getitem__, _WORDS.findall(text.lower())))

    return encode


def _width(path: str) -> str:
    return "<u2" if load_tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _write(path: str, folder: str, dtype: str, end: int, id_type: pa.DataType):
    """Rows (doc_id, shard, name, place, n): a row a document, and at place -1 the shard's ids."""

    def run(batches):
        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, root = open_fs(folder)
        encode, stop, size = encoder(path, dtype), np.array([end], dtype).tobytes(), np.dtype(dtype).itemsize
        ids = offsets = None
        total = place = 0

        def rows(doc_ids, places, n):
            k = len(places)
            columns = [doc_ids, pa.array([shard] * k, pa.int64()), pa.array([name] * k), pa.array(places, pa.int64()), pa.array([n] * k, pa.int64())]
            return pa.record_batch(columns, ["doc_id", "shard", "name", "place", "n"])

        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            if ids is None:
                ids = files.open_output_stream(f"{root}/ids-{name}.bin", buffer_size=1 << 20)
                offsets = files.open_output_stream(f"{root}/offsets-{name}.bin", buffer_size=1 << 20)
            starts = []
            for text in batch.column(1).to_pylist():
                piece = encode(text or "") + stop
                ids.write(piece)
                starts.append(total)
                total += len(piece) // size
            offsets.write(np.array(starts, "<u8").tobytes())
            yield rows(batch.column(0).cast(id_type), list(range(place, place + len(starts))), None)
            place += len(starts)
        if ids is not None:
            offsets.write(np.array([total], "<u8").tobytes())
            ids.close()
            offsets.close()
            yield rows(pa.nulls(1, id_type), [-1], total)

    return run


def write(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, end: int = END) -> tuple[str, DataFrame, DataFrame]:
    """(folder, manifest, index): writes the shards in ascending doc_id order.

    manifest: shard, name, n_ids, base (ids before the shard). index: doc_id, shard, place.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    folder, path = folder or shared_dir(spark, "token-files"), tokenizer_path or default_tokenizer()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(root)
    source = docs.select(exact(docs, "doc_id").alias("doc_id"), exact(docs, "text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType
    keyed = source.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    run = _write(path, folder, _width(path), end, to_arrow_type(kind))
    written = ordered.mapInArrow(run, f"doc_id {kind.simpleString()}, shard bigint, name string, place bigint, n bigint")
    with small_batches(spark):
        rows = materialize(written, "token-index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.where("place = -1").select("shard", "name", F.col("n").alias("n_ids"))
    manifest = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return folder, manifest, rows.where("place >= 0").select("doc_id", "shard", "place")


def open_shard(folder: str, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a shard, memory-mapped where the folder is a mounted one."""
    from pyarrow import fs

    files, root = open_fs(folder)
    out = []
    for kind, of in (("ids", dtype), ("offsets", "<u8")):
        at = f"{root}/{kind}-{name}.bin"
        if isinstance(files, fs.LocalFileSystem):
            out.append(np.memmap(at, of, "r"))
        else:
            with files.open_input_file(at) as f:
                out.append(np.frombuffer(f.read(), of))
    return out[0], out[1]


def read(folder: str, manifest: DataFrame, dtype: str) -> DataFrame:
    """shard, place, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets = open_shard(folder, row["name"], dtype)
                for i in range(0, len(offsets) - 1, 8192):
                    cut = offsets[i : i + 8193].astype(np.int64)
                    crc = [crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    n = len(crc)
                    columns = [[row["shard"]] * n, range(i, i + n), cut[:-1] + row["base"], cut[1:] - cut[:-1], crc]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["shard", "place", "start", "n_tokens", "ids_crc32"])

    schema = "shard bigint, place bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    shards = max(1, manifest.count())  # as many as there were partitions
    return manifest.repartition(shards, "shard").mapInArrow(run, schema)


def roundtrip(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, written and read back."""
    folder, manifest, index = write(docs, folder, tokenizer_path, end)
    back = read(folder, manifest, _width(tokenizer_path or default_tokenizer()))
    # Without the hint, back would count as small as the manifest it comes of.
    return index.join(back.hint("merge"), ["shard", "place"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    return roundtrip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
