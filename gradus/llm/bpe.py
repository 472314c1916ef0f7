"""BPE encoding and decoding by a distinct-word table.

1. Texts are split into words where they stand; each block of input (a stretch of one
   partition) emits its distinct words: (word, block).
2. Brought together and sorted by word over the whole corpus, the pairs of a word follow one
   another, and each distinct word is encoded exactly once by the tokenizers library. The ids
   go back to the blocks that hold the word: sorted by block, dictionaries lie one after
   another in a file a task in the shared folder, with an index of where each block's begin.
   The texts themselves never move. Pairs stream through: a word may be in any number of
   blocks, and none is gathered.
3. Each block joins ids back by position against its dictionary, and decodes its ids
   through the id-to-piece table, which is bounded by the vocabulary.

A word here is a stretch that the pre-tokenizer never joins with its neighbours: white
space is cut exactly as the pre-tokenizer cuts it, and a run of Latin letters followed by
an ASCII character or the end stands alone. Anything else stays whole up to white space,
and the library splits it further.

Defined cases: null text is the empty text (0 ids); repeated rows give repeated results;
an empty table gives an empty result; further columns of the input are ignored; the
special token's own string in a text is one id, as in the library. If a partition's rows
come in another order on the second reading, words missing from the block's dictionary are
encoded on the spot, so results never depend on it.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import exact, materialize, open_fs, remove, shared_dir, small_batches

_WS = r"\t-\r \x85\xa0  -     　"
_LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: A letter run that ends before ASCII or the text's end; else all up to white space; white
#: space but its last character if a word follows; white space.
WORDS = re.compile(
    rf" ?[{_LATIN}]++(?![^\x00-\x7f])| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
#: A partition's texts are cut into blocks of about so many characters: bounds a dictionary.
BLOCK_CHARS = 64_000_000
#: Distinct words a task holds before it hands them on (some may then come twice).
HELD_WORDS = 1_000_000
#: Blocks of a partition are numbered in so many bits; bytes of a stretch of a dictionary.
BLOCK_BITS, STRETCH = 24, 8_000_000
#: Rows of an Arrow batch, and of those that a task turns into Python objects at a time.
ROWS, SLICE = 2000, 128


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(4)
def load_tokenizer(path: str):
    """The tokenizer of a file, which tasks of one Python worker share."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _special(tok) -> re.Pattern | None:
    """Strings of added tokens, which the library looks for before it splits words."""
    added = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, added))) if added else None


def split_words(text: str, special: re.Pattern | None) -> list[str]:
    if special is None or not special.search(text):
        return WORDS.findall(text)
    out, at = [], 0
    for m in special.finditer(text):
        out += WORDS.findall(text[at : m.start()])
        out.append(m.group())
        at = m.end()
    return out + WORDS.findall(text[at:])


@lru_cache(4)
def pieces(path: str) -> dict[str, bytes]:
    """Decimal id -> bytes, undoing the byte-level alphabet; ids of added tokens give their text."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    out = {}
    for piece, i in load_tokenizer(path).get_vocab(with_added_tokens=True).items():
        known = all(c in back for c in piece)
        out[str(i)] = bytes(back[c] for c in piece) if known else piece.encode()
    return out


def _encode_words(tok, words: list[str]) -> list[str]:
    """Comma-joined decimal ids of each word."""
    return [",".join(map(str, e.ids)) for e in tok.encode_batch_fast(words, add_special_tokens=False)]


def _blocks(batches, block_chars: int):
    """(block, rows) of a partition in its order; a block ends at the row that fills it."""
    from pyspark import TaskContext

    block, filled = TaskContext.get().partitionId() << BLOCK_BITS, 0
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        rows = []
        for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            rows.append(values)
            filled += len(values[-1] or "")
            if filled >= block_chars:
                yield block, rows
                block, filled, rows = block + 1, 0, []
        if rows:
            yield block, rows


def _emit_words(path: str, block_chars: int, held: int):
    def run(batches):
        special = _special(load_tokenizer(path))

        def out(block, words):
            found = list(words)
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield pa.record_batch([pa.array(part, pa.string()), pa.array([block] * len(part), pa.int64())], ["word", "block"])

        now, words = None, set()
        for block, rows in _blocks(batches, block_chars):
            if now is not None and (block != now or len(words) >= held):
                yield from out(now, words)
                words = set()
            now = block
            for (text,) in rows:
                if text:
                    words.update(split_words(text, special))
        if words:
            yield from out(now, words)

    return run


def _encode_table(path: str):
    """Rows (word, block) sorted by word, with the word's ids: each word is encoded where its rows begin."""

    def run(batches):
        tok = load_tokenizer(path)
        last, last_ids = None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column("word").dictionary_encode()
            words = runs.dictionary.to_pylist()
            begun = words[0] == last
            ids = [last_ids] * begun + _encode_words(tok, words[begun:])
            last, last_ids = words[-1], ids[-1]
            yield pa.record_batch([batch.column("word"), pa.array(ids, pa.string()).take(runs.indices), batch.column("block")], ["word", "ids", "block"])

    return run


def _write_dictionaries(uri: str):
    """Rows (word, ids, block) sorted by block to one file a task; rows (block, file, at, size): where each block's stretches lie.

    A file is named by its attempt and counts only through these rows, which a task that fails doesn't leave.
    """

    def run(batches):
        files, root = open_fs(uri)
        name, out, at = uuid.uuid4().hex, None, 0

        def write(block, parts):
            nonlocal out, at
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/words-{name}.bin", buffer_size=1 << 20)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(pa.Table.from_batches(parts).combine_chunks())
            piece = sink.getvalue()
            out.write(piece)
            at += piece.size
            columns = zip([block, name, at - piece.size, piece.size], (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)
            return pa.record_batch([pa.array([v], t) for v, t in columns], ["block", "file", "at", "size"])

        now, parts, held = None, [], 0
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a).select(["word", "ids"])
                if parts and (blocks[a] != now or held >= STRETCH):
                    yield write(now, parts)
                    parts, held = [], 0
                now, held = int(blocks[a]), held + part.nbytes
                parts.append(part)
        if parts:
            yield write(now, parts)
        if out is not None:
            out.close()

    return run


class _Dictionaries:
    """Dictionaries of a task's blocks, read by the index of the task's own blocks."""

    def __init__(self, uri: str, index: str, partition: int):
        import pyarrow.dataset as ds

        self.files, self.root = open_fs(uri)
        files, at = open_fs(index)
        own = (ds.field("block") >= partition << BLOCK_BITS) & (ds.field("block") < (partition + 1) << BLOCK_BITS)
        self.places: dict[int, list[tuple[str, int, int]]] = {}
        for row in ds.dataset(at, filesystem=files, format="parquet").to_table(filter=own).to_pylist():
            self.places.setdefault(row["block"], []).append((row["file"], row["at"], row["size"]))

    def read(self, block: int) -> dict[str, str]:
        words: dict[str, str] = {}
        for name, at, size in self.places.get(block, ()):
            with self.files.open_input_file(f"{self.root}/words-{name}.bin") as f:
                f.seek(at)
                for batch in pa.ipc.open_stream(f.read(size)):
                    words.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        return words


def _apply(path: str, uri: str, index: str, block_chars: int, decode: bool, id_type: pa.DataType):
    def run(batches):
        from pyspark import TaskContext

        tok, known = load_tokenizer(path), _Dictionaries(uri, index, TaskContext.get().partitionId())
        special, piece = _special(tok), pieces(path) if decode else {}
        now, table = None, {}
        for block, rows in _blocks(batches, block_chars):
            if block != now:
                now, table = block, {}  # the last one is let go first
                table = known.read(block)
            keys, counts, encoded, decoded = [], [], [], []
            for key, text in rows:
                words = split_words(text, special) if text else []
                try:
                    ids = ",".join(map(table.__getitem__, words))
                except KeyError:
                    new = list({w for w in words if w not in table})
                    table.update(zip(new, _encode_words(tok, new), strict=True))
                    ids = ",".join(map(table.__getitem__, words))
                keys.append(key)
                encoded.append(ids)
                counts.append(ids.count(",") + 1 if ids else 0)
                if decode:
                    decoded.append(b"".join(map(piece.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else "")
            columns = [pa.array(keys, id_type), pa.array(counts, pa.int64()), pa.array(encoded, pa.string())]
            yield pa.record_batch(columns + ([pa.array(decoded, pa.string())] if decode else []), ["doc_id", "n_tokens", "ids", *["decoded"] * decode])

    return run


def encode(docs: DataFrame, tokenizer_path: str | None = None, decode: bool = True, block_chars: int = BLOCK_CHARS, held_words: int = HELD_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, comma-joined) and, with decode, the decoded text.

    The blocks' dictionaries stay in the shared folder, as the result reads them when it is computed.
    """
    return _encode(docs, tokenizer_path, decode, block_chars, held_words)[0]


def _encode(docs: DataFrame, tokenizer_path: str | None, decode: bool, block_chars: int = BLOCK_CHARS, held_words: int = HELD_WORDS) -> tuple[DataFrame, list[str]]:
    """(what encode gives, the folders of the dictionaries and of their index)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, path = docs.sparkSession, tokenizer_path or default_tokenizer()
    source = docs.select(exact(docs, "doc_id").alias("doc_id"), exact(docs, "text").cast("string").alias("text"))
    uri = shared_dir(spark, "bpe-words")
    words = source.select("text").mapInArrow(_emit_words(path, block_chars, held_words), "word string, block bigint")
    pairs = words.repartition("word").sortWithinPartitions("word")
    table = pairs.mapInArrow(_encode_table(path), "word string, ids string, block bigint")
    grouped = table.repartition("block").sortWithinPartitions("block")
    with small_batches(spark, ROWS):
        index = materialize(grouped.mapInArrow(_write_dictionaries(uri), "block bigint, file string, at bigint, size bigint"), "bpe-index")
    id_field = source.schema["doc_id"]
    schema = f"doc_id {id_field.dataType.simpleString()}, n_tokens bigint, ids string" + ", decoded string" * decode
    return source.mapInArrow(_apply(path, uri, index.written_to, block_chars, decode, to_arrow_type(id_field.dataType)), schema), [uri, index.written_to]


def decode_ids(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids): the id-to-piece join alone, for stored ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    path, id_field = tokenizer_path or default_tokenizer(), encoded.schema["doc_id"]
    id_type = to_arrow_type(id_field.dataType)

    def run(batches):
        piece = pieces(path)
        for batch in batches:
            texts = [b"".join(map(piece.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else "" for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id").cast(id_type), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_field.dataType.simpleString()}, text string")


def digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Per document: n_tokens and the SHA-256 of its joined ids and of its decoded text; no dictionary stays."""
    done, folders = _encode(docs, tokenizer_path, True)
    out = done.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
    with small_batches(docs.sparkSession, ROWS):
        out = materialize(out, "bpe-digests")
    for folder in folders:
        remove(docs.sparkSession, folder)
    return out


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
