"""Secret scans by a battery of randomness tests.

Base spans come of three patterns (assign, access, hex). The method adds strings that look
random: runs of key characters whose encoding can be inferred, tested for uniform use of
that encoding's alphabet (chi-squared), for runs about the median and for serial
correlation; Fisher's method combines the three p-values into one, high for random strings.

False discoveries are controlled by length against reference strings, identifiers made of
ordinary words and tested alike. Each encoding and length class has KNOWN of them, of its
candidates' lengths, from a fixed list of words, so that a table of any size can flag
something; each document adds one of its own words. For each class, the threshold is the lowest p-value at which the
share of reference strings that pass, times the number of candidates, is at most FDR times
the number of candidates that pass. Short classes, where the tests can't tell words from
keys, thus flag little or nothing. The histograms cover all documents and have a fixed
number of cells.

Defined cases: null text is empty and has no spans; repeated rows repeat; an empty table
gives an empty result; a span of the method that would overlap a base span is left out;
further columns are ignored (kept by redact). Each text is read whole; patterns are
anchored so that long runs take linear time.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import clear_of, exact, materialize

KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
#: Shortest candidate, and the lower ends of the length classes.
SHORTEST, LENGTHS = 20, (20, 24, 32, 48, 80)
#: p-values are told apart by -log10 in steps of 1 / STEPS up to BINS / STEPS.
STEPS, BINS = 8, 96
#: Reference strings of each class that don't come from the table, their greatest length, and their words.
KNOWN, LONGEST = 2000, 128
WORDS = """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she
there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may
first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down
should because long each just state those people too how little good world make very year still see own work men day get here old life both between being
under three never know same last another while us might great go come since against right came take used himself few house use place during high without
again home around small however found part school once general upon every does got united left number course war until always away something fact public
though less put think almost hand enough far took head yet government system set told nothing night end better called find look going point knew next city
business case group give toward days young let room side social given order early second possible whole rather important several power things political
name user account service request response config server client index value table record update create delete session manager handler factory version
build release archive image report backup invoice product customer address payment message event queue worker cluster region bucket""".split()

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets by encoding, smallest first.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_INDEX = {name: {c: i for i, c in enumerate(letters)} for name, letters in ENCODINGS.items()}
_SETS = {name: frozenset(letters) for name, letters in ENCODINGS.items()}


def infer_encoding(s: str) -> str | None:
    """The smallest alphabet that holds a string with both letters and digits."""
    used = set(s)
    if not used & set(_DIGITS) or not used - set(_DIGITS):
        return None
    return next((name for name, letters in _SETS.items() if used <= letters), None)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by its finite sums."""
    half = x / 2
    if half > 700:
        return 0.0
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, df // 2 + 1):
        total += term
        term *= half / (i + 0.5)
    return min(1.0, total)


def battery(s: str, encoding: str) -> float:
    """Fisher's combination of the three tests' p-values: low if s isn't random."""
    index, size = _INDEX[encoding], len(ENCODINGS[encoding])
    values = [index[c] for c in s]
    n = len(values)
    groups = max(2, min(size, n // 5))
    counts = [0] * groups
    widths = [0] * groups
    for v in range(size):
        widths[v * groups // size] += 1
    for v in values:
        counts[v * groups // size] += 1
    uniform = chi2_sf(sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, widths, strict=True)), groups - 1)
    signs = [v >= size / 2 for v in values]
    high = sum(signs)
    low = n - high
    if high and low:
        runs = 1 + sum(a != b for a, b in zip(signs, signs[1:], strict=False))
        mean = 2 * high * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    else:
        runs_p = 2.0 ** (1 - n)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if spread:
        r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / spread
        serial = math.erfc(abs(r + 1 / n) * math.sqrt(n / 2))
    else:
        serial = 2.0 ** (1 - n)
    tiny = 1e-300
    return chi2_sf(-2 * sum(math.log(max(p, tiny)) for p in (uniform, runs_p, serial)), 6)


def cell(encoding: str, n: int, p: float) -> tuple[str, int, int]:
    """Encoding, length class and bin of a p-value (0: most random)."""
    return encoding, sum(n >= x for x in LENGTHS) - 1, min(BINS - 1, int(-math.log10(max(p, 1e-300)) * STEPS))


def base_spans(text: str, long_words: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for at, word in long_words:
        if "AKIA" in word:
            out += [(at + m.start(), 1, at + m.end()) for m in _ACCESS.finditer(word)]
        if len(word) >= 24:
            out += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(word)]
    return sorted(out)


def long_words(text: str) -> list[tuple[int, str]]:
    """Words of SHORTEST or more characters and where they start; no key holds white space."""
    out, at = [], 0
    for word in text.split():
        if len(word) >= SHORTEST:
            at = text.index(word, at)
            out.append((at, word))
            at += len(word)
    return out


def candidates(words: list[tuple[int, str]]) -> list[tuple[int, int, str, int, int]]:
    """(start, end, *cell) of each run of key characters with an inferred encoding."""
    out = []
    for at, word in words:
        for m in _RUN.finditer(word):
            body = m.group().rstrip("=")
            encoding = infer_encoding(body) if len(body) >= SHORTEST else None
            if encoding:
                out.append((at + m.start(), at + m.start() + len(body), *cell(encoding, len(body), battery(body, encoding))))
    return out


def identifier(words, number: str, encoding: str, n: int) -> str | None:
    """An identifier of n characters made of words, a number after each fourth; None if they don't fill it."""
    letters, s = _SETS[encoding], ""
    for i, word in enumerate(words):
        if encoding in ("HEX", "base32", "upper36"):
            word = word.upper()
        elif encoding in ("hex", "lower36"):
            word = word.lower()
        else:
            word = word.capitalize()
        s += "".join(c for c in word if c in letters) + ("-" if encoding == "base64url" and i % 2 else "")
        if i % 4 == 3:
            s += "".join(c for c in number if c in letters)
        if len(s) >= n:
            return s[:n]
    return None


def reference(text: str, doc_id: object = "") -> tuple[str, int, int] | None:
    """The cell of an identifier made of a document's own words: its style, place and length by the hash of both.

    The id takes part so that copies of one text are dealt over all cells. Words long enough to be keys are left out.
    """
    seed = crc32(f"{doc_id} {text}".encode("utf-8", "surrogatepass"))
    names = [*ENCODINGS]
    encoding, n = names[seed % len(names)], LENGTHS[seed // 8 % len(LENGTHS)] + seed // 64 % 8
    at = seed // 512 % max(1, len(text) - 400)
    own = [w for w in text[at : at + 400].split() if len(w) < SHORTEST]
    s = identifier(own, str(seed // 4096 % 89 + 10), encoding, n)
    return s and cell(encoding, n, battery(s, encoding))


@lru_cache(256)
def known(encoding: str, lengths: tuple[tuple[int, int], ...]) -> tuple[int, ...]:
    """Bins of KNOWN identifiers made of WORDS, of lengths in proportion to (length, count): the same in every run."""
    rng, bins = random.Random(encoding), [0] * BINS
    all_counts = sum(c for _, c in lengths)
    at, n, upto = iter(lengths), 0, 0
    for i in range(KNOWN):
        while upto * KNOWN <= i * all_counts:
            n, count = next(at)
            upto += count
        s = None
        while s is None:
            s = identifier(rng.choices(WORDS, k=n), str(rng.randrange(10, 10_000)), encoding, n)
        bins[cell(encoding, n, battery(s, encoding))[2]] += 1
    return tuple(bins)


_CELL = "struct<encoding:string,length:int,bin:int>"
_SCAN = f"base array<struct<start:bigint,kind:int,end:bigint>>, found array<struct<start:bigint,end:bigint,encoding:string,length:int,bin:int,clear:boolean>>, reference {_CELL}"


def _scan_type() -> list[pa.DataType]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    cells = [("encoding", pa.string()), ("length", pa.int32()), ("bin", pa.int32())]
    return [pa.list_(span), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), *cells, ("clear", pa.bool_())])), pa.struct(cells)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, candidates with their cells and whether they meet no base span, and the reference cell of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(exact(docs, "doc_id").alias("doc_id"), exact(docs, "text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        types = _scan_type()
        for batch in batches:
            base, found, refs = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                words = long_words(text)
                known = base_spans(text, words)
                clear = clear_of([(s, e) for s, _, e in known])
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in known])
                found.append([dict(zip(("start", "end", "encoding", "length", "bin", "clear"), (*x, clear(x[0], x[1])), strict=True)) for x in candidates(words)])
                ref = reference(text, doc_id)
                refs.append(ref and dict(zip(("encoding", "length", "bin"), ref, strict=True)))
            columns = [pa.array(x, t) for x, t in zip((base, found, refs), types, strict=True)]
            yield pa.record_batch([batch.column("doc_id").cast(id_type), *columns], ["doc_id", "base", "found", "reference"])

    return source.mapInArrow(run, f"doc_id {kind.simpleString()}, {_SCAN}")


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], int]:
    """The last bin that passes, by encoding and length class; classes without one are absent.

    The driver gets two histograms of at most len(ENCODINGS) * LONGEST * BINS cells.
    """
    n = F.least(F.col("c.end") - F.col("c.start"), F.lit(LONGEST)).alias("n")
    cells = scanned.select(F.explode("found").alias("c")).select("c.encoding", "c.length", "c.bin", n, F.lit(0).alias("is_ref"))
    refs = scanned.where("reference is not null").select("reference.*", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("is_ref"))
    counts: dict = {}
    sizes: dict = {}
    for row in cells.unionByName(refs).groupBy("encoding", "length", "bin", "n", "is_ref").count().collect():
        key = row.encoding, row.length
        counts.setdefault(key, ([0] * BINS, [0] * BINS))[row.is_ref][row.bin] += row["count"]
        if not row.is_ref:
            sizes.setdefault(key, Counter())[row.n] += row["count"]
    out = {}
    for key, lengths in sizes.items():
        found, ref = counts[key]
        ref = [a + b for a, b in zip(ref, known(key[0], tuple(sorted(lengths.items()))), strict=True)]
        all_found, all_ref, passed, false = sum(found), sum(ref), 0, 0
        for i in range(BINS):
            passed += found[i]
            false += ref[i]
            if passed and all_found * (false + 1) / (all_ref + 1) <= fdr * passed:
                out[key] = i
    return out


def added(base: list, found: list, passes: dict[tuple[str, int], int]) -> list[tuple[int, int]]:
    """(start, end) of candidates that pass and overlap no base span."""
    clear = clear_of([(x, z) for x, _, z in base])
    return [(s, e) for s, e, encoding, length, b in found if b <= passes.get((encoding, length), -1) and clear(s, e)]


def spans(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base and spans (all): arrays of (start, kind, end), kind as its place in KINDS."""
    scanned = materialize(scan(docs), "secrets")
    passes = thresholds(scanned, fdr)
    passed = F.filter("found", lambda c: c["clear"] & _passes(c, passes))
    more = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def _passes(c, passes):
    ok = F.lit(False)
    for (encoding, length), last in sorted(passes.items()):
        ok = ok | ((c["encoding"] == encoding) & (c["length"] == length) & (c["bin"] <= last))
    return ok


def redact(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """The rows with each span replaced by [SECRET:kind]; n_chars, where present, follows the text.

    All rows and columns stay; overlapping spans are replaced as one, named for the first.
    """
    passes = thresholds(materialize(scan(docs), "secrets"), fdr)
    text_at = next(i for name in ("text", None) for i, c in enumerate(docs.columns) if c == name or name is None and c.lower() == "text")
    chars_at = next((i for i, c in enumerate(docs.columns) if c == "n_chars"), None)

    def run(batches):
        for batch in batches:
            texts, lengths = [], []
            for text in batch.column(text_at).to_pylist():
                if text:
                    words = long_words(text)
                    base = base_spans(text, words)
                    text = replaced(text, sorted([*base, *((s, 3, e) for s, e in added(base, candidates(words), passes))]))
                texts.append(text)
                lengths.append(None if text is None else len(text))
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if chars_at is not None:
                columns[chars_at] = pa.array(lengths, pa.int64()).cast(batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def replaced(text: str, found: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[SECRET:{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(column: str, kinds: tuple[str, ...] = KINDS) -> F.Column:
    """kind:start:end of an array of (start, kind, end), comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.sort_array(column), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, kinds: tuple[str, ...], n_base: int) -> DataFrame:
    def count(i):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint").alias(f"n_{kinds[i]}")

    counts = [count(i) for i in range(n_base)]
    return found.select("doc_id", *counts, F.sha2(joined("base", kinds), 256).alias("base_sha256"), joined("spans", kinds).alias("spans"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return digest(spans(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS, 3)
