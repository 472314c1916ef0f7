"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window is
one word, lower-cased, inside a fixed frame that both dictionaries hold (so that short words
compress at all and only the word differs). A window's distance is its length under the
ordinary dictionary less its length under the toxic one. A document is described by how
many of its windows reach each threshold, and a logistic calibration of those counts, fitted
on the labelled documents, gives a score from 0 to 1.

The toxic dictionary sees, of each toxic document, the words whose stem is over-represented
in toxic documents; else the words common to all text would fill it.

The labelled sample is bounded: at most MAX_TOXIC and MAX_ORDINARY documents by the order of
a hash of their id, weighted back to their class's share. In that order, a text that would
take the sample past SAMPLE_CHARS is left out; the others are learnt from whole.
Stems have 4 to 12 letters; shorter words are stems as they are. Scoring covers every whole
text. Rows whose crc32(doc_id as text) mod 5 is 0 are never
learned from.

Defined cases: null and empty texts have no windows and get the score of that; documents
labelled more than once are toxic if any label says so; null ids or labels teach nothing;
without both classes among the labels every score is 0; a null doc_id counts as held out;
repeated rows repeat; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import exact

MAX_TOXIC, MAX_ORDINARY, SAMPLE_CHARS = 3000, 9000, 60_000_000
FOLDS = 5
#: Bytes of a dictionary, lengths of stems, longest window, zstandard level.
DICTIONARY, STEMS, WINDOW, LEVEL = 4096, (4, 12), 256, 9
#: Thresholds of distance, in bytes, that windows are counted by.
THRESHOLDS = tuple(range(1, 11))
#: Distances a task remembers by word.
MEMO = 400_000
FRAME = bytes(range(128, 192))
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|"


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def stems(word: bytes) -> list[str]:
    """The first STEMS letters of a word; a shorter word is its own stem."""
    bare = word.decode("utf-8", "replace").strip(_EDGE)
    return [bare[:k] for k in range(STEMS[0], min(len(bare), STEMS[1]) + 1)] or [bare] * bool(bare)


def telling(texts: list[str | None], toxic: list[int]) -> set[str]:
    """Stems over-represented in toxic documents; the longest of those that occur as often."""
    counts = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        counts[label].update({s for w in set(words(text)) for s in stems(w)})
    n = sum(toxic)
    share = n / max(1, len(toxic) - n)
    least = max(3, 0.004 * n)
    kept = {s: c for s, c in counts[1].items() if c >= least and c - 6 * (counts[0][s] + 0.5) * share > least / 2}
    covered = {s[:-1] for s, c in kept.items() if c >= 0.8 * kept.get(s[:-1], math.inf)}
    return kept.keys() - covered


def distance(toxic: bytes, ordinary: bytes):
    """A function that gives a window's bytes under the ordinary less those under the toxic dictionary."""
    import zstandard as z

    def compressor(content: bytes):
        known = z.ZstdCompressionDict(content + FRAME, dict_type=z.DICT_TYPE_RAWCONTENT)
        how = z.ZstdCompressionParameters.from_level(
            LEVEL, source_size=128, dict_size=len(content) + len(FRAME), min_match=3,
            write_content_size=False, write_dict_id=False, write_checksum=False,
        )
        known.precompute_compress(compression_params=how)
        return z.ZstdCompressor(compression_params=how, dict_data=known).compress

    bad, good = compressor(toxic), compressor(ordinary)
    before, after = FRAME[:32] + b" ", b" " + FRAME[32:]

    def of(word: bytes) -> int:
        framed = before + word + after
        return len(good(framed)) - len(bad(framed))

    return of


def features(text: str | None, of, memo: dict[bytes, int]) -> np.ndarray:
    found = words(text)
    counts = np.zeros(THRESHOLDS[-1] + 1)
    for word in found:
        d = memo.get(word)
        if d is None:
            parts = [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word), WINDOW * 3 // 4)]
            d = max(map(of, parts))
            if len(word) <= WINDOW:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[word] = d
        counts[min(max(d, 0), THRESHOLDS[-1])] += 1
    reached = counts[::-1].cumsum()[::-1][1:]
    return np.append(np.log1p(reached), math.log1p(len(found)))


def train(texts: list[str | None], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """A model from labelled texts; weights: of an ordinary and of a toxic one. None without both classes."""
    import zstandard as z

    if len(set(toxic)) < 2:
        return None
    stem = telling(texts, toxic)
    bad, good = [], []
    for text, label in zip(texts, toxic, strict=True):
        found = words(text)
        if label:
            told = [max(s, key=len) for s in (stem.intersection(stems(w)) for w in found) if s] if stem else []
            sample = " ".join(["", *told, ""]).encode() if told else b""
        else:
            sample = b" " + b" ".join(found) + b" "
        if len(sample) >= 8:
            (bad if label else good).append(sample)

    def learn(samples: list[bytes]) -> bytes:
        try:
            return z.train_dictionary(DICTIONARY, samples, k=24, d=6, level=3).as_bytes()
        except z.ZstdError:  # too few samples to train on: they are the content themselves
            return b"".join(dict.fromkeys(samples))[-DICTIONARY:]

    dictionaries = [learn(bad), learn(good)]
    size = min(map(len, dictionaries))
    bad_dict, good_dict = (x[len(x) - size :] for x in dictionaries)
    of, memo = distance(bad_dict, good_dict), {}
    x = np.array([features(t, of, memo) for t in texts])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x, y = np.c_[(x - mean) / scale, np.ones(len(x))], np.array(toxic, float)
    share = np.where(y == 1, weights[1], weights[0])
    beta, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (share * (p - y)) + ridge * beta
        hessian = (x * (share * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(bad_dict, good_dict, mean, scale, beta)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list, list[int], tuple[float, float]]:
    """Texts, labels and class weights of the bounded sample."""
    known = labels.select(exact(labels, "doc_id").alias("id"), exact(labels, "toxic").cast("int").alias("toxic"))
    known = known.where("id is not null and toxic is not null").groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("id")))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    picked = [known.where(F.col("toxic") == c).orderBy(*order).limit(most) for c, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY))]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most MAX_TOXIC + MAX_ORDINARY ids
    texts = docs.select(exact(docs, "doc_id").alias("id"), exact(docs, "text").cast("string").alias("text"))
    rows = texts.join(picked, "id").select("id", "toxic", "text").orderBy(*order, "text").limit(MAX_TOXIC + MAX_ORDINARY)
    out, chars = [], 0
    for r in rows.toLocalIterator():
        n = len(r.text or "")
        if chars + n <= SAMPLE_CHARS:
            chars += n
            out.append((r.id, r.text, r.toxic))
    out.sort(key=lambda r: (str(r[0]), r[1] or ""))
    got = Counter(r[2] for r in out)
    weights = tuple(sizes.get(c, 0) / max(1, got[c]) / max(1, sum(sizes.values())) * max(1, len(out)) for c in (0, 1))
    return [r[1] for r in out], [r[2] for r in out], weights


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row, by its text alone."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(exact(docs, "doc_id").alias("doc_id"), exact(docs, "text").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        of, memo = (distance(model.toxic, model.ordinary), {}) if model else (None, None)
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                if model is None:
                    scores.append(0.0)
                    continue
                x = (features(text, of, memo) - model.mean) / model.scale
                z = float(np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30))
                scores.append(1 / (1 + math.exp(-z)))
            yield pa.record_batch([batch.column("doc_id").cast(id_type), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {kind.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) of every row."""
    done = score(docs, train(*sample(docs, labels)))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
