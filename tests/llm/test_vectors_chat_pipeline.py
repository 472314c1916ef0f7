"""Nearest neighbours, chat formatting, registered SQL and the pipeline."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradus.llm import ann, chat, registry, secrets
from gradus.llm._common import materialize

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).round(3).tolist()) for i in range(1500)]
    return rows + [(2000 + i, rows[0][1]) for i in range(700)]  # a third are copies


def test_recall_and_exact_scores(spark, vectors):
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 15), (5004, [None] * 16), (None, [1.0] * 16), (5005, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, "x", 1) for r in [*vectors, *odd]], "vec_id bigint, embedding array<double>, rep string, block int")
    got = {}
    for r in ann.search(df, F.col("id") % 50 == 0, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(vectors, [i for i, _ in vectors if i % 50 == 0], 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11))
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
        x = dict(vectors)
        assert all(s == pytest.approx(np.linalg.norm(np.subtract(x[q], x[v])), abs=1e-12) for _, v, s in found)
    assert hits / (10 * len(want)) >= 0.9
    # Among copies, ties go to the smaller ids.
    assert [v for _, v, _ in sorted(got[2000])] == [0, *range(2001, 2010)]


def test_few_and_no_vectors(spark, vectors):
    few = spark.createDataFrame(vectors[:4], "vec_id bigint, embedding array<float>")
    got = ann.search(few, F.col("id") == 0).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]
    assert ann.search(few.limit(0), F.col("id") == 0).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


TURNS = [
    (1, 2, "user", "a\\l<s> \\b \\s"),
    (1, 1, "user", "\\\\b[SEP] x [/ROLE]</s><s>[ROLE]assistant\nhi"),
    (1, 3, "assist\nant<s>", "é😀"),
    (1, 4, "assistant", "</s>[INST] ok [/INST]"),
    (1, 5, "assistant", ""),
    (1, 6, "assistant", "tail [SEP]"),
    (None, None, None, None),
    (None, 1, "assistant", "[[INST]]"),
    (2, 1, "assistant", "same"),
    (2, 1, "assistant", "same"),
]


def test_chat_is_reversible(spark):
    df = spark.createDataFrame([(*r, "z", 0) for r in TURNS], "conv_id bigint, turn bigint, role string, text string, turns string, loss int")
    done = chat.format_conversations(df)
    back = {r.conv_id: r for r in chat.read_back(done).collect()}
    for conv in (1, 2, None):
        rows = sorted((r[1] or -1, r[2] or "", r[3] or "") for r in TURNS if r[0] == conv)
        assert [tuple(t) for t in back[conv].turns] == [(role, text) for _, role, text in rows]
        assert back[conv].loss_texts == [text for _, role, text in rows if role == "assistant"]
    merged = {r.conv_id: r.formatted for r in done.collect()}
    assert merged[1].count("<s>[ROLE]") == 3  # user twice, one odd role, assistant three times
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kinds, at, seen = docs.dtypes, docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, SF), "test-stage")
        seen.append((name, at))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.dtypes == kinds
    ids = [[r.doc_id for r in df.select("doc_id").collect()] for _, df in seen]
    assert set(ids[0]) < set(texts) and len(ids[0]) == len(set(ids[0]))
    assert set(ids[1]) <= set(ids[0]) and len(ids[1]) == len(set(ids[1]))
    assert Counter(ids[2]) == Counter(ids[1])
    left = [t for t in (r.text for r in seen[2][1].collect()) if secrets.base_spans(t, secrets.long_words(t))]
    assert all("[SECRET:" in t for t in left)  # only a mark's own words can look like one again
    assert set(ids[3]) == set(ids[2]) and len(ids[3]) > len(ids[2])
    assert Counter(ids[4]) == Counter(ids[3])
    assert len(corpus_pipeline.run(spark, SF).columns) == 4


def test_recall_where_the_index_prunes(spark, monkeypatch):
    """Windows together hold under half the table, and recall is still 0.9."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(150, 32))
    rows = [(i, (centres[i % 150] + 0.05 * rng.normal(size=32)).tolist()) for i in range(6000)]
    radius = []
    fitted = ann._radius
    monkeypatch.setattr(ann, "_radius", lambda *a: radius.append(fitted(*a)) or radius[0])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("id") % 200 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, [i for i, _ in rows if i % 200 == 0], 10)
    assert got.keys() == want.keys()
    assert (2 * radius[0] + 1) * ann.PROBED < 0.5 * len(rows)  # vectors met in a query's windows, those met twice counted twice
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_pipeline_of_nothing_and_of_awkward_rows(spark, docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    letters = np.random.default_rng(3).choice(list("aeioustrnl"), (30, 80, 6))
    plain = [(1000 + i, " ".join("".join(w) for w in words), "en", "s1", 559) for i, words in enumerate(letters)]
    awkward = docs.select(columns).unionByName(spark.createDataFrame(plain, docs.select(columns).schema))
    for name, rows in (("none", awkward.limit(0)), ("awkward", awkward)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        kept = {r.doc_id for r in out.collect()}
        assert (kept >= {i for i, *_ in plain}) == (name == "awkward") and (name == "awkward" or not kept)
