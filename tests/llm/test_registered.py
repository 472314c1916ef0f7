"""The registered queries over whole tables of the least scale factor, against brute force."""

import os
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from test_documents import fingerprint, personal_spans, sha, statistics

from gradus.llm import bpe, pii, registry, token_files

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    tok, want = bpe.load_tokenizer(bpe.default_tokenizer()), {}
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i] = len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op1_bpe")} == want


def test_op2(spark, texts):
    got = run(spark, "op2_quality")
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[1:6]) == statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_op4(spark, texts):
    weights = pii.train()
    for r in run(spark, "op4_pii"):
        base = personal_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        more = [x for x in pii.field_spans(texts[r.doc_id], weights) if all(x[2] <= s or x[0] >= e for s, _, e in base)]
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + more))


def test_op5_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = Counter()
    got = run(spark, "op5_ann")
    for r in got:
        d = np.sqrt(((x - x[ids == r.query_id][0]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != r.query_id][:10]
        found["all"] += 1
        found["hit"] += r.vec_id in best
        assert r.score == pytest.approx(d[ids == r.vec_id][0], abs=1e-12)
    assert found["all"] == 10 * sum(ids % 100 == 0) and found["hit"] >= 0.9 * found["all"]


def test_op6(spark, texts):
    got = run(spark, "op6_secrets")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert sha(",".join(s for s in r.spans.split(",") if not s.startswith("random"))) == r.base_sha256


def test_op8(spark, texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(fps)
    for a in order:
        for b in order:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op8_simhash")} == {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def test_op9(spark, texts):
    tok, want, start = token_files.load_tokenizer(token_files.default_tokenizer()), {}, 0
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        want[i] = start, len(ids), crc32(ids.tobytes())
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op9_token_files")} == want


def test_op10(spark, texts):
    got = run(spark, "op10_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_op10_takes_long_and_empty_texts(spark):
    words = ("a quiet day by the sea " * 9, "you utter rotter blaggard " * 9)
    rows = [(i, words[i % 2] + ("word " * 200_000 if i == 3 else ""), "x") for i in range(60)] + [(60, None, None), (61, "", ""), (62, "z" * 1_000_000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    from gradus.llm import toxicity

    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 63 and all(0 <= s <= 1 for s in got.values())
