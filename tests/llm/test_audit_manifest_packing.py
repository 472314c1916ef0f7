"""Filter audit, Merkle manifest and packing against plain versions."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest
from llm_texts import TEXTS

from gradus.llm import audit, merkle, packing

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Audit


def failing(rows):
    """Letters of the filters that each row (doc_id, text) fails."""
    out = []
    for i, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t in rows)
        checks = len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search("[#$%&*|]", text), copy
        out.append({f for f, hit in zip("ABCDE", checks, strict=True) if hit})
    return out


def audited(rows, labels):
    """part -> (order, step) -> the counts, applying every order to every row; rows: doc_id, text, part."""
    fails, out = failing([r[:2] for r in rows]), {}
    for part in {r[2] or "" for r in rows}:
        own = [(f, labels.get(r[0], (0, 0))) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = [x for x in own if not x[0] & set(order[:k]) and f in x[0]]
                hit = [x for x in own if f in x[0]]
                out[part, order, k + 1] = [
                    sum(not x[0] & set(order[: k + 1]) for x in own), len(gone), len(hit) - len(gone),
                    sum(x[0] == {f} for x in own), sum(x[1][0] for x in gone), sum(x[1][1] for x in gone),
                ]
    total = Counter()
    for (part, order, k), v in out.items():
        total[part, order[k - 1]] += v[1]
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def given(result):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in result.collect() if r.part is not None}


def test_audit_of_awkward_rows(spark):
    rng = random.Random(5)
    varied = [(100 + i, " ".join(f"{rng.choice(['a', 'BIG', 'x#', ''])}{rng.randrange(120)}" for _ in range(rng.choice([20, 110, 150]))), rng.choice(["en", "de", None, ""])) for i in range(40)]
    rows = [r[:3] for r in TEXTS] + varied + [(500 + i, varied[i % 3][1], "en") for i in range(12)] + [(900, varied[0][1], "fr")]
    rows = [(i, t, p) for i, t, p in rows]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id bigint, text string, lang string, step int, `A` boolean").repartition(3)
    marks = {i: (int(i % 2 == 0), int(i % 5 == 0)) for i in range(100, 520, 3)}
    labels = spark.createDataFrame([(i, *m) for i, m in marks.items()] + [(100, None, None), (100, 1, 0), (7777, 1, 1)], "doc_id bigint, quality int, toxic int")
    result = audit.audit(df, labels)
    assert given(result) == audited(rows, marks)
    whole = [r for r in result.collect() if r.part is None]  # the CUBE has all parts together, too
    assert len(whole) == 600 and {r.kept + r.removed for r in whole if r.step == 1} == {len(rows)}


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit(docs, labels).where("part is not null").count() == 0


def test_op11(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    marks = {r.doc_id: (int(r.quality == 1), int(r.toxic == 1)) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = audit.op11_audit(spark, SF)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert given(got) == audited(rows, marks)


# Manifest


def leaf(row, text):
    values = row["doc_id"], row["source"], row["lang"], row["n_chars"], text
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for nodes in tree[:-1]:
        run = i // 3 * 3
        yield nodes[run:i], nodes[i + 1 : run + 3]
        i //= 3


def manifest(rows):
    """Sorted (doc_id as text, leaf, subroot, root, proof, folded root, verified)."""
    key = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names, out = sorted(by, key=key), []
    for r in rows:
        r["leaf"] = leaf(r, r["text"])
    trees = {s: levels([r["leaf"] for r in sorted(by[s], key=lambda r: (key(r["doc_id"]), r["leaf"]))]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(sorted(by[s], key=lambda r: (key(r["doc_id"]), r["leaf"]))):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            hit = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"]
            node = leaf(r, r["text"].replace("\n", "")) if hit else r["leaf"]
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((str(r["doc_id"]), r["leaf"], trees[s][-1][0], top[-1][0], sha(*(x for p in path for side in p for x in side)), node, node == top[-1][0]))
    return sorted(out)


def found(result):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in result.collect())


@pytest.mark.parametrize("n", [*range(1, 31), 80, 81, 82, 243])
def test_traversal_gives_every_path_in_little_memory(n, monkeypatch):
    nodes = [sha(str(i)) for i in range(n)]
    tree, height = levels(nodes), merkle._height(n, 7)
    assert height == len(tree) - 1
    live = []
    old = merkle.Treehash.step

    def step(self, leaves):
        old(self, leaves)
        live.append(sum(map(len, self.held)))

    monkeypatch.setattr(merkle.Treehash, "step", step)
    for i, path in enumerate(merkle.paths(nodes, height)):
        assert path == [("".join(a), "".join(b)) for a, b in siblings(tree, i)]
        assert merkle.fold(nodes[i], path) == tree[-1][0]
    assert max(live, default=0) <= 2 * height + 3


def test_manifest_of_awkward_rows(spark):
    rng = random.Random(1)
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), (*t, len(t[1] or "")), strict=True)) for t in TEXTS]
    rows += [{"doc_id": i, "text": rng.choice(["a\nb", "c", "", None, "é\n\n😀"]), "lang": None, "source": rng.choice(["hot"] * 4 + ["é", "z", "", "Z"]), "n_chars": rng.choice([1, None])} for i in range(1000, 1140)]
    rows += [{"doc_id": -5, "text": "alone\n", "lang": "en", "source": "one row", "n_chars": 6}]
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "k") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf int, g string").repartition(5)
    want = manifest(rows)
    for block_height in (1, 2, 7):  # blocks of 3, 9 and 2,187 leaves: several storeys, and one
        assert found(merkle.manifest(df, block_height)) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)


def test_manifest_of_one_row_and_of_nothing(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    (row,) = merkle.manifest(spark.createDataFrame([(1, "x", "en", None, 1)], schema)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("")
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0


def test_op12(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(merkle.op12_merkle(spark, SF)) == manifest(rows)


# Packing


def check_layout(rows, length):
    """Sequences are gapless and short enough; their number."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def best_fit(sizes, length):
    """Bins that plain best fit takes, largest first."""
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] + n <= length]
        if fits:
            bins[max(fits, key=lambda b: bins[b])] += n
        else:
            bins.append(n)
    return len(bins)


def check_pieces(rows, texts, length):
    """Every piece of every (doc_id, text) as the tokenizers library has it."""
    tok, want = packing.load_tokenizer(packing.default_tokenizer()), Counter()
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % length or length
        edges = [0, *range(first, len(ids) + 1, length)]
        want.update((i, k, a, b - a, crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_op13(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.op13_packing(spark, SF).collect()
    check_pieces(rows, texts, 2048)
    assert check_layout(rows, 2048) == best_fit([r.length for r in rows], 2048)


def test_packing_of_awkward_rows(spark, docs, empty):
    pieces = packing.pieces(docs, 16)
    rows = packing.pack(pieces, 16, slack=0, least=2).collect()
    check_pieces(rows, [r[:2] for r in TEXTS], 16)
    assert check_layout(rows, 16) <= best_fit([r.length for r in rows], 16) + 1
    none = packing.pack(packing.pieces(empty))
    assert none.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and none.count() == 0


def test_groups_merge_up_the_tree(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(1, 60) if rng.random() < 0.7 else rng.randrange(60, 100) for _ in range(4000)]
    table = packing.materialize(spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, length bigint"), "sizes")
    rows = packing.pack(table, 100, slack=0, least=64).collect()  # 63 groups, three rounds
    assert Counter(r.length for r in rows) == Counter(sizes)
    whole, apart = best_fit(sizes, 100), sum(best_fit(sizes[i::63], 100) for i in range(63))
    assert whole <= check_layout(rows, 100) < apart
    halves = packing.materialize(spark.createDataFrame([(i, 60) for i in range(500)], "doc_id bigint, length bigint"), "sizes")
    assert check_layout(packing.pack(halves, 100, most=40, least=40).collect(), 100) == 500
    ones = packing.materialize(spark.createDataFrame([(i, 1) for i in range(500)], "doc_id bigint, length bigint"), "sizes")
    assert check_layout(packing.pack(ones, 100, slack=0, least=30).collect(), 100) == 6  # bins of about 30 stay whole: three fit
