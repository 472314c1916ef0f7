"""Training-data operators on tables that a size, a prefix or an order would cut."""

import numpy as np

from gradus.llm import secrets, toxicity


def test_random_keys_are_found_in_small_tables(spark):
    rng = np.random.default_rng(7)
    keys = ["".join(rng.choice(list(secrets.ENCODINGS["base62"]), 60)) for _ in range(30)]
    names = ["TheRainInSpainStaysMainlyInThePlainOf2DaysAndMoreOfThoseDays", "GetCustomerInvoiceByRegionAndProductVersion2ForTheBackupQueue"]
    rows = [(i, f"we used {k} here") for i, k in enumerate(keys)] + [(100 + i, f"we called {n} here") for i, n in enumerate(names)]

    def found(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.spans(df).collect()}

    got = found(rows)
    assert sum(any(rows[i][1][s:e] == k for s, _, e in got[i]) for i, k in enumerate(keys)) >= 27
    assert not got[100] and not got[101]
    assert sum(bool(found([r])[r[0]]) for r in rows[:3]) >= 2
    copied = found([(i, rows[i % 32][1]) for i in range(320)])
    assert sum(bool(copied[i]) for i in range(320) if i % 32 < 30) >= 270
    text = secrets.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum("[SECRET:random]" in r.text for r in text) >= 27


def test_toxicity_learns_from_whole_texts_and_short_words():
    rng = np.random.default_rng(3)
    opening = " ".join("".join(rng.choice(list("aeioustrnl"), 6)) for _ in range(120))
    body = ["quixotry", "flumptious", "vexwander"]
    texts = [f"{opening} {' '.join(rng.choice(body, 30))}" for _ in range(60)] + [f"{opening} {' '.join(rng.choice(body, 30))} zog zog" for _ in range(20)]
    model = toxicity.train(texts, [0] * 60 + [1] * 20)
    assert all(w.encode() in model.ordinary for w in body)
    assert toxicity.stems(b"zog!") == ["zog"] and toxicity.stems(b"!") == []
    assert "zog" in toxicity.telling(texts, [0] * 60 + [1] * 20)


def test_toxicity_sample_ignores_length(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 20_000)
    rows = [(i, ("x " * 500 if i % 11 == 0 else "y " * 50)) for i in range(275)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 11 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    texts, toxic, _ = toxicity.sample(docs, labels)
    assert 5 <= sum(toxic) < 20 and sum(map(len, texts)) <= 20_000


def test_spans_that_meet_none_taken():
    from gradus.llm._common import clear_of

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 30):
        taken = [(int(a), int(a + b)) for a, b in zip(rng.integers(0, 60, n), rng.integers(1, 9, n), strict=True)]
        clear = clear_of(taken)
        for a in range(70):
            for b in range(a + 1, a + 12):
                assert clear(a, b) == all(b <= x or a >= z for x, z in taken)
