"""The battery and the thresholds against plain versions; redaction's edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from gradus.llm import secrets


def plain_battery(s, encoding):
    """The three tests by their textbook sums, combined by Fisher's method."""
    letters = secrets.ENCODINGS[encoding]
    v = np.array([letters.index(c) for c in s], float)
    n, size = len(v), len(letters)
    k = max(2, min(size, n // 5))
    group = (v * k // size).astype(int)
    expected = np.bincount((np.arange(size) * k // size).astype(int), minlength=k) * n / size
    uniform = secrets.chi2_sf(float(((np.bincount(group, minlength=k) - expected) ** 2 / expected).sum()), k - 1)
    up = v >= size / 2
    a, b = int(up.sum()), int((~up).sum())
    if a and b:
        runs = 1 + int((up[1:] != up[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 1e-12 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = v - v.mean()
    p_serial = math.erfc(abs(float((d[:-1] * d[1:]).sum() / (d * d).sum()) + 1 / n) * math.sqrt(n / 2)) if (d * d).sum() else 2.0 ** (1 - n)
    return secrets.chi2_sf(-2 * sum(math.log(max(p, 1e-300)) for p in (uniform, p_runs, p_serial)), 6)


def test_battery_equals_the_plain_sums():
    rng = random.Random(0)
    for encoding, letters in secrets.ENCODINGS.items():
        for n in (20, 33, 64, 200):
            for alphabet in (letters, letters[: len(letters) // 2], letters[:3]):
                s = "".join(rng.choice(alphabet) for _ in range(n))
                assert secrets.battery(s, encoding) == pytest.approx(plain_battery(s, encoding), rel=1e-6, abs=1e-12)
    assert np.mean([secrets.battery("".join(rng.choices(secrets.ENCODINGS["hex"], k=64)), "hex") < 0.05 for _ in range(400)]) < 0.12


def test_thresholds_equal_a_plain_count(spark):
    rng = random.Random(2)
    keys = ["".join(rng.choices(secrets.ENCODINGS["base62"], k=60)) for _ in range(40)]
    rows = [(i, f"the key {k} is set here and there for all to see in every file") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    scanned = secrets.scan(df)
    got = secrets.thresholds(scanned)
    found, refs, lengths = Counter(), Counter(), {}
    for r in scanned.collect():
        for c in r.found:
            found[c.encoding, c.length, c.bin] += 1
            lengths.setdefault((c.encoding, c.length), Counter())[min(c.end - c.start, secrets.LONGEST)] += 1
        if r.reference:
            refs[tuple(r.reference)] += 1
    want = {}
    for (encoding, length), sizes in lengths.items():
        known = secrets.known(encoding, tuple(sorted(sizes.items())))
        every = sum(known) + sum(n for (e, k, _), n in refs.items() if (e, k) == (encoding, length))
        for i in range(secrets.BINS):
            passed = sum(n for (e, k, b), n in found.items() if (e, k) == (encoding, length) and b <= i)
            false = sum(known[: i + 1]) + sum(n for (e, k, b), n in refs.items() if (e, k) == (encoding, length) and b <= i)
            if passed and sum(sizes.values()) * (false + 1) / (every + 1) <= secrets.FDR * passed:
                want[encoding, length] = i
    assert got == want and got


def test_redact_takes_odd_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "password: hunter22 here", 5, "k"), (2, None, None, None), (3, "", 0, "")], "doc_id bigint, Text string, n_chars int, `a.b` string")
    got = {r.doc_id: tuple(r) for r in secrets.redact(df).collect()}
    assert got[1][1:] == ("[SECRET:assign] here", 20, "k") and got[2][1] is None and got[3][1] == ""
    assert secrets.redact(df.limit(0)).count() == 0 and secrets.redact(df).columns == df.columns
