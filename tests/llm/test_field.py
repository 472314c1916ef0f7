"""The segment programme and its gradient against enumeration; extreme and independent texts."""

import math
import random
import time
from collections import defaultdict

import pytest

from gradus.llm import pii


def segmentations(n, found):
    """Every set of candidates (with a kind) that don't overlap."""
    if n <= 0:
        yield ()
        return
    yield from segmentations(n - 1, found)
    for i, j, f in found:
        if j == n:
            for y in range(len(pii.KINDS)):
                for rest in segmentations(i, found):
                    yield (*rest, (i, j, y, tuple(f)))


def random_case(rng):
    n = rng.randint(1, 5)
    names = [f"f{k}" for k in range(4)]
    found = sorted((i, j, rng.sample(names, 2)) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.5)[:4]
    weights = {y: defaultdict(float, {f: rng.uniform(-2, 6) for f in names}) for y in range(len(pii.KINDS))}
    return n, found, weights


def total(segments, weights):
    return sum(pii._score(weights, y, f) for _, _, y, f in segments)


def test_segments_equal_enumeration():
    rng = random.Random(0)
    for _ in range(60):
        n, found, weights = random_case(rng)
        allowed = [s for s in segmentations(n, found) if all(pii._score(weights, y, f) >= pii.MARGIN for _, _, y, f in s)]
        best = max(total(s, weights) for s in allowed)
        got = pii.best_segments(n, found, weights)
        features = {(i, j): f for i, j, f in found}
        assert sum(pii._score(weights, y, features[i, j]) for i, j, y in got) == pytest.approx(best)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_gradient_equals_differences():
    rng = random.Random(1)
    for _ in range(15):
        n, found, weights = random_case(rng)
        for own in weights.values():
            for f in own:
                own[f] /= 4
        every = list(segmentations(n, found))
        chosen = rng.choice(every)
        truth = {(i, j, y) for i, j, y, _ in chosen}

        def loss(weights=weights, every=every, chosen=chosen):
            scores = [total(s, weights) for s in every]
            return math.log(sum(map(math.exp, scores))) - total(chosen, weights)

        slopes = defaultdict(float)
        for y, features, g in pii.gradient(n, found, truth, weights):
            for f in features:
                slopes[y, f] += g
        for y in (0, 3):
            for f in list(weights[y]):
                weights[y][f] += 1e-5
                up = loss()
                weights[y][f] -= 2e-5
                down = loss()
                weights[y][f] += 1e-5
                assert slopes[y, f] == pytest.approx((up - down) / 2e-5, abs=2e-3)


#: Sentences that don't come of the generator, with the personal data in them.
WRITTEN = [
    ("Please call me at (415) 555-2671 after six.", ["(415) 555-2671"]),
    ("Her number is 212-555-0187, ask for Ann.", ["212-555-0187"]),
    ("SSN: 078-05-1120 was on the form.", ["078-05-1120"]),
    ("Überweisung an IBAN DE89 3704 0044 0532 0130 00 bitte.", ["DE89 3704 0044 0532 0130 00"]),
    ("Compte FR1420041010050500013606842 ouvert hier.", None),  # a letter check digit is wanted there
    ("Write to jane.doe [at] example [dot] org today.", ["jane.doe [at] example [dot] org"]),
    ("Reach bob (at) mail.net for details.", ["bob (at) mail.net"]),
    ("The meeting is on 2024-05-13 from 10:30 to 12:00.", []),
    ("Chapter 12, pages 310-342, second edition 1998.", []),
    ("Version 10.4.2 replaced 9.8.1 in 2011.", []),
    ("The population grew from 1,204,500 to 1,310,200.", []),
    ("El total fue 12.450,75 euros en 2019.", []),
    ("We sat at home and looked at the dot on the map.", []),
    ("ISBN 978-3-16-148410-0 is out of print.", []),
]


def test_field_on_written_sentences():
    weights = pii.train()
    hits = wanted = 0
    for text, want in WRITTEN:
        if want is None:
            continue
        got = {text[s:e] for s, _, e in pii.field_spans(text, weights)}
        wanted, hits = wanted + len(want), hits + len(got & set(want))
        assert got <= set(want), text  # nothing is made up
    assert hits >= 0.6 * wanted


@pytest.mark.parametrize(
    "text",
    ["1" * 5000 + ".1.1.1", "1" * 5_000_000, "1." * 400_000, "@" * 300_000, "a@" * 20_000, "at" * 200_000 + " 12345678", "+1 " * 50_000, "11 " * 5000, "(" * 500_000, ("a" * 200 + "11") * 2000, ""],
    ids=["ip", "digits", "dots", "ats", "a@", "at", "plus", "pairs", "open", "run", "empty"],
)
def test_extreme_texts(text):
    began = time.time()
    known = pii.base_spans(text) + pii.field_spans(text, pii.train())
    assert all(0 <= s < e <= len(text) for s, _, e in known)
    assert time.time() - began < 30
