"""Indexed lookups and joins against plain loops over all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from gradus.operators import catalogue, numbering, pairs
from gradus.plans import registry

registry.load()


def test_texts_that_hold_others(spark):
    rng = random.Random(3)
    texts = lambda n, most: {"".join(rng.choice("abđ ") for _ in range(rng.randrange(most))) for _ in range(n)}
    inner, outer = texts(150, 6) | {"", "a"}, texts(200, 14) | {"", "aaaa" * 30}
    table = lambda name, xs: spark.createDataFrame([(x,) for x in sorted(xs)], f"{name} string")
    got = [(r.inner, r.outer) for r in catalogue.holding(table("inner", inner), table("outer", outer)).collect()]
    assert sorted(got) == sorted((a, b) for a in inner for b in outer if a and a in b)


def plain_lookup(code, name, entries, keywords):
    digits, low = "".join(c for c in code or "" if c.isdigit()), (name or "").split("(")[0].strip().lower()
    for ordinal, own, _, group in reversed(entries):
        if digits and own == digits:
            return ordinal, group, "code"
    for ordinal, _, text, group in entries:
        if text and (text.lower() in low or low in text.lower()):
            return ordinal, group, "name"
    prefix = digits[:4] if len(digits) >= 4 else digits[:3]
    for ordinal, own, _, group in entries:
        if prefix and own.startswith(prefix):
            return ordinal, group, "prefix"
    for words, group in keywords:
        if any(w in low for w in words):
            return None, group, "keyword"
    return None, catalogue.OTHER, "default"


def test_catalogue_by_code_names_prefix_and_words(spark):
    entries = [(1, "7340101", "Quản trị kinh doanh", "A"), (2, "7480201", "Công nghệ thông tin", "B"), (3, "7480202", "", "C"), (4, "7720101", "y khoa", "D"), (5, "7340101", "Marketing số", "E")]
    asked = [
        ("7480202", "x"), ("734-0101", None), ("7480201C", "y khoa"), (None, "Công nghệ thông tin (CLC)"), (None, "Y Khoa tổng quát"), (None, "trị kinh"), ("73401", "không có"),
        ("748", "nothing"), ("77", "nothing"), ("7", "nothing"), ("9999999", "Kế toán"), ("", "Trí tuệ nhân tạo"), ("99", "Tiếng Nhật"), (None, "điện lạnh"), ("99", "zzz"), (None, None), ("1", "  (note) "),
    ]
    df = spark.createDataFrame(asked, "code string, name string")
    book = spark.createDataFrame(entries, "ordinal int, code string, name string, `group` string")
    clean = lambda c, n: ("".join(x for x in c or "" if x.isdigit()), (n or "").split("(")[0].strip().lower())
    want = {clean(c, n): plain_lookup(c, n, entries, catalogue.KEYWORDS) for c, n in asked}
    assert {(r.code, r.name): (r.entry, r.group, r.basis) for r in catalogue.ordered_lookup(df, book).collect()} == want
    assert {basis for _, _, basis in want.values()} == {"code", "name", "prefix", "keyword", "default"}


def test_positions_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["b", None]), rng.randrange(10**6)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    ordered = sorted(v for _, v in rows)
    assert [r.v for r in sorted(numbering.positions(df, [df.v.asc()]).collect(), key=lambda r: r.position)] == ordered
    got = {}
    for r in numbering.positions(df, [df.v.desc()], ["k"]).collect():
        got.setdefault(r.k, {})[r.position] = r.v
    for k, places in got.items():
        assert [places[i] for i in range(len(places))] == sorted((v for x, v in rows if x == k), reverse=True)


def close_names(rng, n):
    words = ["kinh", "doanh", "quan", "tri", "cong", "nghe", "thong", "tin", "y", "khoa", "ai"]
    out = set()
    for _ in range(n):
        name = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
        out |= {name, "".join(c for c in name if rng.random() > 0.08), name[: rng.randrange(1, 4)], "zz" + name[::-1]}
    return sorted(x for x in out if x) + ["x" * 30, "x" * 31, "xy" * 15]


@pytest.mark.parametrize("least", [0.7, 0.78, 0.9, 1.0])
def test_similar_pairs(spark, least):
    rng = random.Random(least)
    names = [(g, n) for g in ("a", "b") for n in close_names(rng, 25)]
    df = spark.createDataFrame([*names, *names[:5], (None, "kinh"), ("a", None)], "`group` string, name string")
    want, alike = {}, {}
    for g, a in names:
        for h, b in names:
            if g == h and a < b:
                ratio, (x, y) = SequenceMatcher(None, a, b).ratio(), (set(a.split()), set(b.split()))
                jaccard = len(x & y) / len(x | y) if x | y else 0
                if jaccard >= least:
                    alike[g, a, b] = jaccard
                if max(ratio, jaccard) >= least:
                    want[g, a, b] = ratio, max(ratio, jaccard)
    assert {(r.group, r.a, r.b): r.jaccard for r in pairs.by_words(df, least).collect()} == alike
    got = pairs.by_either(df, least).collect()
    assert len(got) == len(want) > 0 and {(r.group, r.a, r.b): (r.ratio, r.similarity) for r in got} == want


def test_all_pairs_of_a_brand_are_measured(spark, tmp_path):
    names = ["red ring", "blue bolt", "red bolt", "old", "new plate", None]
    rows = [(f"B{g}" if g else None, n, t, i % 3, 9.0) for g in range(3) for i, n in enumerate(names) for t in ("SMALL", "LARGE", "SMALL") if n]
    spark.createDataFrame(rows, "p_brand string, p_name string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = [tuple(r) for r in registry.QUERIES["identity_pairs_jaccard"](spark, str(tmp_path)).collect()]
    sizes: dict = {}
    for g, n, t, size, _ in rows:
        sizes.setdefault((g, f"{n} {t.lower()}"), set()).add(size)
    share = lambda a, b: len({*a.split()} & {*b.split()}) / len({*a.split()} | {*b.split()})
    want = [(g, a, b, share(a, b), bool(x & y)) for (g, a), x in sizes.items() for (h, b), y in sizes.items() if g is not None and g == h and a < b]
    assert sorted(got) == sorted(want) and 0.0 in {r[3] for r in got} and len(got) == 2 * 45
