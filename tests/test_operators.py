"""Operators on small inline tables."""

import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gradus.functions import exprs, similarity, text
from gradus.operators import gates, lookup, regression
from gradus.operators import series as ops
from gradus.sources import files


def history(spark, changed=None):
    values = {2020: 20.0, 2021: 21.0, 2022: 22.0, 2023: 23.0} | (changed or {})
    return spark.createDataFrame([("series-a", y, v) for y, v in values.items()], "s string, year int, target double")


def features(df):
    out = ops.prior_stats(ops.lag_features(df, ["s"]), ["s"]).drop("target")
    return {r.year: r.asDict() for r in out.collect()}


def test_features_never_see_their_own_year(spark):
    before, after = features(history(spark)), features(history(spark, {2022: 29.5}))
    assert before[2022] == after[2022]
    assert before[2023]["lag_1_year"] == 22.0
    assert after[2023]["lag_1_year"] == 29.5


def test_gaps_and_prior_statistics(spark):
    df = spark.createDataFrame([("a", 2018, 10.0), ("a", 2019, 12.0), ("a", 2021, 11.0), ("a", 2022, 15.0)], "s string, year int, target double")
    got = [features(df)[y] for y in (2018, 2019, 2021, 2022)]
    assert [r["lag_1_year"] for r in got] == [None, 10, None, 11]
    assert [r["prior_count"] for r in got] == [0, 1, 2, 3]
    assert [r["prior_median"] for r in got] == [None, 10, 11, 11]
    assert [r["prior_std"] and round(r["prior_std"], 6) for r in got] == [None, None, 1, 0.816497]
    assert [r["prior_slope"] and round(r["prior_slope"], 6) for r in got] == [None, None, 2, 0.214286]
    assert [r["prior_mean_change"] for r in got] == [None, None, 2, 0.5]


def test_future_rows_have_no_target(spark):
    got = ops.future_rows(history(spark), ["s"]).where("year = 2024").collect()
    assert [(r.s, r.target) for r in got] == [("series-a", None)]


def test_null_group_keys_match(spark):
    df = spark.createDataFrame([(None, 2000, 1.0), (None, 2001, 2.0), ("x", 2001, 5.0)], "g string, year int, target double")
    got = {(r.g, r.year): (r.p_mean, r.p_size) for r in ops.previous_year_group(df, ["g"], "p").collect()}
    assert got == {(None, 2000): (None, None), (None, 2001): (1.0, 1), ("x", 2001): (None, None)}


def test_reasons_first_wins_and_duplicates(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, "c")], "k int, v int, n string")
    masks = {"big": F.col("v") > 4, "one": F.col("k") == 1}
    assert [r.r for r in df.select(gates.reasons(masks).alias("r")).collect()] == ["big|one", "big|one", None]
    assert sorted(r.n for r in gates.first_wins(df, ["k"], [F.col("v")]).collect()) == ["a", "c"]
    assert sorted(r.n for r in gates.duplicates(df, ["k"]).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="repeat"):
        gates.many_to_one(df, df, ["k"])


def test_conflicts_are_kept_apart(spark):
    pairs = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p")], "k string, v string")
    got = {r.k: (r.m, r.m_conflict) for r in lookup.conflict_safe(pairs, ["k"], "v", "m").collect()}
    assert got == {"x": (None, True), "y": ("p", False)}


def test_fold_equals_unicode_decomposition(spark):
    words = ["Đại học Sư phạm Ngữ văn", "Élève à l'École", "Straße Übergröße", "niño ñandú", "Công nghệ thông tin", ""]

    def want(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
        return s.replace("đ", "d")

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fold(F.col("w")).alias("f")).collect()
    assert {r.w: r.f for r in got} == {w: want(w) for w in words}


def test_bounds_labels_and_months(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.5,), (9.0,)], "x double")
    assert [r.c for r in df.select(exprs.clip(F.col("x"), 0, 1).alias("c")).collect()] == [None, 0.0, 0.5, 1.0]
    got = spark.createDataFrame([("2 Years",), ("6 months",), ("none",), ("soon",)], "t string").select(exprs.months(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == [24, 6, 0, None]


def test_sequence_ratio(spark):
    pairs = [("đại học a", "dai hoc a"), ("abc", "abd"), (None, "x")]
    got = spark.createDataFrame(pairs, "a string, b string").select(similarity.sequence_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [None if a is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_csv_keeps_text_as_it_is(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c', ""), ("2", "x\ny", "z")], "k string, v string, e string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.columns).drop(files.BAD).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="header"):
        files.check_header(spark, str(tmp_path / "c"), ["k", "v"])


def test_exact_median_imputation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "x double")
    ready = regression.prepare(df, ["x"], [])
    assert ready.names == ["x", "x_missing"]
    assert [tuple(r.features.toArray()) for r in ready.model.transform(df).collect()] == [(1.0, 0.0), (2.0, 0.0), (10.0, 0.0), (2.0, 1.0)]
