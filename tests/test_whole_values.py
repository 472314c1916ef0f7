"""Queries on small tables of their own, against plain Python over whole values."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gradus.functions import exprs
from gradus.plans import registry

registry.load()
TAIL = "Đại học Été [x]  of the ÑANDÚ_9"
TEXTS = {1: "a" * 300 + " one " + TAIL, 2: "a" * 300 + " two " + TAIL, 3: "Short\t é", 4: "", 5: None, 6: "x\n" * 5000 + TAIL}


@pytest.fixture
def store(spark, tmp_path):
    """A function that writes a table and gives its folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def plain_fold(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)).replace("đ", "d")


def test_normalisers_take_the_whole_text(spark, store):
    at = store("documents", [*TEXTS.items()], "doc_id bigint, text string")
    got = {n: {r.doc_id: r for r in registry.QUERIES[n](spark, at).collect()} for n in ("fold_text", "slug_key", "normaliser_variants", "nfkc_whitespace")}
    assert got["slug_key"][1].slug != got["slug_key"][2].slug
    for i, t in TEXTS.items():
        f = None if t is None else plain_fold(t)
        slug = None if t is None else re.sub("[^a-z0-9]+", " ", f).strip()
        assert got["fold_text"][i].folded == f
        assert got["slug_key"][i].slug == (slug or None)
        variants = got["normaliser_variants"][i]
        assert variants.collapsed == slug
        assert variants.kept_runs == (None if t is None else re.sub(r"[^a-z0-9\s]", " ", f).strip(" "))
        assert variants.ascii == (None if t is None else re.sub(r"\s+", " ", plain_fold(t.lower().replace("đ", "")).encode("ascii", "ignore").decode()).strip())
        assert variants.named == (None if t is None else re.sub(" +", " ", re.sub("(^| )(the|of) ", " ", slug)).strip())
        assert got["nfkc_whitespace"][i].collapsed == (None if t is None else re.sub(r"\s+", " ", t).strip())


def test_nfkc_normalises(spark, store):
    texts = ["Ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne ﬂow", "x² ½ ①", "e\u0301te\u0301", "\u00a0 a\u2003\u2028b \x1c", None, "", "plain " * 200 + "ﬁ"]
    at = store("documents", [*enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.collapsed for r in registry.QUERIES["nfkc_whitespace"](spark, at).collect()}
    assert got == {i: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip() for i, t in enumerate(texts)}
    assert got[0] == "Full width" and got[1] == "fine flow" and got[3] == "été"


def test_attribution_covers_all_users(spark, store):
    rows = [(u, k, float(u * 3 + len(k))) for u in (1, 2, 19, 20, 501) for k in ("view", "click") for _ in range(u % 3 + 1)]
    at = store("events", rows, "user_id bigint, event_type string, value double")
    mean = lambda it: (lambda x: sum(x) / len(x))([*it])
    got = {(r.user_id, r.event_type): r.attribution for r in registry.QUERIES["attribution_vs_mean"](spark, at).collect()}
    assert got.keys() == {r[:2] for r in rows}
    for u, k in got:
        assert got[u, k] == pytest.approx(mean(v for x, y, v in rows if (x, y) == (u, k)) - mean(v for _, y, v in rows if y == k), abs=1e-4)


def test_limits_are_the_references(spark, store):
    at = store("conversations", [(1, t, "user", "é" * 1500) for t in range(8)], "conv_id bigint, turn int, role string, text string")
    assert [len(r.text) for r in registry.QUERIES["last_n_history"](spark, at).collect()] == [1000] * 6
    spark.range(9000).selectExpr("id AS o_orderkey").write.parquet(f"{at}/orders.parquet")
    assert registry.QUERIES["deterministic_sample"](spark, at).count() == 8000
    assert registry.QUERIES["top_groups_metrics"](spark, "/root/testdata/sf0.001").count() == 5  # all segments, of at most ten


def test_weighted_mean_has_no_cap_of_event_types(spark, store):
    rows = [(i, f"type{i % 70:02}", float(i), "2024-01-01") for i in range(700)]
    df = spark.createDataFrame(rows, "user_id bigint, event_type string, value double, day string").selectExpr("user_id", "event_type", "value", "timestamp(day) AS ts")
    at = store("unused", [(1,)], "x int")
    df.write.parquet(f"{at}/events.parquet")
    got = {r.subject: (r.n, r.weighted_mean) for r in registry.QUERIES["weighted_mean_long"](spark, at).collect()}
    assert got == {f"type{k:02}": (10, k + 315.0) for k in range(70)}


def test_scores_that_end_in_a_half_are_rounded_as_in_sql(spark, store):
    import duckdb

    halves = [k / 100 for k in range(5, 12_000, 10)]
    rows = [(303 * i + j, 11 * i + j, v) for i, v in enumerate([*halves, None, 64.85, 100.04, 100.05]) for j in range(3)]
    rows.append((5, 8, 64.85))  # 15 is 0.01 over 6.49 + 0.5 + 8, but 0.02 over 6.48 + 0.5 + 8
    at = store("events", rows, "event_id bigint, user_id bigint, value double")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{at}/events.parquet/*.parquet'")
    want = dict(con.sql(registry.ORACLE["row_validator_codes"]).fetchall())
    got = {r.event_id: r.codes for r in registry.QUERIES["row_validator_codes"](spark, at).collect()}
    assert {k: (v, got.get(k)) for k, v in want.items() if v != got.get(k)} == {} and len(got) == len(want)
    near = [(x,) for x in (6.484999999999999, 1.005, 2.675, -2.5, -6.484999999999999, 0.49999999999999994, 1e17, 0.0)]
    rounded = {r.x: r.y for r in spark.createDataFrame(near, "x double").select("x", exprs.round_binary(F.col("x"), 2).alias("y")).collect()}
    assert rounded == {x: con.sql(f"select round({x!r}::DOUBLE, 2)").fetchall()[0][0] for (x,) in near}
