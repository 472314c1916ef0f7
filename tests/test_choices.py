"""Validator, requests, searches and key levels on small rows worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gradus.functions.requests import request_errors, user_score
from gradus.operators import lookup, validate
from gradus.plans import choices, exams, registry
from gradus.sources import files

registry.load()
COLUMNS = ("SBD", "Nam", "Tinh", "SBD_New", "MaMonNgoaiNgu", *exams.RAW)
GOOD = {"SBD": "02034517", "Nam": "2023", "Tinh": "02", "SBD_New": "34517", "Toan": "7.20", "NguVan": "6.5", "NgoaiNgu": "9", "MaMonNgoaiNgu": "n3", "TongDiem": "22.7", "KhoiD": "22.70"}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []),
        ({"VatLy": "0", "HoaHoc": "5", "SinhHoc": "1", "TongDiem": "28.7"}, []),  # a blank average isn't checked
        ({"Toan": "11", "TongDiem": "26.5", "KhoiD": "26.5"}, ["Toan:ngoai_khoang_0_10"]),
        ({"Toan": "x", "TongDiem": "15.5", "KhoiD": ""}, ["Toan:khong_phai_so"]),
        ({"Toan": "NaN", "TongDiem": "", "KhoiD": ""}, ["Toan:so_khong_huu_han"]),
        ({"KhoiD": "22.72"}, ["KhoiD:sai_cong_thuc"]),
        ({"KhoiD": "22.71"}, []),
        ({"TongDiem": "91"}, ["TongDiem:ngoai_khoang_0_90", "TongDiem:sai_tong_cac_mon"]),
        ({"MaMonNgoaiNgu": "N8"}, ["MaMonNgoaiNgu:khong_hop_le"]),
        ({"MaMonNgoaiNgu": ""}, ["MaMonNgoaiNgu:khong_dong_bo_diem_ngoai_ngu"]),
        ({"SBD": "12x"}, ["SBD:khong_hop_le", "SBD:khong_du_8_chu_so"]),
        ({"SBD": "123456789"}, ["SBD:vuot_qua_8_chu_so", "SBD:khong_du_8_chu_so"]),
        ({"Tinh": "5", "SBD_New": "7"}, ["Tinh:khong_khop_SBD", "SBD_New:khong_khop_SBD"]),
        ({"Nam": "2022"}, ["Nam:khong_khop_nam_file"]),
    ],
)
def test_validator(spark, change, want):
    row = {c: "" for c in COLUMNS} | GOOD | change
    df = spark.createDataFrame([tuple(row[c] for c in COLUMNS)], list(COLUMNS))
    assert df.select(validate.codes(exams.RULES).alias("c")).first().c == want


A00 = {"A00": ("toan", "vatly", "hoahoc"), "D01": ("toan", "nguvan", "ngoaingu")}


def test_requests():
    good = {"combination": " a00 ", "scores": {"toan": 8.5, "vatly": 8.0, "hoahoc": 7.5, "nguvan": 10}, "interests": ["x"]}
    assert request_errors(good, A00) == [] and user_score(good, A00) == 24.0
    assert len(request_errors({"combination": "A00", "scores": {"toan": 1}}, A00)) == 2
    assert request_errors({"combination": "A00", "scores": {}}, A00) == [("scores", "missing")]
    assert request_errors(good | {"interests": ["a", "b", "c"]}, A00) == [("interests", "too many")]
    assert request_errors(good | {"interests": ["a", " "]}, A00) == [("interests", "blank")]
    assert request_errors(good | {"interests": "a"}, A00) == [("interests", "not a list")]
    assert len(request_errors({"combination": "D01", "scores": {"toan": 11, "nguvan": 5}}, A00)) == 2
    assert [f for f, _ in request_errors({}, A00)] == ["combination", "scores"]
    assert request_errors(good | {"scores": ["toan"]}, A00) == request_errors(good | {"scores": "toan"}, A00) == [("scores", "not a mapping")]
    assert request_errors(good | {"combination": None}, A00) == [("combination", "unsupported")]


def test_search_bounds():
    assert choices.Search(page="-3", limit="2").bounds() == (1, 5)
    assert choices.Search(page="x", limit="1000").bounds() == (1, 100)
    assert choices.Search(page="4", limit="").bounds() == (4, 15)
    assert [choices.Search(page=p).bounds()[0] for p in ("+-5", "--3", "²", "1.5", "", " +7 ", "9" * 40)] == [1, 1, 1, 1, 1, 7, choices.LAST_PAGE]


def test_pages_without_rows_and_deep_ones(spark, monkeypatch):
    rows = [(i, "A00", "Steel", i % 3 == 0, float(i % 7), "s", f"name {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, combination string, `group` string, is_scale_40 boolean, cutoff double, school string, name string")
    page = lambda **how: [(r.id, r.total, r.pages) for r in choices.search_page(df, choices.Search(**how), ["name"]).collect()]
    assert page(page="99999999999") == [(None, 60, 4)] == page(page="9" * 30)
    assert page(q="nothing") == [(None, 0, 1)]
    shallow = page(page="3", limit="20")
    monkeypatch.setattr(choices, "TOP_ROWS", 10)
    assert sorted(page(page="3", limit="20")) == sorted(shallow) and len(shallow) == 20


def option(**more):
    base = {"nation": 1, "segment": "a", "cutoff": 20.0, "predicted": None, "is_scale_40": False, "fit": 0.0, "salary": None, "postings": None, "years_observed": 3, "std": 1.0, "ambiguous": False}
    return tuple((base | more).values())


OPTION = "nation int, segment string, cutoff double, predicted double, is_scale_40 boolean, fit double, salary double, postings double, years_observed int, std double, ambiguous boolean"


def test_recommendation(spark):
    rows = [option(), option(nation=2, fit=1.0), option(nation=3, ambiguous=True), option(nation=4, is_scale_40=True), option(nation=5, predicted=25.5), option(nation=6, predicted=24.0, fit=0.5), option(nation=7, cutoff=None)]
    df = spark.createDataFrame(rows, OPTION)
    got = {r.nation: r for r in choices.recommend(df, 22.0, False).collect()}
    assert got.keys() == {1, 2, 3, 6}  # 5 is over three points away, 4 on another scale, 7 has no cutoff
    assert got[1].score == pytest.approx(100 * (0.40 + 0.25 * 0.5 + 0.20 * 0.5 + 0.15 * 0.5), abs=0.06) == got[3].score
    assert (got[6].bucket, got[6].gap) == ("reach", -2.0)
    got = {r.nation: r for r in choices.recommend(df, 22.0, True).collect()}
    assert got.keys() == {2, 6}  # only those that meet an interest
    assert got[2].score == pytest.approx(100 * (0.35 + 0.20 + 0.20 * 0.5 + 0.15 * 0.5 + 0.10 * 0.5), abs=0.06)
    none = choices.response(choices.recommend(df, 0.0, False), [0.0]).first()
    assert (none.total, none.safe, none.message) == (0, 0, choices.NOTHING_FOUND)
    assert choices.response(choices.recommend(df, 22.0, False), [22.0]).first().message is None


def test_first_level_that_exists_wins(spark):
    past = spark.createDataFrame(
        [(2023, "a ", "x", "1", 20.0), (2023, "A", "x", "2", 21.0), (2022, "a", "y", "1", 18.0), (2021, "a", "x", "1", None), (2021, "a", "y", "1", 15.0)],
        "year int, k string, m string, n string, v double",
    )
    base = spark.createDataFrame([(1, "a", "x", "1", 22.0), (2, "A", "x", "9", 22.0), (3, None, "x", "1", 22.0)], "id int, k string, m string, n string, v double")
    got = {r.id: r for r in lookup.cascade(base, past, [["k", "m", "n"], ["k", "m"], ["k"]], "v", "year", (2021, 2022, 2023), "s").collect()}
    assert (got[1].s2023, got[1].s2022, got[1].s2021, got[1].ambiguous) == (20.0, 18.0, None, False)  # 2021 exists at the finest level, without a value
    assert (got[2].s2023, got[2].s2022, got[2].ambiguous) == (None, 18.0, True)  # two values at the second level
    assert (got[3].s2023, got[3].s2022, got[3].ambiguous) == (None, None, False)
    wide = lookup.recent_trend(lookup.cascade(base, past, [["k", "m", "n"], ["k", "m"], ["k"]], "v", "year", (2021, 2022, 2023), "s"), "v", ["s2021", "s2022", "s2023"])
    got = {r.id: r for r in wide.collect()}
    assert (got[1].years_observed, got[1].avg_recent, got[1].std_recent, got[1].trend) == (3, 20.0, 1.63, "up")
    assert (got[2].avg_recent, got[2].std_recent, got[2].trend) == (22.0, None, "unknown")
    assert (got[3].years_observed, got[3].avg_recent, got[3].std_recent, got[3].trend) == (1, 22.0, None, "unknown")


def test_typed_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", date(2024, 1, 2)), (2, None, None)], "k int, v string, d date")
    files.export(df, str(tmp_path / "x"))
    assert sorted(files.read_typed_csv(spark, str(tmp_path / "x/csv"), df.schema).collect()) == sorted(df.collect())
    assert spark.read.schema(df.schema).json(str(tmp_path / "x/json")).count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.csv").write_text("k,v,d\nx,y,2024-01-01\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_typed_csv(spark, str(tmp_path / "bad"), df.schema).collect()
    files.write_report(df.select("k", "v"), str(tmp_path / "r"))
    assert files.read_json(spark, str(tmp_path / "r"), "k int, v string").orderBy("k").collect() == df.select("k", "v").orderBy("k").collect()
    rows = files.read_jdbc(spark, "jdbc:none://x", "select 1", lambda: df).collect()
    assert rows == df.collect()


def test_stream_drops_repeats(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = {r.event_type: r.n for r in registry.QUERIES["stream_dedup_agg"](spark, sf).collect()}
    assert got == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_malformed_rows_are_marked(spark):
    df = registry.QUERIES["csv_roundtrip"](spark, "/root/testdata/sf0.001")
    assert [tuple(r) for r in df.where("bad = 1").collect()] == [("one", "two", "three", 1)]
    assert df.where(F.col("bad") == 0).count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
