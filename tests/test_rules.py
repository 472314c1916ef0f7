"""Rules, identities and upkeep on rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from gradus.functions import rules
from gradus.operators import identity
from gradus.plans import upkeep


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("method", "score", "scale", "thirty"),
    [("THPTQG", 27.5, "30", 27.5), ("THPTQG - Thang 40", 31.3, "40", 23.48), ("THPTQG - Thang 40", 30.7, "40", 23.02), ("DGTD", 60.0, "100", None), ("Học bạ", 28.0, "Biến thiên", None), ("else", 5.0, "Khác", None), (None, 5.0, "Khác", None)],
)
def test_scales(spark, method, score, scale, thirty):
    m = F.lit(method).cast("string")
    assert one(spark, rules.scale(m)) == scale and one(spark, rules.score_30(F.lit(score), m)) == thirty
    assert one(spark, rules.checked_scale(F.lit(scale), F.coalesce(m, F.lit("")))) == scale


def test_a_wrong_scale_stops_the_job(spark):
    with pytest.raises(Exception, match="national exam with scale 100"):
        one(spark, rules.checked_scale(F.lit("100"), F.lit("THPTQG")))


@pytest.mark.parametrize(("text", "want"), [("27,5", 27.5), (" 3.25 ", 3.25), ("x", None), ("", None), (None, None), ("1,2,3", None)])
def test_numbers_with_a_comma(spark, text, want):
    assert one(spark, rules.as_number(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("name", "group", "want"),
    [
        ("Công nghệ thông tin (CLC)", None, ("it", "major_name_keyword", "high")),
        ("Quản lý nhà nước", "", ("legal_hr", "major_name_keyword", "high")),
        ("Tâm lý", "Sức khỏe", ("legal_hr", "major_name_keyword", "medium")),
        ("Hóa học", "Mỏ, địa chất", ("agriculture", "major_group_rule", "medium")),
        ("Hóa học", "chưa rõ", None),
        (None, None, None),
    ],
)
def test_categories(spark, name, group, want):
    got = one(spark, rules.category(F.lit(name).cast("string"), F.lit(group).cast("string")))
    assert (got and tuple(got)) == want


def test_notes(spark):
    def read(note, of):
        return spark.range(1).select(*[c.alias(n) for n, c in of(F.lit(note).cast("string")).items()]).first().asDict()

    new = read("TTNV <= 2; tiếng anh x2; Phân hiệu  Bến Tre, nam", rules.note_features)
    assert new == {"doubled": "Tiếng Anh", "most_wanted": 2, "campus": "Bến Tre", "sex": "Nam", "review": False}
    assert read("nam, nữ", rules.note_features) == {"doubled": None, "most_wanted": None, "campus": None, "sex": None, "review": True}
    assert read(None, rules.note_features)["review"] is False
    old = read("VẼ MỸ THUẬT hệ số 1,5; chỉ tuyển  nữ", rules.old_note_features)
    assert old == {"subject": "VẼ MỸ THUẬT", "factor": 1.5, "sex": "Nữ", "quality": False, "review": False}
    assert read("chương trình CLC", rules.old_note_features)["quality"] and not read("clcx", rules.old_note_features)["quality"]
    assert read("thí sinh nam, thí sinh nữ", rules.old_note_features)["sex"] == "Cả hai"


@pytest.mark.parametrize(("raw", "want"), [(" MS  excel ", "Excel"), ("node-js 3d", "Node-Js 3D"), ("đàm PHÁN", "Đàm Phán"), ("c++", "C++")])
def test_skills(spark, raw, want):
    assert one(spark, rules.skill(F.lit(raw), rules.TECHNICAL)) == want


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Em 27,5 điểm khối a00", ("A00", 27.5)), ("Điểm 8 tổ hợp D01?", ("D01", 8.0)), ("30.5 điểm", ("C00", 20.0)), ("XA01 và B001", ("C00", 20.0)), ("điểm_30 B08", ("B08", 30.0)), ("được 25đ", ("C00", 25.0)), ("", ("C00", 20.0)),
    ],
)
def test_questions(spark, question, want):
    combination, score = rules.asked(F.lit(question), F.lit("C00"), F.lit(20.0))
    assert (one(spark, combination), one(spark, score)) == want


@pytest.mark.parametrize(("name", "code", "want"), [("Trường Đại học Y Dược TP. HCM", "x", "y duoc tphcm"), ("Đại học Luật Thành phố Hồ Chí Minh", "x", "luat tphcm"), ("Trường Đại Học", "YDS", "YDS"), (None, "a", "a")])
def test_institutions(spark, name, code, want):
    assert one(spark, rules.institution(F.lit(name).cast("string"), F.lit(code))) == want


def test_what_is_shown_is_the_newest_then_the_most_frequent(spark):
    rows = [("a", "x", 2020, 1), ("a", "x", 2020, 2), ("a", "y", 2023, 3), ("a", "z", 2023, 4), ("a", "z", 2021, 5), ("a", " ", 2024, 6), ("b", "p ", 2022, 7), ("b", "q", 2022, 8), ("c", None, 2022, 9)]
    df = spark.createDataFrame(rows, "k string, v string, year int, row int")
    assert {r.k: r.shown for r in identity.display(df, "k", "v", "row", "shown").collect()} == {"a": "z", "b": "p"}


def test_conflicts_are_told_apart(spark):
    base = {"code": "K", "name": "n", "gender": None, "campus": "1", "target": 20}
    groups = {
        "same": ([{}, {"target": 21}], "unresolved_conflicting_cutoffs"),
        "names": ([{}, {"name": "m", "target": 21}], "candidate_split_by_program_identity"),
        "campus": ([{}, {"campus": "2", "target": 21}], "candidate_split_by_gender_or_campus"),
        "mixed": ([{}, {"name": "m", "target": 21}, {"campus": "2", "target": 22}], "candidate_split_by_gender_or_campus"),
    }
    rows = [(k, *{**base, **r}.values(), identity.AMBIGUOUS) for k, (rs, _) in groups.items() for r in rs]
    df = spark.createDataFrame(rows, "k string, major_code string, major_normal string, gender string, campus string, target int, reason string")
    got = {r.k: (r.ambiguity_class, r.rows, r["values"]) for r in identity.ambiguous_groups(df, ["k"]).collect()}
    assert got == {k: (kind, len(rs), ";".join(sorted({str(r.get("target", 20)) for r in rs}))) for k, (rs, kind) in groups.items()}


def test_a_refresh_loses_nothing(spark):
    old = spark.createDataFrame([("a", "/a", "downloaded"), ("b", "/b", "generated_avatar"), ("c", "/c", "downloaded"), ("d", None, None)], "k string, asset string, status string")
    new = spark.createDataFrame([("a", "/a2", "generated_avatar"), ("b", "/b2", "downloaded_official_logo"), ("c", "", "downloaded_official_logo"), ("d", "/d2", "not_found"), ("e", "/e", "downloaded")], "k string, asset string, status string")
    got = lambda force: {r.k: r.asset for r in upkeep.refreshed(old, new, "k", force).collect()}
    assert got(False) == {"a": "/a", "b": "/b2", "c": "/c", "d": "/d2"}
    assert got(True) == {"a": "/a2", "b": "/b2", "c": "/c", "d": "/d2"}
