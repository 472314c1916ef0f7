"""Interests, attached forecasts and stored results on small rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from gradus.functions import interests
from gradus.operators import forecasts
from gradus.sources import files


@pytest.mark.parametrize(
    ("name", "group", "asked", "want"),
    [
        ("Công nghệ thông tin", "", ["Công nghệ"], 1.0),  # another spelling of the interest
        ("Kế toán", "Máy tính và công nghệ thông tin", ["Công nghệ số"], 0.0),  # looked for in the name alone
        ("Hệ thống thông tin xây dựng", "", ["cong nghe"], 0.0),  # ruled out by the name
        ("Quản_trị khách sạn", None, ["Kinh doanh", "kinh doanh", " "], 1.0),
        ("Luật kinh tế", "", ["Kinh doanh", "Xã hội & cộng đồng"], 1.0),
        ("Luật", "kinh doanh", ["Kinh doanh", "Sáng tạo"], 0.5),
        ("Đồ gốm", "", ["đồ gốm"], 1.0),  # an interest that isn't known is its own word
        (None, None, ["Kinh doanh"], 0.0),
        ("Kế toán", "", [], 0.0),
    ],
)
def test_interests(spark, name, group, asked, want):
    df = spark.createDataFrame([(name, group)], "name string, `group` string")
    assert df.select(interests.fit(F.col("name"), F.col("group"), asked).alias("f")).first().f == want


def test_forecasts_are_attached_by_trimmed_keys(spark):
    options = spark.createDataFrame([(1, " 07 ", "A", 20.0), (2, "7", "A", 21.0), (3, None, "A", 22.0), (4, "07", "B", 23.0)], "id int, code string, combo string, cutoff double")
    features = spark.createDataFrame([("07", "A ", 2025, 5.0), ("07", "A", 2025, 6.0), ("", "A", 2025, 7.0)], "code string, combo string, forecast_year int, x double")
    predict = lambda f: f.withColumns({"predicted": F.col("x") * 2, "model_version": F.lit("v"), "is_cold_start": F.lit(False)})
    got = {r.id: r for r in forecasts.attach(options, features, ["code", "combo"], predict, "model", [F.desc("x")]).collect()}
    assert {i: (r.predicted, r.forecast_source, r.forecast_year) for i, r in got.items()} == {
        1: (12.0, "model", 2025), 2: (None, forecasts.FALLBACK, None), 3: (14.0, "model", 2025), 4: (None, forecasts.FALLBACK, None)
    }
    assert got[1].code == " 07 " and got[2].model_version is None and got[1].is_cold_start is False
    with pytest.raises(ValueError, match="lack the keys combo"):
        forecasts.attach(options.drop("combo"), features, ["code", "combo"], predict, "model", [F.desc("x")])


def test_a_stored_result_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/stored"
    assert files.read_or_build(spark, path, build).count() == files.read_or_build(spark, path, build).count() == 3
    assert len(built) == 1 and [p.name for p in tmp_path.iterdir()] == ["stored"]
