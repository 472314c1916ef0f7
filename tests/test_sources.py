"""Databases, numbered files, strict parsing and byte-order marks."""

import pytest
from pyspark.sql import functions as F

from gradus.operators import gates
from gradus.sources import files

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture
def base(tmp_path):
    return f"jdbc:derby:{tmp_path}/db;create=true"


def test_a_table_is_filled_again_and_read(spark, base):
    df = spark.createDataFrame([(1, "đ", 2.5), (2, None, None)], "id int, name string, pay double")
    for rows in (df, df.where("id = 2"), df):  # each time the table holds the last rows alone
        files.write_jdbc(rows, base, "jobs", **DRIVER)
        got = files.read_jdbc(spark, base, 'SELECT "id", "name", "pay" FROM jobs', lambda: None, **DRIVER)
        assert sorted(got.collect(), key=str) == sorted(rows.collect(), key=str)
    assert files.read_jdbc(spark, base, 'SELECT "id" FROM jobs WHERE "id" > 5', lambda: df, **DRIVER).count() == 2  # none: the fallback's
    with pytest.raises(Exception, match="NOWHERE|nowhere"):
        files.read_jdbc(spark, base, "SELECT x FROM nowhere", lambda: df, **DRIVER)


def test_export_to_a_database(spark, base, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    for _ in range(2):
        files.export(df, str(tmp_path / "out"), base, "exported")
    assert files.read_jdbc(spark, base, "SELECT * FROM exported", lambda: None).count() == 1


@pytest.mark.parametrize("url", ["jdbc:none://x", "jdbc:derby://localhost:1/x"])
def test_fallback_where_nothing_answers(spark, url):
    assert files.read_jdbc(spark, url, "select 1", lambda: spark.range(4)).count() == 4


def test_rows_are_numbered_in_their_files(spark, tmp_path):
    want = {}
    for name, n in (("a.csv", 3000), ("b.csv", 1), ("c.csv", 0), ("d é.csv", 700)):
        lines = [f'{name},"v, {i}"' for i in range(n)]
        (tmp_path / name).write_text("\n".join(["file,value", *lines]) + "\n")
        want |= {(name, f"v, {i}"): i + 2 for i in range(n)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # many splits a file, several files a task
    try:
        df = files.read_numbered_csv(spark, str(tmp_path), ["file", "value"])
        assert {(r.file, r.value): r.source_row for r in df.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_strict_parsing_names_five_values(spark):
    df = spark.createDataFrame([(str(i), "yes") for i in range(20)] + [("", "No"), (None, " FALSE ")], "x string, y string").coalesce(1)
    got = gates.strictly(df, {"x": "double", "y": "boolean"}, "table").collect()
    assert [r.x for r in got] == [*map(float, range(20)), None, None] and [r.y for r in got] == [True] * 20 + [False] * 2
    bad = df.unionByName(spark.createDataFrame([(f"x{i}", "1") for i in range(9)], "x string, y string").coalesce(1))
    with pytest.raises(Exception, match=r"table: x has values that aren't double: \['x0', 'x1', 'x2', 'x3', 'x4'\]"):
        gates.strictly(bad, {"x": "double", "y": "boolean"}, "table").collect()
    with pytest.raises(Exception, match="y has values that aren't boolean: \\['maybe'\\]"):
        gates.strictly(df.withColumn("y", F.when(F.col("x") == "3", "maybe").otherwise("1")), {"y": "boolean"}, "table").collect()


def test_byte_order_mark_and_personal_columns(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿SBD,Toán\n1,2\n".encode())
    files.check_header(spark, str(tmp_path), ["SBD", "Toán"])
    rows = files.read_csv(spark, str(tmp_path), ["SBD", "Toán"])
    assert [(r.SBD, r["Toán"]) for r in rows.collect()] == [("1", "2")]
    assert files.without_personal(rows).columns == ["Toán", files.BAD]
