"""Sources and sinks: text tables with provenance, and bounded streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from ..sources import files
from ..streaming import bounded
from .registry import query, table


@query("""SELECT p_partkey::VARCHAR AS key, p_name || ', "x"' AS name, '' AS blank, 0 AS bad FROM part UNION ALL SELECT 'one', 'two', 'three', 1""")
def csv_roundtrip(spark, sf_dir):
    """Text columns written as CSV and JSON and read back unchanged, with a mark for bad rows."""
    cut = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.concat("p_name", F.lit(', "x"')).alias("name"), F.lit("").alias("blank"))
    return files.roundtrip(cut)


STREAM = """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1"""


@query(STREAM)
def stream_dedup_agg(spark, sf_dir):
    return bounded.dedup_agg(spark, sf_dir)


@query("""SELECT p_partkey % 5 AS file, p_partkey, p_name, row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) + 1 AS source_row FROM part""")
def csv_row_numbers(spark, sf_dir):
    """Parts written as several files, each in order, and read with the number of each row in its file."""
    path = files.work_dir(spark, "numbered")
    df = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("file"), "p_partkey", "p_name")
    df.repartition("file").sortWithinPartitions("file", "p_partkey").write.partitionBy("file").option("header", True).option("escape", '"').csv(path)
    back = files.read_numbered_csv(spark, path, ["p_partkey", "p_name"])
    file = F.regexp_extract("source_file", "/file=([0-9]+)/", 1).cast("bigint")
    return back.select(file.alias("file"), F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "source_row")


@query("""SELECT p_partkey, p_retailprice AS price, p_size % 2 = 0 AS even, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS size FROM part""")
def strictly_parsed(spark, sf_dir):
    """Numbers and truth values written as text in several forms, parsed by a gate that lets no other form pass."""
    even = F.when(F.col("p_size") % 2 == 0, F.when(F.col("p_size") % 3 == 0, " Yes").otherwise("TRUE")).otherwise("0 ")
    size = F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("string").alias("price"), even.alias("even"), size.alias("size"))
    return gates.strictly(df, {"price": "double", "even": "boolean", "size": "int"}, "part")
