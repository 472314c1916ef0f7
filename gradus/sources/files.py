"""File sources and sinks: string-typed CSV, JSON, canonical tables, cached results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_corrupt_record"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors share; a temporary one of the application if none is named on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='gradus-')}"
        base = _OWN[app]
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back: computed once, whatever reads it."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_schema(columns: list[str], keep_bad: bool = False) -> StructType:
    return StructType([StructField(c, StringType()) for c in [*columns, *[BAD] * keep_bad]])


def read_csv(spark: SparkSession, path: str, columns: list[str], keep_bad: bool = True, line_breaks: bool = True) -> DataFrame:
    """All columns as text; empty stays empty; rows of another arity keep their line in BAD; a byte-order mark is no text.

    line_breaks: fields may hold them; without, a large file is split among tasks.
    """
    reader = spark.read.schema(text_schema(columns, keep_bad)).option("header", True).option("escape", '"').option("multiLine", line_breaks)
    df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(path)
    return df.na.fill("", columns)  # CSV has no null; an empty field is the empty text


def read_typed_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Columns by a declared schema, never inferred; a value of another type fails the read."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents that span lines, by a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON document of rows; for tables of a few rows."""
    rows = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def export(df: DataFrame, path: str, url: str | None = None, name: str | None = None) -> None:
    """The same rows as CSV and JSON and, with a url, as a table that is emptied and filled again."""
    write_csv(df, f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")
    if url:
        write_jdbc(df, url, name)


def check_header(spark: SparkSession, path: str, columns: list[str]) -> None:
    """Raise unless the header has exactly these columns in this order."""
    found = spark.read.option("header", True).csv(path).columns
    if found != columns:
        raise ValueError(f"header {found} isn't {columns}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """A stored result if a whole one exists, else built, stored and read.

    It is written beside its place and moved there when it is whole; of several builders at
    once the first to move stays.
    """
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at(f"{path}/_SUCCESS")):
        part = f"{path}-{uuid.uuid4().hex}"
        build().write.parquet(part)
        if not files.rename(at(part), at(path)) or not files.exists(at(f"{path}/_SUCCESS")):
            files.delete(at(part), True)
    return spark.read.parquet(path)


def _unreachable(spark: SparkSession, error: Exception) -> bool:
    """Whether a driver is missing or a server can't be reached (SQL state class 08), by the exceptions' classes."""
    java = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    of_database = spark.sparkContext._jvm.java.lang.Class.forName("java.sql.SQLException")
    while java is not None:
        name = java.getClass().getName()
        if name in ("java.lang.ClassNotFoundException", "java.net.ConnectException", "java.net.UnknownHostException"):
            return True
        if of_database.isInstance(java) and str(java.getSQLState() or "").startswith("08"):
            return True
        java = java.getCause()
    return False


def read_jdbc(spark: SparkSession, url: str, statement: str, fallback, **options) -> DataFrame:
    """A query's rows over JDBC, read once; the fallback's if the server can't be reached or there are none.

    Only missing drivers and failed connections count as that; a wrong statement raises.
    options: Spark's, such as driver, user, password, fetchsize.
    """
    try:
        df = store(spark.read.format("jdbc").options(url=url, query=statement, **options).load(), "jdbc-rows")
    except Exception as error:
        if _unreachable(spark, error):
            return fallback()
        raise
    return fallback() if df.isEmpty() else df


def write_jdbc(df: DataFrame, url: str, name: str, **options) -> None:
    """The rows as a table's only ones: it is made if there is none, and emptied if there is one.

    Where the database's dialect can't empty it in place, Spark makes it anew.
    """
    df.write.format("jdbc").options(url=url, dbtable=name, truncate=True, **options).mode("overwrite").save()


def read_numbered_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns with source_file and source_row, the row's number in its file (the header's is 1).

    A split is read by one task in its order, so rows are numbered within their split, and the
    rows of earlier splits of the file, of which there is a row a split, are added.
    Fields hold no line breaks.
    """
    reader = spark.read.schema(text_schema(columns)).option("header", True).option("escape", '"')
    df = reader.csv(path).na.fill("", columns)
    place = {"source_file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__row": F.monotonically_increasing_id()}
    rows = store(df.select("*", *[c.alias(n) for n, c in place.items()]), "numbered-rows")
    splits = rows.groupBy(F.col("source_file").alias("__file"), F.col("__start").alias("__at")).agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    earlier = Window.partitionBy("__file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    joined = rows.join(splits, (F.col("source_file") == F.col("__file")) & (F.col("__start") == F.col("__at")))
    return joined.select(*df.columns, "source_file", (F.col("__before") + F.col("__row") - F.col("__first") + 2).alias("source_row"))


def without_personal(df: DataFrame, names=("SBD", "sbd")) -> DataFrame:
    return df.drop(*names)


def roundtrip(df: DataFrame) -> DataFrame:
    """Rows written as CSV with a malformed line beside them, read back, written as JSON and read back.

    bad is 1 for rows that the CSV reader marked.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, "roundtrip")
    write_csv(df, f"{path}/csv")
    broken = spark.createDataFrame([(",".join(df.columns),), ("one,two,three,four,five,six",)], "value string")
    broken.coalesce(1).write.mode("append").text(f"{path}/csv")
    check_header(spark, f"{path}/csv", df.columns)
    back = read_csv(spark, f"{path}/csv", df.columns, line_breaks=False)
    back.withColumn("bad", F.col(BAD).isNotNull().cast("int").cast("string")).drop(BAD).write.json(f"{path}/json")
    again = spark.read.schema(text_schema([*df.columns, "bad"])).json(f"{path}/json")
    return again.withColumn("bad", F.col("bad").cast("int"))
