"""What the operators of this subpackage share: folders, materialised tables, names."""

from __future__ import annotations

import os
import tempfile
import uuid
from bisect import bisect_right
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words in every contract of this subpackage.
SPACE = r"\x20\x09-\x0D"

_OWN: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where a session of one machine names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='gradus-')}"
    return _OWN[app]


def shared_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    remove(df.sparkSession, df.written_to)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows an Arrow batch for the jobs run inside, as texts are long; restored after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def exact(df: DataFrame, name: str) -> Column:
    """A column by its exact name, even when others differ only in case or hold dots."""
    hits = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
    return F.col(f"`{hits[0]}`")


def open_fs(uri: str):
    """pyarrow file system and path of a URI that executors share."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def word_split(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; null and blank texts give none."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) > 0, F.split(inner, r"[ \t-\r]+")).otherwise(
        F.array().cast("array<string>")
    )


def broadcast_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A broadcast hint for a written table of at most so many narrow rows; else the table as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clear_of(taken: list[tuple[int, int]]):
    """A function that tells whether a span (start, end) meets none of those taken, which may meet one another."""
    starts, ends = [], []
    for a, b in sorted(taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def clear(start: int, end: int) -> bool:
        i = bisect_right(ends, start)
        return i == len(ends) or end <= starts[i]

    return clear
