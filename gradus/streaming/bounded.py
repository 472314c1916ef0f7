"""Bounded streams: file source, de-duplication by id and a complete-mode aggregate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import work_dir


def dedup_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of events by type, each event_id once, as one available-now run.

    State holds every id, as the batch form's shuffle would; a watermark would bound it.
    """
    name = f"dedup_{uuid.uuid4().hex}"
    # The stream repeats: every third event arrives again, as a source that delivers at least once may do.
    events, path = spark.read.parquet(f"{sf_dir}/events.parquet"), work_dir(spark, "arrivals")
    events.write.parquet(path)
    events.where("event_id % 3 = 0").write.mode("append").parquet(path)
    reader = spark.readStream.schema(events.schema).parquet(path)
    totals = reader.dropDuplicates(["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    run = totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", work_dir(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("event_type", "n", F.round("total", 2).alias("total"))
