"""Running counters over a stream of records, saved after each trigger."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a folder of our own only in local runs without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def counters(records: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, least and most of value per key; the state is one row per key."""
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("requests"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def windowed(records: DataFrame, ts: str, key: str, every: str, late: str) -> DataFrame:
    """Counts per key and window of event time; records later than `late` are left out, so old state goes."""
    return records.withWatermark(ts, late).groupBy(F.window(ts, every), key).agg(F.count(F.lit(1)).alias("requests"))


def saved(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a complete-mode aggregation over all that is there and return what the last trigger saved.

    Each trigger overwrites a table of its own number, so a repeated one after a failure saves the same rows.
    """
    top = state_dir(spark)
    last: list[int] = []

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{top}/table-{batch}")
        last[:] = [batch]

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{top}/log").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    if not last:  # nothing arrived
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{top}/table-{last[0]}")


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet file or folder at path; as a pattern, since a stream's plain path must be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
