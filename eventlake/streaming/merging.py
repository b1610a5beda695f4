"""Intake of batches into a keyed Parquet table that reads only what a batch can touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import path_exists

LEDGER = "batch int, bucket int, least string, most string, n long, folders_read int"


def _ranges(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy("bucket").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.count("*").alias("n"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row for each batch and bucket that was merged: the range of its keys, its rows, and how many folders the batch
    read. Bucket -1 stands for a batch without new rows."""
    if not path_exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger")


def merged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table's rows of committed batches, with batch and bucket."""
    if not path_exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], f"{schema}, batch int, bucket int")
    rows = spark.read.schema(f"{schema}, batch int, bucket int").parquet(f"{path}/rows")
    return rows.join(ledger(spark, path).select("batch").distinct(), "batch", "left_semi")


def merge_batches(path: str, key: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds rows of unknown keys; of repeats within a batch one stays. Null keys are dropped.

    Rows lie in folders by batch and bucket of the key's hash, and a ledger has the least and the greatest key of each.
    A batch meets the ledger with its own ranges and reads just the folders that overlap, so keys that grow with time
    leave old folders unread however large the table is. A batch writes its rows first and its ledger rows last: one that
    is in the ledger is done and a replay does nothing; one that failed between is written over.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = batch.schema[key].dataType.simpleString()
        if kind not in ("bigint", "int", "string"):
            raise ValueError(f"keys of type {kind} have no range here")
        done = ledger(spark, path)
        if not done.filter(F.col("batch") == number).isEmpty():
            return
        rows = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        asked = _ranges(rows, key)
        old = done.select("batch", "bucket", F.col("least").cast(kind).alias("lo"), F.col("most").cast(kind).alias("hi"))
        touched = asked.join(old, "bucket").filter("lo <= most AND least <= hi").select("batch", "bucket").distinct().collect()  # names of folders
        fresh = rows
        if touched:
            paths = [f"{path}/rows/batch={t.batch}/bucket={t.bucket}" for t in touched]
            fresh = rows.join(spark.read.schema(batch.select(key).schema).parquet(*paths), key, "left_anti")
        fresh = fresh.persist()
        target = f"{path}/rows/batch={number}"
        fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        noted = _ranges(fresh, key).select(
            F.lit(number).alias("batch"), "bucket", F.col("least").cast("string").alias("least"), F.col("most").cast("string").alias("most"), "n", F.lit(len(touched)).alias("folders_read")
        )
        none = spark.createDataFrame([(number, -1, None, None, 0, len(touched))], LEDGER)
        (none if fresh.isEmpty() else noted.coalesce(1)).write.mode("append").parquet(f"{path}/ledger")
        fresh.unpersist()
        rows.unpersist()

    return merge


def start_merging(stream: DataFrame, path: str, key: str, checkpoint: str, every: str | None = "60 seconds", buckets: int = 16) -> StreamingQuery:
    """Merge a stream at most once in every; without it all that is there now, and then stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge_batches(path, key, buckets))
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
