"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillspark.operators.merge import latest, upsert
from quillspark.schema import PAPERS
from quillspark.sources.shared import work_dir


def latest_per_key(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """Final state of a stream of files: the row of the highest order for each key.

    Each micro-batch is merged with the state written by the last; batch numbers name the versions, so
    a batch that is run again overwrites its own version and the result stays exactly once.
    """
    base = work_dir(spark, "stream")
    schema = spark.read.parquet(path).schema
    where = path if os.path.isdir(path) else os.path.dirname(path)
    names = "*" if os.path.isdir(path) else os.path.basename(path)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(where)

    def merge(batch: DataFrame, number: int) -> None:
        now = batch.select(key, order)
        if number > 0:
            now = now.unionByName(batch.sparkSession.read.parquet(f"{base}/state-{number - 1}"))
        now.groupBy(key).agg(F.max(order).alias(order)).write.mode("overwrite").parquet(f"{base}/state-{number}")

    job = rows.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").start()
    job.awaitTermination()
    last = max((p["batchId"] for p in job.recentProgress if p["numInputRows"] > 0), default=0)
    return spark.read.parquet(f"{base}/state-{last}").select(order, key)


def ingest(spark: SparkSession, feed: DataFrame, table_path: str, checkpoint: str, key: str = "arxiv_id", at: str = "seen_at", late: str = "7 days", buckets: int = 64) -> DataFrame:
    """Upsert a streaming feed of records into a table, dropping repeats within the allowed lateness; the table.

    The table is partitioned by a bucket of the key, and a micro-batch rewrites only the buckets it
    touches. An upsert that is repeated changes nothing, so a batch that is run again, and a stream that
    starts over with a new checkpoint, leave the table as it should be.
    """
    names = [n for n in PAPERS.names if n != "bucket"]
    schema = StructType([*[PAPERS[n] for n in names], StructField("bucket", IntegerType())])
    spark.createDataFrame([], PAPERS).write.mode("ignore").parquet(f"{table_path}/bucket=-1")
    unique = feed.withWatermark(at, late).dropDuplicatesWithinWatermark([key])

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = latest(batch, key, [at]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # as many as there are buckets at most
        if touched:
            table = session.read.schema(schema).parquet(table_path).where(F.col("bucket").isin(touched))
            merged = upsert(table.drop("bucket"), fresh.drop("bucket")).drop("action").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            merged.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(table_path)
        fresh.unpersist()

    unique.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()
    return spark.read.schema(schema).parquet(table_path).where("bucket >= 0").drop("bucket")
