"""Folders that all executors share, small JSON objects in them, and tables kept there between steps."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str = "work") -> str:
    """A fresh folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix=f"quillspark-{name}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def materialised(df: DataFrame) -> DataFrame:
    """The rows written once and read back, for plans that use them more than once and must see the same rows in the same partitions."""
    path = f"{work_dir(df.sparkSession, 'rows')}/t"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON object as a folder of one text file, by way of Spark's file systems."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, default: dict) -> dict:
    """The object of a folder; the default if it is missing or unreadable."""
    try:
        rows = spark.read.text(path, wholetext=True).take(1)
        got = json.loads(rows[0].value) if rows else default
        return got if isinstance(got, dict) else default
    except (AnalysisException, ValueError):
        return default
