"""Folders for tables that a plan writes on its way: shared by all executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in local mode without that setting, in a temporary folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        if spark.sparkContext.master.startswith("local["):
            named = "file://" + (made := tempfile.mkdtemp(prefix="spanloom-"))
            atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
