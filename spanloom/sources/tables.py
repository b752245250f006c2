"""Reading the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table. A file with a single row group is one task however many cores there are, so a table of fewer files
    than cores that would keep most of them idle is dealt out once; larger tables are left as they are."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) < cores and rows.rdd.getNumPartitions() <= 2 * cores:
        return rows.repartition(cores)
    return rows
