"""A keyed store of vault entries: one parquet folder, one row for each (conversation, type, real value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "conv_id long, entity_type string, real string, surrogate string"


class VaultStore:
    """put appends; get reads what is stored last for each key. Values are copies both ways."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, entries: DataFrame) -> None:
        entries.select("conv_id", "entity_type", "real", "surrogate", F.current_timestamp().alias("put_at")).write.mode("append").parquet(self.path)

    def get(self, conversations: DataFrame | None = None) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA + ", put_at timestamp").parquet(self.path)
        if conversations is not None:
            rows = rows.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
        return rows.groupBy("conv_id", "entity_type", "real").agg(F.max_by("surrogate", "put_at").alias("surrogate"))
