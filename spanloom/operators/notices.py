"""Notices of what was not looked at: a result is never silently empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons that a model engine may give itself; the other ones are facts of the pipeline.
ENGINE_REASONS = ["failed-closed", "call-budget-exhausted"]


def absent(messages: DataFrame, tier: str) -> DataFrame:
    """One notice a message for a tier that is switched off."""
    return messages.select("doc_id", F.lit(tier).alias("tier"), F.lit("absent").alias("reason"))


def unjudged(messages: DataFrame, judged: DataFrame, tier: str = "tier2") -> DataFrame:
    """Messages with a declared scope that no judgment covered."""
    return messages.join(judged, "doc_id", "left_anti").select("doc_id", F.lit(tier).alias("tier"), F.lit("scope-unjudged").alias("reason"))


def from_engine(notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, refused) notices of an engine."""
    ok = F.col("reason").isin(ENGINE_REASONS)
    return notices.where(ok), notices.where(~ok)
