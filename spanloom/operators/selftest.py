"""Scoring of self-test cases against what the detection plan finds in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(cases: DataFrame, resolved: DataFrame) -> DataFrame:
    """Coverage of every entity type: cases (doc_id, entity_type, kind) against the findings that won in each document.

    A positive is caught if its own type won somewhere in it, shadowed if only others did; a hard negative counts only
    if its own type fired. Rates without a case are null."""
    won = resolved.groupBy("doc_id").agg(F.collect_set("entity_type").alias("won"))
    detected, other = F.coalesce(F.array_contains("won", F.col("entity_type")), F.lit(False)), F.coalesce(F.size("won") > 0, F.lit(False))
    positive, negative = F.col("kind") == "positive", F.col("kind") == "negative"
    counts = cases.join(won, "doc_id", "left").groupBy("entity_type").agg(
        F.count_if(positive).alias("positives"),
        F.count_if(negative).alias("negatives"),
        F.count_if(positive & detected).alias("caught"),
        F.count_if(positive & ~detected & other).alias("shadowed"),
        F.count_if(negative & detected).alias("false_positives"),
    )
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, a / F.col(b)), 9)
    return counts.withColumns({"recall": rate(F.col("caught") + F.col("shadowed"), "positives"), "label_recall": rate(F.col("caught"), "positives"), "fp_rate": rate(F.col("false_positives"), "negatives")})
