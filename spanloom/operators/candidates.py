"""Candidate spans and what is decided about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Candidates of a message at most.
MOST = 24


def one_a_place(spans: DataFrame) -> DataFrame:
    """(item_id, s, e, src): one span for each place, from the least source."""
    return spans.groupBy("item_id", "s", "e").agg(F.min("src").alias("src"))


def first_of_item(spans: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` places of an item."""
    return spans.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("s", "e", "src"))).where(F.col("r") <= most).select("item_id", "s", "e", "src")


def candidate_spans(spans: DataFrame, most: int = MOST) -> DataFrame:
    """(item_id, s, e, src): one span for each place, and the first ``most`` of an item."""
    return first_of_item(one_a_place(spans), most)


def decide(probabilities: Column, choice: Column, thresholds: dict[str, float], base: float, none: str = "not-confidential", rule: str = "argmax") -> Column:
    """The entity type a candidate is given, or null. probabilities: map<type, double>.

    ``argmax`` takes the chosen type if its probability reaches its threshold; ``confidential-mass`` takes the likeliest
    type if all that is not ``none`` together reaches it."""
    own = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]) if thresholds else None
    limit = lambda t: F.coalesce(own[t], F.lit(base)) if own is not None else F.lit(base)
    if rule == "argmax":
        return F.when(choice.isNotNull() & (choice != none) & (F.try_element_at(probabilities, choice) >= limit(choice)), choice)
    others = F.filter(F.map_entries(probabilities), lambda e: e["key"] != none)
    best = F.array_max(F.transform(others, lambda e: F.struct(e["value"].alias("p"), e["key"].alias("t"))))
    mass = F.lit(1.0) - F.coalesce(F.try_element_at(probabilities, F.lit(none)), F.lit(0.0))
    return F.when((F.size(others) > 0) & (mass >= limit(best["t"])), best["t"])
