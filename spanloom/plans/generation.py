"""Corpus generation, and runs of arms over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import injection as I
from ..sources.scratch import written


class GenerationError(ValueError):
    pass


def generate(carriers: DataFrame, forms: list[str], seed: str = "0", examples: DataFrame | None = None, sweep=None) -> DataFrame:
    """carriers (item_id, text) to items (item_id, text, spans, part): certified carriers, one seeded value each dealt
    by a hash, injected at a word boundary; contaminated items dropped; split by form; the invariant checked again.
    ``sweep`` takes (doc_id, text) to its hits, any of which quarantines a carrier; without one all carriers are taken."""
    spark = carriers.sparkSession
    clear = carriers
    if sweep:
        hits = sweep(carriers.select(F.col("item_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("item_id"), F.lit("main").alias("stage"))
        clear = carriers.join(K.certify(hits, carriers.select("item_id")).where("status = 'certified-clear'"), "item_id").select("item_id", "text")
        clear = written(clear, "clear")  # read twice below, and swept once
    pool = I.minted(spark, forms, 64, seed)
    deal = F.pmod(F.xxhash64(F.lit(seed), "item_id"), F.lit(len(forms) * 64))
    dealt = clear.withColumn("deal", deal).join(F.broadcast(pool.withColumn("deal", F.lit(64) * F.array_position(F.array(*[F.lit(f) for f in forms]), F.col("form")) - 64 + F.col("k")).select("deal", "form", "value")), "deal")  # forms x 64 rows
    at = F.greatest(F.locate(" ", "text") - 1, F.lit(0)).cast("int")
    puts = dealt.select("item_id", at.alias("at"), F.lit(0).alias("k"), F.lit(" ").alias("prefix"), "value", F.lit("").alias("suffix"), F.col("form").alias("type"))
    items = written(I.inject(clear, puts), "items")
    if I.invariant_violations(items).limit(1).count():
        raise GenerationError("an injected value is not where it should be, or occurs elsewhere as well")
    if examples is not None:
        bad = K.contamination(items.select("item_id", "text"), examples).where(F.col("share") > K.DROP_ABOVE).select("item_id").distinct()
        items = items.join(written(bad, "bad"), "item_id", "left_anti")  # the split reads it twice
    return K.stratified_split(items.withColumn("form", F.col("spans")[0]["type"]), "form", "item_id")


def run_plan(spark: SparkSession, arms: list[str], items: DataFrame, passes: int = 1) -> DataFrame:
    """(pass, arm, item_id, ...): every arm on every item, in every pass. Arms and passes are a handful of literals,
    so they are exploded onto the items and nothing is shuffled."""
    return items.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms]))).withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
