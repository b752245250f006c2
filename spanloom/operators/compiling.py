"""Relational parts of the policy compiler: grounding, shadows, reconciliation, overrides, clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .resolve import action_rank

#: A quote shorter than this grounds nothing.
LEAST_QUOTE = 24


def shadow_id(predicate_id: Column) -> Column:
    return F.concat(F.lit("pred:"), predicate_id)


def mint_shadows(predicates: DataFrame, entity_types: DataFrame) -> DataFrame:
    """One tier-2 entity type a predicate, redacted by default; ids that are taken are an error found by the join."""
    made = predicates.select(shadow_id(F.col("predicate_id")).alias("entity_type"), F.lit("redact").alias("action"), F.lit(2).alias("tier"))
    return made.join(F.broadcast(entity_types.select("entity_type")), "entity_type", "left_anti")


#: Quotes that are sent to every task at most, and the length of the beginnings by which more are met.
MOST_QUOTES, KEY = 100_000, 16


def grounded_counts(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, n_docs) of the documents that contain each quote (item_id, quote); every row of ``docs`` counts.

    Quotes come from one policy document or a benchmark: they are few, and their number is checked before they are
    sent to every task; more than that are met in an index of their beginnings instead, with the same counts."""
    if quotes.limit(MOST_QUOTES + 1).count() <= MOST_QUOTES:
        hits = docs.join(F.broadcast(quotes), F.expr("contains(text, quote)"))
    else:
        # a quote shorter than the key is met by pieces of its own length; one row meets a quote at one piece only
        lengths = sorted(r[0] for r in quotes.where("quote is not null").select(F.least(F.length("quote"), F.lit(KEY))).distinct().collect())  # KEY + 1 at most
        none, size = F.array().cast("array<string>"), F.length("text")
        piece = lambda n: F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("text"), i, F.lit(n))))).otherwise(none) if n else F.array(F.lit(""))
        pieces = docs.select("text", F.explode(F.concat(none, *[piece(n) for n in lengths])).alias("k"))
        hits = pieces.join(quotes.withColumn("k", F.substring("quote", 1, KEY)), "k").where(F.expr("contains(text, quote)"))
    hits = hits.groupBy("item_id").agg(F.count("*").alias("n"))
    return quotes.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quote_reason(quote: Column, found: Column) -> Column:
    """The reason for which a squeezed quote is rejected, or null."""
    return F.when(F.length(quote) == 0, "empty-quote").when(F.length(quote) < LEAST_QUOTE, "short-quote").when(~found, "not-found")


def ground_quote(quote: Column, document: Column) -> Column:
    """The reason for which a quote is rejected, or null."""
    return quote_reason(squeezed(quote), F.contains(squeezed(document), squeezed(quote)))


def ground_providers(mentions: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """mentions (key, mention) with aliases (provider, alias): each provider claimed once, by its longest alias."""
    j = mentions.join(F.broadcast(aliases), F.expr("contains(lower(mention), alias)"))
    w = Window.partitionBy(key, "provider").orderBy(F.desc(F.length("alias")), "alias")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "provider", "alias")


def reconcile(rows: DataFrame, surviving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows by whether their entity type survives."""
    ids = F.broadcast(surviving.select("entity_type"))
    return rows.join(ids, "entity_type", "left_semi"), rows.join(ids, "entity_type", "left_anti")


def merge_actions(actions: DataFrame) -> DataFrame:
    """The stricter of conflicting actions wins, and is warned of."""
    return actions.groupBy("entity_type").agg(F.max(action_rank(F.col("action"))).cast("long").alias("strictest"), (F.countDistinct("action") > 1).alias("warned"))


def inherit_overrides(actions: DataFrame, shadows: DataFrame) -> DataFrame:
    """Each provider's strictest own action passes to the shadows for which it is stricter than their default."""
    own = actions.where("provider is not null").groupBy("provider").agg(F.max(action_rank(F.col("action"))).cast("long").alias("strictest"))
    j = own.crossJoin(F.broadcast(shadows.select("entity_type", action_rank(F.col("action")).alias("default"))))  # providers x predicates
    return j.where("strictest > default").select("provider", "entity_type", "strictest")


def locate_clauses(quotes: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, s_start, clause_at): the last clause mark at or before each quote, -1 if there is none."""
    both = quotes.unionByName(marks)
    w = Window.partitionBy("doc_id").orderBy("at", "is_quote").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("is_quote") == 0, F.col("at"))).over(w)
    return both.withColumn("c", F.coalesce(last, F.lit(-1))).where("is_quote = 1").select("doc_id", F.col("at").cast("long").alias("s_start"), F.col("c").cast("long").alias("clause_at"))
