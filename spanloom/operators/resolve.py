"""Resolution: clusters of overlapping findings, their strictest action, the winners in each, and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.policy import ACTIONS
from .detect import severity_rank


def action_rank(action: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), action).cast("int") - 1


def canonical() -> list:
    """A total order of findings."""
    return [F.col("start"), F.col("end"), F.col("source"), F.col("entity_type"), F.col("tier"), severity_rank(F.col("severity")).desc(), F.col("confidence").desc()]


def priority() -> list:
    return [severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), (F.col("end") - F.col("start")).desc(), *canonical()]


def clusters(findings: DataFrame) -> DataFrame:
    """Adds ``cluster``: findings that overlap, directly or through others; touching ones do not."""
    w = Window.partitionBy("doc_id").orderBy(*canonical())
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return findings.withColumn("cluster", F.sum((reach.isNull() | (F.col("start") >= reach)).cast("int")).over(w))


def resolved_actions(findings: DataFrame, actions: DataFrame, provider: str | None) -> DataFrame:
    """Adds ``action``: the provider's own for the type, else the default."""
    default = actions.where("provider is null").select("entity_type", F.col("action").alias("default_action"))
    own = actions.where(F.col("provider") == F.lit(provider)).select("entity_type", F.col("action").alias("own_action"))
    j = findings.join(F.broadcast(default), "entity_type", "left").join(F.broadcast(own), "entity_type", "left")
    return j.withColumn("action", F.coalesce("own_action", "default_action")).drop("own_action", "default_action")


def winners(clustered: DataFrame) -> DataFrame:
    """Greedy choice in each cluster: the strongest, then the strongest that overlaps none chosen, and so on.

    ``clustered`` has ``cluster`` and ``action``. Winners take the strictest action of their cluster, losers included,
    but a type that is never pseudonymised is redacted instead. A cluster is folded in one expression; those of one
    finding skip the fold."""
    own = ["start", "end", "text", "entity_type", "severity", "tier", "source", "confidence", "never"]
    ranked = clustered.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id", "cluster").orderBy(*priority())))
    grouped = ranked.groupBy("doc_id", "cluster").agg(F.max(action_rank(F.col("action"))).alias("rank"), F.sort_array(F.collect_list(F.struct("__r", *[c for c in own if c != "never"], F.col("never_pseudonymize").alias("never")))).alias("all"))
    empty = F.slice("all", 1, 0)
    fold = F.aggregate("all", empty, lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.array_append(kept, x)))
    chosen = grouped.select("doc_id", "cluster", "rank", F.explode(F.when(F.size("all") == 1, F.col("all")).otherwise(fold)).alias("w"))
    strict = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("rank") + 1)
    action = F.when((strict == "pseudonymize") & F.col("w.never"), "redact").otherwise(strict)
    return chosen.select("doc_id", "cluster", *[F.col(f"w.{c}").alias(c) for c in own if c != "never"], action.alias("action"))


def resolve(findings: DataFrame, entity_types: DataFrame, actions: DataFrame, provider: str | None = None) -> DataFrame:
    """Findings to resolved findings: clusters, strictest actions, winners."""
    acted = resolved_actions(findings, actions, provider).join(F.broadcast(entity_types.select("entity_type", "never_pseudonymize")), "entity_type")
    return winners(clusters(acted))


# ---------------------------------------------------------------- rewriting


def placed(spans: DataFrame) -> DataFrame:
    """Resolved spans with ``replacement`` (null: stays) get ``new_start`` and ``new_end`` in the rewritten text."""
    w = Window.partitionBy("doc_id").orderBy("start")
    grown = F.coalesce(F.length("replacement"), F.col("end") - F.col("start")) - (F.col("end") - F.col("start"))
    shift = F.coalesce(F.sum(grown).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = spans.withColumn("new_start", (F.col("start") + shift).cast("int"))
    return out.withColumn("new_end", (F.col("new_start") + F.coalesce(F.length("replacement"), F.col("end") - F.col("start"))).cast("int"))


def disjoint_violations(spans: DataFrame) -> DataFrame:
    """Spans that begin before the one before them ends."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    return spans.withColumn("__e", F.lag("end").over(w)).where(F.col("start") < F.col("__e")).drop("__e")


def redaction(entity_type: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), entity_type, F.lit("]"))


def rewritten(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, blocked, n_applied, n_skipped) of messages with their spans (start, end, action, replacement).

    Messages without spans pass unchanged; spans are folded by document, so a text is shuffled once."""
    by_doc = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action", "replacement"))).alias("s"))
    j = docs.join(by_doc, "doc_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,end:int,action:string,replacement:string>>")))
    # what lies before each replaced span, what replaces it, and what is left
    done = F.filter("s", lambda x: x["replacement"].isNotNull())
    before = F.concat(F.array(F.lit(0)), F.transform(done, lambda x: x["end"]))
    parts = F.zip_with(done, F.slice(before, 1, F.greatest(F.size(done), F.lit(1))), lambda x, at: F.when(x.isNotNull(), F.concat(F.substring(F.col("text"), at + 1, x["start"] - at), x["replacement"])))
    text = F.concat(F.array_join(parts, ""), F.substring(F.col("text"), F.element_at(before, -1) + 1, F.length("text")))
    return j.select("doc_id", text.alias("text"), F.exists("s", lambda x: x["action"] == "block").alias("blocked"), F.size(F.filter("s", lambda x: x["replacement"].isNotNull())).cast("long").alias("n_applied"), F.size(F.filter("s", lambda x: x["replacement"].isNull())).cast("long").alias("n_skipped"))
