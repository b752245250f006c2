"""Prompts, requests and the deterministic stand-in for a judge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 2)


def fits(text: Column, window: int, max_tokens: int) -> Column:
    return estimated_tokens(text) <= window - max_tokens


def filler(n: Column) -> Column:
    """n numbered words, to find how much a window holds."""
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("token"), (i % 97).cast("string"))), " ")


def stub_digest(item: Column, question: Column) -> Column:
    return F.sha2(F.concat_ws(":", item, question), 256)


def stub_probability(item: Column, question: Column) -> Column:
    """A probability in [0, 1) from a digest: the offline judge."""
    return F.conv(F.substring(stub_digest(item, question), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def compiled_prompt(predicates: Column, priors: Column, passage: Column) -> Column:
    """Predicates (array of "id: text"), what was found before, and the passage."""
    return F.concat_ws("\n\n", F.concat(F.lit("Conditions:\n"), F.array_join(predicates, "\n")), F.when(F.length(priors) > 0, F.concat(F.lit("Found so far: "), priors)), F.concat(F.lit("Passage:\n"), passage))


def policy_prompt(document: Column, entity_ids: Column, priors: Column, message: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("Policy:\n"), document), F.concat(F.lit("Types: "), F.array_join(entity_ids, ", ")), F.when(F.length(priors) > 0, F.concat(F.lit("Found so far: "), priors)), F.concat(F.lit("Message:\n"), message))


def repair_turn(failure: Column) -> Column:
    return F.concat(F.lit("The answer was not usable ("), failure, F.lit("). Answer again with JSON of the asked form only."))


def request_body(model: str, provider: str, system: str, user: Column, schema: str, max_tokens: int) -> Column:
    """A hosted request as JSON: temperature 0, one provider, a JSON schema, streamed with usage."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.struct(F.array(F.lit(provider)).alias("only"), F.lit(False).alias("allow_fallbacks")).alias("provider"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"), F.lit(0).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), F.lit(schema).alias("schema"), F.lit(True).alias("stream")))
