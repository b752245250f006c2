"""The policy document: loading, constraints, dimension tables.

A policy is versioned JSON: entity types, rules (a pattern with an optional validator and context words, or an entropy
rule), message predicates, default actions with overrides by provider, and where each part was said. It is small, so it
is read on the driver and turned into dimension tables; constraint violations are found as rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import VALIDATORS

SEVERITIES = ["low", "medium", "high", "critical"]
ACTIONS = ["allow", "pseudonymize", "redact", "block"]
#: Above this no text in the scanned alphabet can lie.
ENTROPY_CEILING = 6.08


class PolicyLoadError(ValueError):
    pass


class PolicyVersionError(PolicyLoadError):
    pass


@dataclass(frozen=True)
class EntityType:
    id: str
    tier: int
    severity: str
    definition: str = ""
    never_pseudonymize: bool = False
    surrogate_kind: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    entity_type: str
    regex: str | None = None
    validator: str | None = None
    context_boost: tuple[str, ...] = ()
    entropy_threshold: float | None = None
    min_length: int | None = None


@dataclass(frozen=True)
class Policy:
    policy_hash: str
    entity_types: tuple[EntityType, ...]
    rules: tuple[Rule, ...]
    actions: dict[str, str]
    overrides: dict[str, dict[str, str]] = field(default_factory=dict)
    predicates: tuple[tuple[str, str, str], ...] = ()
    fail_mode: str = "closed"
    latency_budget_ms: int = 1500

    def dims(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The dimension tables entity_types, rules and actions; their size is that of the policy."""
        et = spark.createDataFrame([(e.id, e.tier, e.severity, SEVERITIES.index(e.severity), e.never_pseudonymize, e.definition) for e in self.entity_types], "entity_type string, tier int, severity string, severity_rank int, never_pseudonymize boolean, definition string")
        rules = spark.createDataFrame([(i, r.id, r.entity_type, r.regex, r.validator, list(r.context_boost), r.entropy_threshold, r.min_length) for i, r in enumerate(self.rules)], "rule_ord int, rule_id string, entity_type string, regex string, validator string, context_boost array<string>, entropy_threshold double, min_length int")
        said = [(None, t, a) for t, a in self.actions.items()] + [(p, t, a) for p, m in self.overrides.items() for t, a in m.items()]
        actions = spark.createDataFrame(said, "provider string, entity_type string, action string")
        return {"entity_types": et, "rules": rules, "actions": actions}


def _no_proto(pairs):
    if any(k == "__proto__" for k, _ in pairs):
        raise PolicyLoadError("a key may not be named __proto__")
    return dict(pairs)


def violations(doc: dict) -> list[tuple[str, str]]:
    """(constraint, id) for everything that breaks the schema; empty for a sound policy."""
    out: list[tuple[str, str]] = []
    allowed = {"irVersion", "policyHash", "entityTypes", "rules", "semanticPredicates", "actions", "failMode", "latencyBudgetMs", "provenance"}
    out += [("unknown-key", k) for k in doc if k not in allowed]
    types = [e["id"] for e in doc.get("entityTypes", [])]
    rules = doc.get("rules", [])
    for kind, ids in (("entityType", types), ("rule", [r["id"] for r in rules]), ("predicate", [p["id"] for p in doc.get("semanticPredicates", [])])):
        out += [(f"duplicate-{kind}", i) for i in sorted({i for i in ids if ids.count(i) > 1})]
    for r in rules:
        has_regex, has_entropy = r.get("regex") is not None, r.get("entropyThreshold") is not None
        if has_regex == has_entropy:
            out.append(("regex-xor-entropy", r["id"]))
        if not has_regex and (r.get("validator") or r.get("contextBoost")):
            out.append(("regex-only-field", r["id"]))
        if not has_entropy and r.get("minLength") is not None:
            out.append(("entropy-only-field", r["id"]))
        if has_entropy and not 0 < r["entropyThreshold"] <= ENTROPY_CEILING:
            out.append(("entropy-range", r["id"]))
        if r["entityType"] not in types:
            out.append(("dangling-rule-type", r["id"]))
    actions = doc.get("actions", {})
    default, overrides = actions.get("default", {}), actions.get("providerOverrides", {})
    out += [("no-default-action", t) for t in types if t not in default]
    out += [("dangling-action", t) for t in default if t not in types]
    out += [("dangling-override", f"{p}/{t}") for p, m in overrides.items() for t in m if t not in types]
    never = {e["id"] for e in doc.get("entityTypes", []) if e.get("neverPseudonymize")}
    out += [("never-pseudonymize", t) for t, a in default.items() if t in never and a == "pseudonymize"]
    out += [("never-pseudonymize", f"{p}/{t}") for p, m in overrides.items() for t, a in m.items() if t in never and a == "pseudonymize"]
    known = set(types) | {r["id"] for r in rules} | {p["id"] for p in doc.get("semanticPredicates", [])}
    out += [("dangling-provenance", k) for k in doc.get("provenance", {}) if k not in known]
    return out


def load(text: str) -> Policy:
    """Parse, check the version, check the schema, compile every pattern."""
    try:
        doc = json.loads(text, object_pairs_hook=_no_proto)
    except json.JSONDecodeError as e:
        raise PolicyLoadError("not JSON") from e
    if not isinstance(doc, dict) or "irVersion" not in doc:
        raise PolicyLoadError("no version")
    if doc["irVersion"] != "1":
        raise PolicyVersionError(f"version {doc['irVersion']!r} is not supported")
    if bad := violations(doc):
        raise PolicyLoadError("; ".join(f"{c}: {i}" for c, i in bad))
    rules = []
    for r in doc["rules"]:
        if r.get("regex") is not None:
            try:
                matches_nothing = re.compile(r["regex"]).search("")
            except re.error as e:
                raise PolicyLoadError(f"rule {r['id']}: its pattern does not compile") from e
            if matches_nothing:
                raise PolicyLoadError(f"rule {r['id']}: its pattern matches the empty text")
        if r.get("validator") is not None and r["validator"] not in VALIDATORS:
            raise PolicyLoadError(f"rule {r['id']}: unknown validator")
        rules.append(Rule(r["id"], r["entityType"], r.get("regex"), r.get("validator"), tuple(r.get("contextBoost", ())), r.get("entropyThreshold"), r.get("minLength")))
    types = tuple(EntityType(e["id"], e.get("tier", 0), e["severity"], e.get("nlDefinition", ""), bool(e.get("neverPseudonymize")), e.get("surrogateKind")) for e in doc["entityTypes"])
    return Policy(doc.get("policyHash", ""), types, tuple(rules), doc["actions"]["default"], doc["actions"].get("providerOverrides", {}), tuple((p["id"], p.get("nlPredicate", ""), p["scope"]) for p in doc.get("semanticPredicates", [])), doc.get("failMode", "closed"), doc.get("latencyBudgetMs", 1500))


def policy_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def violation_rows(entity_types: DataFrame, rules: DataFrame, actions: DataFrame) -> DataFrame:
    """The same constraints over dimension tables: (violation, id)."""
    row = lambda df, name, c: df.select(F.lit(name).alias("violation"), F.col(c).cast("string").alias("id"))
    parts = [
        row(entity_types.groupBy("entity_type").count().where("count > 1"), "duplicate-entityType", "entity_type"),
        row(rules.groupBy("rule_id").count().where("count > 1"), "duplicate-rule", "rule_id"),
        row(rules.where(F.col("regex").isNull() == F.col("entropy_threshold").isNull()), "regex-xor-entropy", "rule_id"),
        row(rules.where("regex is null and validator is not null"), "regex-only-field", "rule_id"),
        row(rules.where("entropy_threshold is null and min_length is not null"), "entropy-only-field", "rule_id"),
        row(rules.where((F.col("entropy_threshold") <= 0) | (F.col("entropy_threshold") > ENTROPY_CEILING)), "entropy-range", "rule_id"),
        row(rules.join(entity_types, "entity_type", "left_anti"), "dangling-rule-type", "rule_id"),
        row(entity_types.join(actions.where("provider is null"), "entity_type", "left_anti"), "no-default-action", "entity_type"),
        row(actions.join(entity_types, "entity_type", "left_anti"), "dangling-action", "entity_type"),
        row(actions.where("action = 'pseudonymize'").join(entity_types.where("never_pseudonymize"), "entity_type", "left_semi"), "never-pseudonymize", "entity_type"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
