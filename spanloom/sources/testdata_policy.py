"""A policy for the generated tables: its rules aim at what is planted there."""

from __future__ import annotations

from dataclasses import replace

from .policy import EntityType, Policy, Rule

POLICY = Policy(
    policy_hash="testdata",
    entity_types=(
        EntityType("PHONE", 0, "medium"),
        EntityType("EMAIL", 0, "medium"),
        EntityType("CARD", 0, "high", never_pseudonymize=True),
        EntityType("IP", 0, "low"),
        EntityType("TOKEN", 0, "critical", never_pseudonymize=True),
        EntityType("LICENCE", 0, "low"),
        EntityType("SECRET", 0, "critical", never_pseudonymize=True),
    ),
    rules=(
        Rule("r-phone", "PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
        Rule("r-email", "EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]", context_boost=("mail", "contact")),
        Rule("r-card", "CARD", r"\b[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4}\b", validator="luhn"),
        Rule("r-ip", "IP", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
        Rule("r-hex", "TOKEN", r"\b[0-9a-f]{40}\b", context_boost=("token", "key")),
        Rule("r-assign", "SECRET", r"token = .[0-9a-f]{40}."),
        Rule("r-licence", "LICENCE", r"Licensed under [A-Z][A-Za-z0-9 -]+|Released under the MIT License"),
        Rule("r-entropy", "SECRET", entropy_threshold=3.5, min_length=20),
    ),
    actions={"PHONE": "pseudonymize", "EMAIL": "pseudonymize", "CARD": "block", "IP": "redact", "TOKEN": "redact", "LICENCE": "allow", "SECRET": "redact"},
    overrides={"internal": {"EMAIL": "allow", "IP": "allow", "CARD": "redact"}, "public": {"PHONE": "redact", "EMAIL": "block"}},
    predicates=(("client-named", "names a client", "message"),),
)

#: The pattern rules alone, which is what the SQL of some queries holds.
PATTERNS = replace(POLICY, rules=tuple(r for r in POLICY.rules if r.regex is not None))
