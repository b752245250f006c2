import json

import pytest

from spanloom.plans import compiler as C
from spanloom.sources import policy as P

DOC = {
    "irVersion": "1", "policyHash": "x", "failMode": "closed", "latencyBudgetMs": 1500,
    "entityTypes": [{"id": "A", "tier": 0, "severity": "high"}, {"id": "B", "tier": 0, "severity": "low", "neverPseudonymize": True}],
    "rules": [{"id": "r", "entityType": "A", "regex": "[0-9]+"}],
    "actions": {"default": {"A": "redact", "B": "block"}},
}


def changed(**kw):
    return json.dumps({**DOC, **kw})


def test_loads():
    p = P.load(json.dumps(DOC))
    assert [r.id for r in p.rules] == ["r"] and p.actions == {"A": "redact", "B": "block"}


@pytest.mark.parametrize(
    "text",
    [
        "{", json.dumps({k: v for k, v in DOC.items() if k != "irVersion"}), '{"__proto__": 1, "irVersion": "1"}', changed(extra=1),
        changed(rules=[{"id": "r", "entityType": "A", "regex": "a*"}]), changed(rules=[{"id": "r", "entityType": "A", "regex": "("}]), changed(rules=[{"id": "r", "entityType": "A"}]),
        changed(rules=[{"id": "r", "entityType": "Z", "regex": "a"}]), changed(rules=[{"id": "r", "entityType": "A", "regex": "a", "validator": "nope"}]), changed(rules=[{"id": "r", "entityType": "A", "entropyThreshold": 6.5}]),
        changed(actions={"default": {"A": "redact"}}), changed(actions={"default": {"A": "redact", "B": "pseudonymize"}}), changed(entityTypes=DOC["entityTypes"] + DOC["entityTypes"][:1]),
    ],
)
def test_refuses(text):
    with pytest.raises(P.PolicyLoadError):
        P.load(text)


def test_version():
    with pytest.raises(P.PolicyVersionError):
        P.load(changed(irVersion="2"))


def test_compiles_a_document(spark):
    doc = "§1 Account numbers of eight digits must never leave. §2 Internal notes may be shared with anyone at all."
    quote = "Account numbers of eight digits must never leave."
    said = {
        "entityTypes": [{"id": "ACC", "tier": 0, "severity": "high", "quote": quote}, {"id": "GHOST", "tier": 0, "severity": "low", "quote": "this sentence is nowhere in the text"}],
        "rules": [{"id": "acc", "entityType": "ACC", "regex": r"\b[0-9]{8}\b", "quote": quote}, {"id": "bad", "entityType": "ACC", "regex": "x*", "quote": quote}],
        "semanticPredicates": [{"id": "named", "nlPredicate": "names a client", "scope": "message", "quote": quote}],
        "actions": [{"entityType": "ACC", "action": "redact"}, {"entityType": "ACC", "action": "block"}],
    }
    client = C.FixtureClient({("Extraction", C.FixtureClient.digest(doc)): said})
    made = C.compile_policy(doc, client)
    assert made.policy.actions == {"ACC": "block", "pred:named": "redact"} and len(made.warnings) == 1
    assert dict(made.rejected) == {"GHOST": "not-found", "bad": "matches-empty"}
    assert json.loads(made.ir)["provenance"]["acc"]["clause"] == "§1"
    tested = C.self_test(spark, made.policy, [("ACC", "no 12345678 here", True), ("ACC", "nothing", False)])
    assert tested == [("ACC", 2, 1.0, 0.0)] and "| ACC | 0 | high | block |" in C.report(made, tested)
    assert C.compile_policy(doc, client).ir == made.ir


def test_slow_pattern_is_refused():
    assert C.pattern_problem("(a+)+b", seconds=0.5) == "too-slow"
    assert C.pattern_problem("a{3}[0-9]") is None
