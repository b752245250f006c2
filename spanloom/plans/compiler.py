"""Policy document to policy: extract, ground, mint shadows, check patterns, emit, load, self-test, report.

A document is one text, so this runs on the driver; the relational steps have DataFrame forms in operators.compiling.
The language model is a client: a request digest to a recorded answer in tests, anything else elsewhere."""

from __future__ import annotations

import hashlib
import json
import multiprocessing
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.compiling import LEAST_QUOTE
from ..sources import policy as P

Client = Callable[[str, str], dict]


class FixtureClient:
    """Recorded answers by (kind, digest of the request)."""

    def __init__(self, answers: dict[tuple[str, str], dict]):
        self.answers = answers

    @staticmethod
    def digest(request: str) -> str:
        return hashlib.sha256(request.encode()).hexdigest()[:16]

    def __call__(self, kind: str, request: str) -> dict:
        try:
            return self.answers[kind, self.digest(request)]
        except KeyError:
            raise LookupError(f"no recorded answer of kind {kind}") from None


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def ground(candidates: list[dict], document: str) -> tuple[list[dict], list[tuple[str, str]]]:
    """(kept, rejected (id, reason)): a candidate's quote must stand in the document."""
    text, kept, rejected = squeeze(document), [], []
    for c in candidates:
        q = squeeze(c.get("quote", ""))
        reason = "empty-quote" if not q else "short-quote" if len(q) < LEAST_QUOTE else None if q in text else "not-found"
        (kept.append(c) if reason is None else rejected.append((c["id"], reason)))
    return kept, rejected


def clause_of(document: str, quote: str) -> str:
    """The last clause mark at or before a quote."""
    text = squeeze(document)
    at = text.find(squeeze(quote))
    marks = [m for m in re.finditer(r"§[0-9]+(?:\.[0-9]+)*", text) if m.start() <= at]
    return marks[-1].group() if marks else "unmarked"


def _probe(pattern: str, text: str, out) -> None:
    re.search(pattern, text)
    out.put(True)


def pattern_problem(pattern: str, seconds: float = 1.0, size: int = 20_000) -> str | None:
    """Why a pattern may not ship: it does not compile, matches nothing, or takes too long on long repeats (tried in a
    process of its own, so that it can be stopped)."""
    try:
        if re.compile(pattern).search(""):
            return "matches-empty"
    except re.error:
        return "does-not-compile"
    context = multiprocessing.get_context("fork")
    literals = re.findall(r"[A-Za-z0-9]", re.sub(r"\\.|\[[^\]]*\]|\{[^}]*\}", "", pattern))[:1]
    for probe in ["a" * size + "!", "0" * size + "!", *[c * size + "!" for c in literals]]:
        out = context.Queue()
        p = context.Process(target=_probe, args=(pattern, probe, out))
        p.start()
        p.join(seconds)
        if p.is_alive():
            p.kill()
            p.join()
            return "too-slow"
    return None


@dataclass
class Compiled:
    ir: str
    policy: P.Policy
    rejected: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    stages: list[tuple[str, int]] = field(default_factory=list)


class NotShippable(ValueError):
    pass


def compile_policy(document: str, client: Client) -> Compiled:
    said = client("Extraction", document)
    stages, rejected, warnings = [], [], []
    kept = {}
    for kind in ("entityTypes", "rules", "semanticPredicates"):
        kept[kind], bad = ground(said.get(kind, []), document)
        rejected += bad
        stages.append((kind, len(kept[kind])))
    for r in list(kept["rules"]):
        if r.get("regex") is not None and (why := pattern_problem(r["regex"])):
            kept["rules"].remove(r)
            rejected.append((r["id"], why))
    types = {e["id"] for e in kept["entityTypes"]}
    for r in list(kept["rules"]):
        if r["entityType"] not in types:
            kept["rules"].remove(r)
            rejected.append((r["id"], "no-entity-type"))
    default: dict[str, str] = {}
    overrides: dict[str, dict[str, str]] = {}
    for a in said.get("actions", []):
        place = default if a.get("provider") is None else overrides.setdefault(a["provider"], {})
        old = place.get(a["entityType"])
        if old is not None and old != a["action"]:
            warnings.append(f"conflicting actions for {a['entityType']}: the stricter is kept")
        if a["entityType"] in types:
            place[a["entityType"]] = max([x for x in (old, a["action"]) if x], key=P.ACTIONS.index)
    shadows = []
    for p in kept["semanticPredicates"]:
        sid = "pred:" + p["id"]
        if sid in types:
            raise NotShippable("a predicate's entity type is taken")
        shadows.append({"id": sid, "tier": 2, "severity": "high", "nlDefinition": p.get("nlPredicate", "")})
        default[sid] = "redact"
        for m in overrides.values():
            strict = max(m.values(), key=P.ACTIONS.index, default=None)
            if strict is not None and P.ACTIONS.index(strict) > P.ACTIONS.index("redact"):
                m[sid] = strict
    for t in sorted(types - set(default)):
        default[t] = "redact"
        warnings.append(f"no action for {t}: redacted by default")
    strip = lambda rows: [{k: v for k, v in r.items() if k not in ("quote",)} for r in rows]
    quotes = {c["id"]: {"clause": clause_of(document, c["quote"]), "quote": squeeze(c["quote"])} for kind in kept.values() for c in kind}
    ir = {
        "irVersion": "1", "policyHash": P.policy_hash(document), "entityTypes": strip(kept["entityTypes"]) + shadows, "rules": strip(kept["rules"]), "semanticPredicates": strip(kept["semanticPredicates"]),
        "actions": {"default": default, "providerOverrides": {p: m for p, m in overrides.items() if m}}, "failMode": "closed", "latencyBudgetMs": 1500, "provenance": quotes,
    }
    if not ir["entityTypes"]:
        raise NotShippable("nothing was grounded")
    text = json.dumps(ir, ensure_ascii=False, indent=2, sort_keys=True)
    return Compiled(text, P.load(text), rejected, warnings, stages)


def self_test(spark, policy: P.Policy, cases: list[tuple[str, str, bool]]) -> list[tuple[str, int, float, float]]:
    """cases (entity type, text, positive) through the real pipeline: (entity type, n, recall, false-positive rate)."""
    from .pipeline import detect_messages

    rows = [(i, text) for i, (_, text, _) in enumerate(cases)]
    found = {(r["doc_id"], r["entity_type"]) for r in detect_messages(spark.createDataFrame(rows, "doc_id long, text string"), policy).findings.select("doc_id", "entity_type").distinct().collect()}
    out = []
    for t in dict.fromkeys(t for t, _, _ in cases):
        mine = [(i, pos) for i, (u, _, pos) in enumerate(cases) if u == t]
        pos, neg = [i for i, p in mine if p], [i for i, p in mine if not p]
        rate = lambda ids: sum((i, t) in found for i in ids) / len(ids) if ids else 0.0  # noqa: B023,E731
        out.append((t, len(mine), rate(pos), rate(neg)))
    return out


def report(c: Compiled, tested: list[tuple[str, int, float, float]] | None = None) -> str:
    """The compilation report as markdown."""
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    table = lambda head, rows: "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])
    parts = ["# Compilation report", table(["kind", "kept"], c.stages), "## Entity types", table(["id", "tier", "severity", "default action"], [(e.id, e.tier, e.severity, c.policy.actions[e.id]) for e in c.policy.entity_types])]
    if c.rejected:
        parts += ["## Rejected", table(["id", "reason"], c.rejected)]
    if tested:
        parts += ["## Self-test", table(["type", "cases", "recall", "false positives", "warning"], [(t, n, f"{r:.0%}", f"{f:.0%}", "low recall" if r < 0.8 else "false positives" if f > 0.1 else "") for t, n, r, f in tested])]
    if c.warnings:
        parts += ["## Warnings", *[f"- {w}" for w in c.warnings]]
    return "\n\n".join(parts) + "\n"
