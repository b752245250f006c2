"""The detection pipeline: one lazy plan from messages to resolved findings and notices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from ..operators import detect, notices, resolve
from ..sources.policy import Policy

#: A model stage: segments to findings. A detector: messages to findings, in place of the whole pipeline.
Stage = Callable[[DataFrame], DataFrame]
Detector = Callable[[DataFrame], DataFrame]


@dataclass
class Detected:
    resolved: DataFrame
    notices: DataFrame
    findings: DataFrame
    unsound: DataFrame


def detect_messages(docs: DataFrame, policy: Policy, provider: str | None = None, tier1: Stage | None = None, tier2: Stage | None = None, below: float = detect.UNCERTAIN, use_tier1: bool = False, use_tier2: bool = False) -> Detected:
    """Segments once, tier 0, tier 1 on all but code, tier 2 on escalated segments; then normalise and resolve.

    An enabled tier without a stage is an error, as an empty result would look like a clean message."""
    if (use_tier1 and tier1 is None) or (use_tier2 and tier2 is None):
        raise ValueError("a tier is enabled but has no stage")
    dims = policy.dims(docs.sparkSession)
    rules = detect.tier0(docs, policy).drop("rule_ord")
    found, models = rules, []
    segs = detect.segments(docs) if use_tier1 or use_tier2 else None
    missing = []
    if use_tier1:
        models.append(tier1(segs.where("kind <> 'code'")))
        found = found.unionByName(models[-1])
    else:
        missing.append(notices.absent(docs, "tier1"))
    if use_tier2:
        chosen = detect.escalated(segs, detect.uncertain_segments(segs, found, below), bool(policy.predicates))
        models.append(tier2(chosen))
    else:
        missing.append(notices.absent(docs, "tier2"))
    # only what a model says has to be held against the texts, which are shuffled for it
    sound = detect.with_severity(rules, dims["entity_types"])
    unsound = detect.normalised(rules.limit(0), docs.limit(0), dims["entity_types"])[1]
    if models:
        told_sound, unsound = detect.normalised(reduce(DataFrame.unionByName, models), docs, dims["entity_types"])
        sound = sound.unionByName(told_sound)
    resolved = resolve.resolve(sound, dims["entity_types"], dims["actions"], provider)
    told = missing[0] if missing else notices.absent(docs.limit(0), "none")
    for m in missing[1:]:
        told = told.unionByName(m)
    return Detected(resolved, told, sound, unsound)
