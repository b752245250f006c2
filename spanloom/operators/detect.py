"""Detection: segments, pattern rules, entropy rules, escalation and notices.

Texts are scanned by native expressions, a rule at a time; only a text that matches a rule at all is searched for places.
Everything stays within one stage until findings are grouped by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..functions.offsets import find_spans, running
from ..functions.regexes import WHITE
from ..sources.policy import SEVERITIES, Policy

# Confidence of a pattern match, what context adds, its cap; of an entropy match; the least sure.
REGEX_CONFIDENCE, BOOST, CAP, ENTROPY_CONFIDENCE, UNCERTAIN = 0.9, 0.05, 0.99, 0.7, 0.8
CONTEXT_CHARS, ENTROPY_LENGTH = 40, 20

# A key, a sign of assignment and a value; fenced code.
KV_LINE = rf"\A[{WHITE}]*(?:-[{WHITE}]+)?[A-Za-z0-9_][A-Za-z0-9_.-]*[{WHITE}]*[=:][{WHITE}]*[^{WHITE}]"
FENCE = r"(?s)```.*?(?:```\n?|\z)"

FINDING = ["doc_id", "start", "end", "text", "entity_type", "severity", "tier", "source", "confidence"]


def kv_line(line: Column) -> Column:
    """Whether a line is a key, a sign of assignment and a value."""
    return line.rlike(KV_LINE)


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, seg_no, start, end, kind, text): fenced code, then runs of key-value lines, and prose; tiles each text."""
    fences = find_spans(F.col("text"), FENCE)
    d = docs.select("doc_id", "text", fences.alias("f"))
    edge = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text"))
    last = F.struct(F.length("text").alias("start"), F.length("text").alias("end"), F.lit("").alias("text"))
    gaps = F.zip_with(F.concat(F.array(edge), F.col("f")), F.concat(F.col("f"), F.array(last)), lambda a, b: F.struct(a["end"].alias("start"), b["start"].alias("end")))
    code = F.transform("f", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("code").alias("kind")))
    # a gap's lines keep their line end
    lines = F.flatten(F.transform(gaps, lambda g: _lines(F.substring(F.col("text"), g["start"] + 1, g["end"] - g["start"]), g["start"])))
    pieces = d.select("doc_id", "text", F.explode(F.concat(code, lines)).alias("p")).select("doc_id", "text", "p.*")
    w = Window.partitionBy("doc_id").orderBy("start")
    new = (F.lag("kind").over(w).isNull()) | (F.lag("kind").over(w) != F.col("kind")) | (F.col("kind") == "code")
    runs = pieces.withColumn("run", F.sum(new.cast("int")).over(w))
    whole = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("kind").alias("kind"), F.first("text").alias("text"))
    return whole.select("doc_id", (F.col("run") - 1).cast("int").alias("seg_no"), "start", "end", "kind", F.expr("substring(text, start + 1, end - start)").alias("text"))


def _lines(text: Column, offset: Column) -> Column:
    """Struct (start, end, kind) for every line of a text, its line end included; none for the empty text."""
    parts = F.split(text, "\n", -1)
    n = F.size(parts)
    kept = F.transform(parts, lambda x, i: F.when(i < n - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    kept = F.filter(kept, lambda x: F.length(x) > 0)
    before = running(F.transform(kept, lambda x: F.length(x)))
    return F.zip_with(kept, before, lambda x, at: F.struct((offset + at).alias("start"), (offset + at + F.length(x)).alias("end"), F.when(kv_line(x), "kv").otherwise("prose").alias("kind")))


def boosted(message: Column, start: Column, end: Column, words: tuple[str, ...]) -> Column:
    """Whether a context word lies in the forty characters around a match, the match included."""
    return scalars.words_near(message, start, end, list(words), CONTEXT_CHARS) if words else F.lit(False)


def _rule_findings(ordinal: int, rule, severity: str) -> Column:
    """The findings of one pattern rule as an array of structs."""
    spans = find_spans(F.col("text"), rule.regex)
    if rule.validator:
        ok = scalars.validator(rule.validator)
        spans = F.filter(spans, lambda s: ok(s["text"]))

    def finding(s):
        sure = F.least(F.lit(CAP), F.lit(REGEX_CONFIDENCE) + F.lit(BOOST) * boosted(F.col("text"), s["start"], s["end"], rule.context_boost).cast("double"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(rule.entity_type).alias("entity_type"), F.lit(severity).alias("severity"), F.lit(0).alias("tier"), F.lit(rule.id).alias("source"), sure.alias("confidence"), F.lit(ordinal).alias("rule_ord"))

    return F.transform(spans, finding)


def scan_regex_rules(docs: DataFrame, policy: Policy) -> DataFrame:
    """Findings of all pattern rules (with rule_ord), one pass over the texts."""
    rank = {e.id: e.severity for e in policy.entity_types}
    rules = [(i, r) for i, r in enumerate(policy.rules) if r.regex is not None]
    found = []
    for i, r in rules:
        found.append(_rule_findings(i, r, rank[r.entity_type]))
    every = F.concat(*found)
    return docs.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")


def scan_entropy_rules(segs: DataFrame, policy: Policy) -> DataFrame:
    """Findings of the entropy rules in code and key-value segments; offsets are those of the message."""
    rank = {e.id: e.severity for e in policy.entity_types}
    base = segs.where(F.col("kind") != "prose")
    out = []
    for i, r in enumerate(policy.rules):
        if r.entropy_threshold is None:
            continue
        spans = base.select("doc_id", F.col("start").alias("at"), F.explode(find_spans(F.col("text"), r"[A-Za-z0-9+/=_-]+")).alias("s"))
        spans = spans.where(F.length("s.text") >= (r.min_length or ENTROPY_LENGTH)).where(scalars.entropy(F.col("s.text")) >= r.entropy_threshold)
        out.append(spans.select("doc_id", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), F.col("s.text").alias("text"), F.lit(r.entity_type).alias("entity_type"), F.lit(rank[r.entity_type]).alias("severity"), F.lit(0).alias("tier"), F.lit(r.id).alias("source"), F.lit(ENTROPY_CONFIDENCE).alias("confidence"), F.lit(i).alias("rule_ord")))
    return reduce(DataFrame.unionByName, out)


def tier0(docs: DataFrame, policy: Policy) -> DataFrame:
    """All rules of a policy over messages (doc_id, text)."""
    found = scan_regex_rules(docs, policy)
    if any(r.entropy_threshold is not None for r in policy.rules):
        found = found.unionByName(scan_entropy_rules(segments(docs), policy))
    return found


def with_severity(findings: DataFrame, entity_types: DataFrame) -> DataFrame:
    """Findings that were read off the texts themselves, with the policy's severity: nothing else can be wrong with them."""
    return findings.drop("severity").join(F.broadcast(entity_types.select("entity_type", "severity")), "entity_type").select(*[c for c in findings.columns if c != "severity"], "severity")


def normalised(findings: DataFrame, docs: DataFrame, entity_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound findings with the policy's severity, unsound ones with a reason); no reason holds the matched text."""
    j = findings.drop("severity").join(docs.select("doc_id", F.col("text").alias("message")), "doc_id", "left").join(F.broadcast(entity_types.select("entity_type", "severity")), "entity_type", "left")
    reason = (
        F.when(F.col("severity").isNull(), "unknown-type")
        .when((F.col("start") < 0) | (F.col("start") >= F.col("end")), "bad-offsets")
        .when(F.col("end") > F.length("message"), "out-of-range")
        .when(F.expr("substring(message, start + 1, end - start) <> text"), "text-mismatch")
    )
    j = j.withColumn("reason", reason)
    keep = [c for c in findings.columns if c != "severity"] + ["severity"]
    return j.where("reason is null").select(*keep), j.where("reason is not null").select("doc_id", "start", "end", "entity_type", "reason")


def uncertain_segments(segs: DataFrame, findings: DataFrame, below: float = UNCERTAIN) -> DataFrame:
    """Segments that a finding of less than ``below`` confidence overlaps."""
    if not 0 <= below <= 1:
        raise ValueError("below lies in [0, 1]")
    f = findings.where(F.col("confidence") < below).select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("end").alias("e"))
    return segs.join(f, (F.col("doc_id") == F.col("d")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_semi")


def escalated(segs: DataFrame, uncertain: DataFrame, has_predicates: bool) -> DataFrame:
    """Segments that go to the judge: uncertain ones, and all but code when there are predicates."""
    chosen = uncertain.select("doc_id", "start").distinct().withColumn("u", F.lit(True))
    j = segs.join(chosen, ["doc_id", "start"], "left")
    return j.where(F.col("u").isNotNull() | (F.lit(has_predicates) & (F.col("kind") != "code"))).drop("u")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def remaining_budget(latency: Column, elapsed: Column) -> Column:
    """What is left of a budget; null when nothing is, or it cannot be told."""
    left = latency - elapsed
    return F.when((left > 0) & ~F.isnan(left.cast("double")), F.least(left, F.lit(2147483647)))
