"""The judge's text handling: parsing constrained answers, and locating quotes and mentions in a message."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.policy import Policy
from .tagging import FINDINGS

#: Words that a shortened quote keeps at least.
LEAST_WORDS = 3

# Typographic characters and what they are compared as.
FOLDED = {"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-"}


def fold(text: str) -> tuple[str, list[int]]:
    """Text for comparison, and the place of each of its characters in the original: case, quotes, dashes and runs of
    white space do not count. A character whose lower case has another length keeps its case."""
    out, places, space = [], [], False
    for i, c in enumerate(text):
        if c.isspace() or c == "﻿":
            if not space:
                out.append(" ")
                places.append(i)
            space = True
            continue
        space = False
        low = c.lower()
        out.append(FOLDED.get(c, low if len(low) == 1 else c))
        places.append(i)
    return "".join(out), places


def _hits(text: str, part: str) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def resolve_quote(message: str, quote: str) -> tuple[int, int, int] | None:
    """(start, end, rung) of a quote. Rung 1: it occurs once. Rung 2: it is shortened from its end, a character at a
    time and to three words at least, until it occurs; once is taken, more than once is refused."""
    text, places = fold(message)
    want = fold(quote)[0].strip()
    if not want:
        return None
    hits = _hits(text, want)
    if len(hits) > 1:
        return None
    rung = 1
    while not hits:
        rung, want = 2, want[:-1].rstrip()
        if len(want.split()) < LEAST_WORDS:
            return None
        hits = _hits(text, want)
        if len(hits) > 1:
            return None
    return places[hits[0]], places[hits[0] + len(want) - 1] + 1, rung


def resolve_mention(text: str, mention: str) -> tuple[int, int] | None:
    """A mention that occurs once, on word boundaries, and has a letter or digit."""
    folded, places = fold(text)
    want = fold(mention)[0].strip()
    if not any(c.isalnum() for c in want):
        return None
    edge = lambda a, b: not (a.isalnum() and b.isalnum())
    hits = [h for h in _hits(folded, want) if (h == 0 or edge(folded[h - 1], want[0])) and (h + len(want) == len(folded) or edge(want[-1], folded[h + len(want)]))]
    return (places[hits[0]], places[hits[0] + len(want) - 1] + 1) if len(hits) == 1 else None


def locate(message: str, quote: str, mention: str | None) -> tuple[str, tuple[int, int] | None, tuple[int, int] | None]:
    """(verdict, evidence span, action span): the quote first, then the mention within it; a mention that is the whole
    quote acts on the clause. Refusals name what could not be placed."""
    q = resolve_quote(message, quote)
    if q is None:
        return "evidence", None, None
    evidence = (q[0], q[1])
    if mention is None or fold(mention)[0].strip() == fold(quote)[0].strip():
        return "located", evidence, evidence
    m = resolve_mention(message[q[0] : q[1]], mention)
    if m is None:
        return "mention", evidence, None
    return "located", evidence, (q[0] + m[0], q[0] + m[1])


def classify_prefix(text: str) -> str:
    """complete, truncated or malformed, by a structural scan of what may be the head of a JSON value."""
    decoder = json.JSONDecoder()
    body = text.strip()
    if not body:
        return "truncated"
    try:
        _, end = decoder.raw_decode(body)
        return "complete" if not body[end:].strip() else "malformed"
    except json.JSONDecodeError:
        pass
    stack, in_text, escaped = [], False, False
    for c in body:
        if in_text:
            in_text, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
            continue
        if c == '"':
            in_text = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]":
            if not stack or {"}": "{", "]": "["}[c] != stack.pop():
                return "malformed"
    if not stack and not in_text:
        return "malformed" if body[0] in "{[" or not re.fullmatch(r"-?[0-9.eE+-]*|t|tr|tru|f|fa|fal|fals|n|nu|nul", body) else "truncated"
    # a head that some ending completes
    ends = ["", "0", "null", '"', "}", '":null', ":null", '"x":null']
    close = "".join("}" if s == "{" else "]" for s in reversed(stack))
    base = body + ('"' if in_text and not escaped else '\\"' if in_text else "")
    for tail in ends:
        for cut_ in (base, base.rstrip(", \n")):
            try:
                json.loads(cut_ + tail + close)
                return "truncated"
            except json.JSONDecodeError:
                continue
    for part in ("true", "false", "null"):
        for k in range(1, len(part)):
            if base.endswith(part[:k]):
                try:
                    json.loads(base + part[k:] + close)
                    return "truncated"
                except json.JSONDecodeError:
                    continue
    return "malformed"


def parse_answer(text: str | None, finish: str | None, fields: dict[str, type]) -> tuple[str, list[dict]]:
    """(outcome, findings): ok, or the failure class aborted, truncated, malformed or schema."""
    if text is None or finish == "abort":
        return "aborted", []
    state = classify_prefix(text)
    if state != "complete":
        return ("truncated" if state == "truncated" or finish == "length" else "malformed"), []
    value = json.loads(text)
    rows = value.get("findings") if isinstance(value, dict) and set(value) == {"findings"} else None
    if not isinstance(rows, list) or any(not isinstance(r, dict) or set(r) != set(fields) or any(not isinstance(r[k], t) for k, t in fields.items()) for r in rows):
        return "schema", []
    return "ok", rows


FIELDS = {"predicate": str, "quote": str, "mention": str}
#: An engine: prompts to (text, finish reason).
Engine = Callable[[list[str]], list[tuple[str | None, str | None]]]


def judge(passages: DataFrame, make_engine: Callable[[], Engine], policy: Policy, budget_s: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """passages (doc_id, start, text, prompt) to (findings, notices), with one repaired retry of an unusable answer.

    The engine is made once a Python worker and called a batch at a time; a batch past the budget is reported as
    degraded and never merged late."""
    severity = {p[0]: "high" for p in policy.predicates}
    columns = [c.split()[0] for c in FINDINGS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, began = make_engine(), time.monotonic()
        for frame in frames:
            out = []
            late = time.monotonic() - began > budget_s
            answers = [(None, "abort")] * len(frame) if late else engine(frame["prompt"].tolist())
            parsed = [parse_answer(t, f, FIELDS) for t, f in answers]
            again = [i for i, (o, _) in enumerate(parsed) if o in ("truncated", "malformed", "schema")]
            if again and not late:
                for i, (t, f) in zip(again, engine([frame["prompt"].iat[i] + "\n\nAnswer again with JSON of the asked form only." for i in again]), strict=True):
                    parsed[i] = parse_answer(t, f, FIELDS)
            for r, (outcome, rows) in zip(frame.itertuples(index=False), parsed, strict=True):
                if outcome != "ok":
                    out.append((r.doc_id, -1, -1, "call-budget-exhausted" if outcome == "aborted" else "failed-closed", "", "", 2, "notice", 0.0))
                    continue
                seen = set()
                for x in rows:
                    verdict, _, span = locate(r.text, x["quote"], x["mention"] or None)
                    key = (span, x["predicate"])
                    if verdict == "located" and x["predicate"] in severity and key not in seen:
                        seen.add(key)
                        s, e = span
                        out.append((r.doc_id, r.start + s, r.start + e, r.text[s:e], "pred:" + x["predicate"], severity[x["predicate"]], 2, "judge", 1.0))
            yield pd.DataFrame(out, columns=columns)

    every = passages.select("doc_id", "start", "text", "prompt").mapInPandas(run, FINDINGS)
    from pyspark.sql import functions as F

    return every.where("source <> 'notice'"), every.where("source = 'notice'").select("doc_id", F.lit("tier2").alias("tier"), F.col("text").alias("reason"))


def judged_unit(family: Column, scopes: Column) -> Column:
    """What an arm judges: whole messages for a baseline, and what its predicates' scopes name for a compiled policy;
    a compiled policy without any scope is an error."""
    segment, message = F.array_contains(scopes, "segment"), F.array_contains(scopes, "message")
    return F.when(family != "compiled", "message").when(segment & message, "segment+message").when(segment, "segment").when(message, "message").otherwise(F.raise_error(F.lit("a compiled policy without scopes")).cast("string"))
