"""The span tagger's relational parts: labels, words, span grids, decoding. The model itself is a pluggable stage."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.offsets import find_spans
from ..functions.scalars import sigmoid
from ..sources.policy import EntityType, Policy

#: Letters, digits and underscores with inner joins, or any single visible character.
WORD = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|[^\s]"
FINDINGS = "doc_id long, start int, end int, text string, entity_type string, severity string, tier int, source string, confidence double"


def labels(policy: Policy, tier: int = 1) -> list[EntityType]:
    """Entity types of a tier, in policy order; the place is the class index."""
    return [e for e in policy.entity_types if e.tier == tier]


def prompt_form(e: EntityType, form: str) -> str:
    return {"id": e.id, "definition": e.definition, "id-and-definition": f"{e.id}: {e.definition}"}[form]


def words(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_no, word_no, start, end, word) with offsets in the message."""
    w = segments.select("doc_id", "seg_no", F.col("start").alias("at"), F.posexplode(find_spans(F.col("text"), WORD)).alias("word_no", "w"))
    return w.select("doc_id", "seg_no", "word_no", (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"), F.col("w.text").alias("word"))


def span_grid(rows: DataFrame, max_width: int) -> DataFrame:
    """Every span of at most ``max_width`` words of rows with ``n_words``."""
    first = rows.where("n_words > 0").withColumn("first_word", F.explode(F.sequence(F.lit(0), F.col("n_words") - 1)))
    width = first.withColumn("__w", F.explode(F.sequence(F.lit(0), F.lit(max_width - 1))))
    return width.withColumn("last_word", F.col("first_word") + F.col("__w")).where("last_word < n_words").drop("__w")


def decode_span_logits(rows: DataFrame, key: str, n_words: int, max_width: int, n_classes: int, threshold: float | None = 0.5, least_logit: float | None = None) -> DataFrame:
    """(key, word, width, class_index, score, logit) of flat logits [word, width, class] that reach a threshold."""
    if max_width < 1:
        raise ValueError("the greatest width is positive")
    cells = rows.where(F.size("logits") == n_words * max_width * n_classes).select(key, F.posexplode("logits").alias("i", "logit"))
    score = sigmoid(F.col("logit"))
    cells = cells.where(score >= threshold) if threshold is not None else cells.where(F.col("logit") >= least_logit)
    per = max_width * n_classes
    return cells.select(key, F.floor(F.col("i") / per).alias("word"), (F.floor(F.col("i") / n_classes) % max_width).alias("width"), (F.col("i") % n_classes).cast("long").alias("class_index"), score.alias("score"), "logit")


def decode_token_logits(logits: np.ndarray, threshold: float, max_width: int) -> list[tuple[int, int, int, float]]:
    """(first, last, class, score) from [word, class, (start, end, inside)]: a span grows while its inside score holds,
    and scores the least of its parts."""
    p = 1 / (1 + np.exp(-logits))
    out = []
    for first, c in zip(*np.nonzero(p[:, :, 0] >= threshold), strict=True):
        inside = np.inf
        for last in range(first, min(len(p), first + max_width)):
            inside = min(inside, p[last, c, 2])
            if inside < threshold:
                break
            if p[last, c, 1] >= threshold:
                out.append((int(first), int(last), int(c), float(min(p[first, c, 0], p[last, c, 1], inside))))
    return sorted(out, key=lambda x: (-x[3], x[0], x[1], x[2]))


#: White space and zero-width characters that never begin or end a span.
TRIMMABLE = frozenset("\t\n\v\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff\u200b\u200c\u200d") | {chr(c) for c in range(0x2000, 0x200B)}


def span_from_tokens(text: str, tokens: list[tuple[int, int]], first: int, last: int) -> tuple[int, int] | None:
    """(start, end) in ``text`` of the tokens first to last; nothing for indices or tokens that are malformed. Ends are
    trimmed, and combining marks after the end belong to it. Offsets count code points, so no pair can be split."""
    whole = lambda *v: all(isinstance(x, (int, np.integer)) and not isinstance(x, bool) for x in v)
    if not whole(first, last) or first < 0 or last < first or last >= len(tokens):
        return None
    start, end = tokens[first][0], tokens[last][1]
    if not 0 <= start < end <= len(text):
        return None
    if not all(whole(a, b) and start <= a < b <= end for a, b in tokens[first : last + 1]):
        return None
    while start < end and text[start] in TRIMMABLE:
        start += 1
    while end > start and text[end - 1] in TRIMMABLE:
        end -= 1
    if start >= end:
        return None
    while end < len(text) and unicodedata.category(text[end]).startswith("M"):
        end += 1
    return start, end


def encode_words(ids_of_words: list[list[int]], prompt: list[int], cls: int, sep: int, max_length: int) -> tuple[list[int], list[int]]:
    """Token ids and a mask that numbers the first piece of each word from 1; empty words go, the end is cut."""
    ids, mask = [cls, *prompt], [0] * (1 + len(prompt))
    for n, pieces in enumerate(ids_of_words, 1):
        ids += pieces
        mask += [n if i == 0 else 0 for i in range(len(pieces))]
    ids, mask = ids[: max_length - 1], mask[: max_length - 1]
    return [*ids, sep], [*mask, 0]


class Tagger(Protocol):
    """A model: segment texts to (start, end, entity type, score) of each."""

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]: ...


def tag(segments: DataFrame, load, policy: Policy, source: str = "tagger") -> DataFrame:
    """Findings of a tagger over segments; ``load()`` makes the model, once a Python worker."""
    severity = {e.id: e.severity for e in policy.entity_types}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            rows = []
            for r, spans in zip(frame.itertuples(index=False), model(frame["text"].tolist()), strict=True):
                for s, e, t, p in spans:
                    if t in severity and 0 <= s < e <= len(r.text) and np.isfinite(p):
                        rows.append((r.doc_id, r.start + s, r.start + e, r.text[s:e], t, severity[t], 1, source, float(p)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    return segments.select("doc_id", "start", "text").mapInPandas(run, FINDINGS)
