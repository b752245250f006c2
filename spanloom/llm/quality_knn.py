"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of terms: hashed byte pairs, hashed word shapes and a few measures of style (repetition of words and
lines, capitals, punctuation, digits, word lengths) cut into steps. Counts are damped, weighted by rarity over the
labelled sample and reduced by a truncated singular value decomposition. The labelled vectors (at most MOST of each
class, so their size is bounded) go to every task; each document's cosine with all of them is computed exactly, in
double precision and blocks of documents, and the NEIGHBOURS nearest vote with weights that fall off with their
distance; classes count alike, whatever their share of the sample.

Null and empty texts are scored like any other: they have no pairs and words, and their vector is that of the measures
of style, which are all at their ends. Repeated rows and equal texts get equal scores; of neighbours with one cosine at
the last place any may vote, the same for equal texts; long texts are read whole, in memory linear in one text; an empty
table gives an empty result; without labels of both classes every score is 0.5. Only the text is an input of a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, bounded_batches, map_batches, powers, table, text_frame
from .labelled import give_back, remainder, training_rows

#: Labelled documents of each class, dimensions of the space, neighbours that vote, sharpness of their weights.
MOST, DIMENSIONS, NEIGHBOURS, SHARPNESS = 2000, 48, 15, 8.0
PAIRS, STEPS = 768, 16
FOLD, THRESHOLD = 5, 0.3

_CLASS = np.zeros(256, dtype=np.int64)  # white space 0, lower 1, upper 2, digit 3, other ASCII 4, beyond ASCII 5
_CLASS[33:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 5
_CLASS[[c for c in range(33) if not SPACE[c]]] = 4
_U = np.uint64
STYLE = 10
TERMS = PAIRS + STYLE * STEPS


def terms(texts: list[str]) -> np.ndarray:
    """(texts, TERMS) damped counts."""
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((n, TERMS), dtype=np.float32)
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    owner = np.repeat(np.arange(n), np.diff(np.concatenate(([0], ends))))
    low = np.frombuffer(joined.translate(LOWER), dtype=np.uint8).astype(np.int64)
    pair = ((low[:-1] * 31 + low[1:]) * 40503 >> 4) % PAIRS
    within = owner[:-1] == owner[1:]
    counts = np.bincount(owner[:-1][within] * PAIRS + pair[within], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, :PAIRS] = np.log1p(counts)
    out[:, :PAIRS] /= np.maximum(np.linalg.norm(out[:, :PAIRS], axis=1, keepdims=True), 1e-9)
    kinds = np.bincount(owner * 6 + _CLASS[data], minlength=n * 6).reshape(n, 6).astype(float)
    chars = np.maximum(kinds[:, 1:].sum(1), 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    # words: repeats of the one before, distinct ones, endings
    inside = ~SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    words, repeats, distinct, odd_end = np.ones(n), np.zeros(n), np.ones(n), np.zeros(n)
    if len(starts):
        lengths = stops - starts
        where = np.flatnonzero(inside)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(len(where)) - np.repeat(first, lengths)
        h = np.add.reduceat((low[where].astype(np.uint64) + _U(1)) * powers(int(lengths.max()))[place], first)
        who = owner[starts]
        words = np.maximum(np.bincount(who, minlength=n), 1)
        same = (h[1:] == h[:-1]) & (who[1:] == who[:-1])
        repeats = np.bincount(who[1:][same], minlength=n)
        order = np.lexsort((h, who))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (who[order][1:] != who[order][:-1])
        distinct = np.bincount(who[order][new], minlength=n)
        last = _CLASS[data[stops - 1]]
        odd_end = np.bincount(who[last == 4], minlength=n)
    style = [
        repeats / words,
        1 - distinct / words,
        kinds[:, 2] / letters,
        kinds[:, 4] / chars,
        kinds[:, 3] / chars,
        odd_end / words,
        kinds[:, 5] / chars,
        np.minimum(chars / words / 16, 1),
        np.minimum(np.log1p(words) / 12, 1),
        np.array([1 - len(set(x)) / len(x) if (x := r.split(b"\n")) else 0 for r in raw]),
    ]
    for k, x in enumerate(style):
        # a soft step: what lies between two steps counts for both
        at = np.clip(np.sqrt(np.clip(x, 0, 1)) * (STEPS - 1), 0, STEPS - 1)
        lo = np.floor(at).astype(int)
        part = at - lo
        base = PAIRS + k * STEPS
        out[np.arange(n), base + lo] += 0.35 * (1 - part)
        out[np.arange(n), base + np.minimum(lo + 1, STEPS - 1)] += 0.35 * part
    return out


class Space:
    """The latent space with its labelled vectors."""

    def __init__(self, rarity: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.rarity, self.axes, self.vectors, self.labels = rarity, axes, vectors, labels

    def place(self, texts: list[str]) -> np.ndarray:
        x = (terms(texts) * self.rarity).astype(np.float64) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vote(self, texts: list[str], block: int = 512) -> np.ndarray:
        if len(set(self.labels.tolist())) < 2:
            return np.full(len(texts), 0.5)
        out = np.zeros(len(texts))
        share = np.array([(self.labels == 0).mean(), (self.labels == 1).mean()])
        for at in range(0, len(texts), block):
            near = self.place(texts[at : at + block]) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            cos = np.take_along_axis(near, top, 1)
            y = self.labels[top]
            weight = np.exp(SHARPNESS * (cos - cos.max(1, keepdims=True)) / np.maximum(1 - cos.min(1, keepdims=True), 1e-6) / 2) / share[y]
            out[at : at + block] = (weight * y).sum(1) / weight.sum(1)
        return out


def fit(rows: list[tuple[str, int]], dimensions: int = DIMENSIONS) -> Space:
    labels = np.array([y for _, y in rows], dtype=int)
    if len(set(labels.tolist())) < 2:
        return Space(np.ones(TERMS, dtype=np.float32), np.zeros((TERMS, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), labels)
    texts = [t for t, _ in rows]
    x = np.concatenate([terms(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    rarity = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    rarity[PAIRS:] = 1
    x = x * rarity
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, np.argsort(-values)[:dimensions]]
    y = x.astype(np.float64) @ axes
    return Space(rarity, axes, y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9), labels)


def score_documents(docs: DataFrame, space: Space) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    work = lambda batch: {"doc_id": batch.column("doc_id"), "score": shared.value.vote(batch.column("text").to_pylist())}
    return map_batches(text_frame(docs), work, "doc_id long, score double")


def fitted(spark: SparkSession, sf_dir: str, most: int = MOST) -> Space:
    """The space fitted on the training fold of a data folder."""
    model = fit(training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", most, remainder(FOLD) != 0))
    give_back()
    return model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: quality of all documents."""
    scored = score_documents(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    return scored.select("doc_id", (remainder(FOLD) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, space: Space) -> DataFrame:
    """The rows of ``docs`` whose text scores at least THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def work(batches):
        from .common import chunks, texts_of

        for batch in batches:
            for part in chunks(batch):
                yield part.filter(shared.value.vote(texts_of(part)) >= THRESHOLD)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)
