"""Toxicity by compression distance.

Zstandard dictionaries are trained on toxic and on ordinary labelled text, and a document's windows (about WINDOW bytes,
cut at white space) are compressed with both: what saves bytes with the toxic dictionary has toxic matter in it.

A toxic document is mostly ordinary text, so a dictionary trained on all of it says little. Training therefore has two
rounds. First the training documents are dealt into groups, dictionaries are trained on each group of either class, and
every document's short windows are compressed with those of all other groups: chance differences between two
dictionaries average out, toxic matter saves bytes with every one. Then the toxic dictionary is trained on the windows
of toxic documents whose mean saving reaches a threshold (one at which a window of a toxic document is ODDS times as
frequent as one of an ordinary document), and the ordinary dictionary on as many windows of ordinary documents, twice
over, those that look most toxic. Both follow one common stretch trained on ordinary windows, so that they differ in
nothing else. Several such pairs are trained; of these the one that ranks the calibration documents best is taken, and
then the one that adds most, up to PAIRS.

Calibration documents train no dictionary. Their windows give every saving a log-likelihood ratio (made monotone: the
thresholds on compression lengths with their weights), a document's ratios are summed over all its windows, and a
logistic curve turns the sum into a score. Near copies are taken out of the sample first.

Null and empty texts have no windows and get the score of a sum of 0; repeated rows and equal texts get equal scores;
long texts are read whole; an empty table gives an empty result; without labels of both classes every score is 0. Ties
in training go to the earlier window, in an order that depends on the sample alone. Only the text is an input of a score.
"""

from __future__ import annotations

import math
import random

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, mix, table, text_frame, word_hashes
from .labelled import give_back, remainder, training_rows

#: Labelled documents of each class that are read at most.
MOST = 2500
WINDOW, LEVEL, LEAST_MATCH = 96, 12, 3
#: First round: groups of documents, bytes of a group's dictionary, bytes of a window (both are tried).
GROUPS, GROUP_BYTES, SHORT = 6, 60_000, (20, 32)
#: Second round: bytes of the common stretch, and the odds, and what is tried for the bytes and the segments of the rest.
BASE_BYTES, ODDS, OWN_BYTES, SEGMENTS = 16_384, 5, (768, 1024, 1536), (12, 24)
#: Pairs of dictionaries that score; part of the sample that trains dictionaries; share of toxic documents that the
#: scores assume.
PAIRS, TRAINING, TOXIC_SHARE = 2, 0.6, 0.4
FOLD, HELD, THRESHOLD = 3, 1, 0.7

def windows(text: str, size: int = WINDOW) -> list[bytes]:
    data = text.lower().encode("utf-8", "surrogatepass")
    data = data.translate(_SPACES)
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + size)
        if end < n:
            cut = data.rfind(b" ", at + size // 2, end)
            end = cut if cut > 0 else end
        out.append(data[at:end] + b" ")
        at = end
    return out


_SPACES = bytes(0x20 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def triples(text: str) -> np.ndarray:
    """Hashes of the distinct word triples, ascending; of the whole text if it has fewer words."""
    words = text.lower().split()
    h, _ = word_hashes([" ".join(words).encode("utf-8", "surrogatepass")])
    n = len(h) - 2 if len(h) > 2 else 1
    out = np.full(n, min(3, len(h)), dtype=np.uint64)
    for k in range(min(3, len(h))):
        out = mix(out ^ h[k : k + n])
    return np.unique(out)


def apart(texts: list[str], most: float = 0.3) -> list[str]:
    """Texts that share at most this part of their word triples with those before. The triples seen are kept as hashes
    in sorted runs, each more than twice as long as the next: tuples of words take some twenty times the text."""
    runs: list[np.ndarray] = []
    out = []
    for t in texts:
        own = triples(t)
        known = np.zeros(len(own), dtype=bool)
        for r in runs:
            known |= r[np.minimum(np.searchsorted(r, own), len(r) - 1)] == own
        if known.sum() <= most * len(own):
            out.append(t)
        if not known.all():
            runs.append(own[~known])
        while len(runs) > 1 and len(runs[-2]) <= 2 * len(runs[-1]):
            runs[-2:] = [np.sort(np.concatenate(runs[-2:]))]
    return out


def monotone(values: list[float], weights: list[float]) -> list[float]:
    """Isotonic regression by pooling neighbours that are out of order."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [v for v, _, k in blocks for _ in range(int(k))]


#: Savings of one pair beyond these count like these.
LEAST, GREATEST = -6, 14


def content(sample: list[bytes], size: int, segment: int, run: int = 6) -> bytes:
    """A dictionary of ``size`` bytes trained on the sample; one too small to train on is its own dictionary."""
    if not sample:
        return b""
    try:
        return zstandard.train_dictionary(size, sample, k=segment, d=run, steps=0, split_point=1.0).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(sample)[-size:]


def compressor(dictionary: bytes, size: int, level: int):
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(level, source_size=size, dict_size=len(dictionary), write_content_size=0, write_dict_id=0, min_match=LEAST_MATCH, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


class Model:
    """Pairs of dictionaries (toxic, ordinary), ratios by bytes saved, and the logistic curve."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], ratios: list[float], curve: tuple[float, float]):
        self.pairs, self.ratios, self.curve = pairs, ratios, curve
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def savings(self, text: str) -> list[int]:
        """Bytes that each window saves with the toxic dictionaries."""
        if self._made is None:
            self._made = [[compressor(x, WINDOW, LEVEL) for x in pair] for pair in self.pairs]
        cut = windows(text)
        out = [0] * len(cut)
        for toxic, ordinary in self._made:
            out = [n + len(ordinary(w)) - len(toxic(w)) for n, w in zip(out, cut, strict=True)]
        return out

    def evidence(self, text: str) -> float:
        least, most, ratios = LEAST * len(self.pairs), GREATEST * len(self.pairs), self.ratios
        return sum([ratios[min(max(s, least), most) - least] for s in self.savings(text)])

    def score(self, text: str) -> float:
        if not self.pairs:
            return 0.0
        a, b = self.curve
        return 1 / (1 + math.exp(-min(max(a * self.evidence(text) + b, -40), 40)))


def mean_savings(toxic: list[str], ordinary: list[str], size: int) -> list[tuple[np.ndarray, list[bytes]]]:
    """(savings, windows) of either class's short windows: means over the dictionaries of all groups but the window's own."""
    groups = max(2, min(GROUPS, len(toxic) // 4, len(ordinary) // 4))
    dealt = [[[w for t in texts[k::groups] for w in windows(t, size)] for k in range(groups)] for texts in (toxic, ordinary)]
    pairs = [[compressor(content(of_class[k], GROUP_BYTES, 32), size, LEVEL) for of_class in dealt] for k in range(groups)]
    out = []
    for of_class in dealt:
        mean: list[np.ndarray] = []
        for k, sample in enumerate(of_class):
            total = np.zeros(len(sample))
            for j, (with_toxic, with_ordinary) in enumerate(pairs):
                if j != k:
                    total += [len(with_ordinary(w)) - len(with_toxic(w)) for w in sample]
            mean.append(total / (groups - 1))
        out.append((np.concatenate(mean), [w for sample in of_class for w in sample]))
    return out


def threshold_for(toxic: np.ndarray, ordinary: np.ndarray, odds: float) -> float:
    """The least saving that a window of a toxic document reaches ``odds`` times as often as one of an ordinary one."""
    for step in range(1, 2 * GREATEST):
        if (toxic >= step / 2).mean() >= odds * max((ordinary >= step / 2).mean(), 1 / len(ordinary)):
            return step / 2
    return float(np.quantile(toxic, 0.98))


def ranking(evidence: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counting half."""
    both, place, count = np.unique(evidence, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n = int(y.sum())
    return float((rank[y == 1].sum() - n * (n + 1) / 2) / max(1, n * (len(y) - n)))


def ratios_of(savings: np.ndarray, y: np.ndarray, pairs: int) -> np.ndarray:
    """Monotone log-likelihood ratio of every saving, from windows and the class of their documents."""
    least, most = LEAST * pairs, GREATEST * pairs
    at = np.clip(savings, least, most) - least
    seen = np.stack([np.bincount(at[y == k], minlength=most - least + 1) + 0.5 for k in (0, 1)])
    rates = seen / seen.sum(1, keepdims=True)
    return np.array(monotone(np.log(rates[1] / rates[0]).tolist(), seen.sum(0).tolist()))


def logistic(x: np.ndarray, y: np.ndarray, share: float = TOXIC_SHARE) -> tuple[float, float]:
    """Slope and intercept that fit y to x, class 1 having this share of the weight: Newton steps on the ridge-penalised
    likelihood."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    a, b = 0.5, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(weight * (p - y) * x).sum() + 1e-4 * a, (weight * (p - y)).sum() + 1e-4 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-4, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-4]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -0.5, 0.5)), b - float(np.clip(step[1], -1, 1))
    return a, b


def fit(rows: list[tuple[str, int]], seed: int = 5) -> Model:
    rng = random.Random(seed)
    toxic, ordinary = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    for x in (toxic, ordinary):
        rng.shuffle(x)
    toxic, ordinary = apart(toxic), apart(ordinary)
    if len(toxic) < 8 or len(ordinary) < 8:
        return Model([], [], (1.0, 0.0))
    cut_t, cut_o = (max(4, int(TRAINING * len(x))) for x in (toxic, ordinary))
    pieces = [w for t in ordinary[:cut_o] for w in windows(t)]
    rng.shuffle(pieces)
    base = content(pieces[:60_000], BASE_BYTES, 50, 8)
    tried = []
    for short in SHORT:
        (saved_t, of_toxic), (saved_o, of_ordinary) = mean_savings(toxic[:cut_t], ordinary[:cut_o], short)
        least = threshold_for(saved_t, saved_o, ODDS)
        picked = [of_toxic[k] for k in np.flatnonzero(saved_t >= least)]
        suspect = [of_ordinary[k] for k in np.argsort(-saved_o, kind="stable")[: 2 * len(picked)]]
        del of_toxic, of_ordinary
        tried += [(base + content(picked, size, segment), base + content(suspect, size, segment)) for size in OWN_BYTES for segment in SEGMENTS]
    # calibration documents: all windows in one list
    held = [(t, 1) for t in toxic[cut_t:]] + [(t, 0) for t in ordinary[cut_o:]]
    cut = [windows(t) for t, _ in held]
    y = np.array([k for _, k in held])
    owner = np.repeat(np.arange(len(held)), [len(x) for x in cut])
    flat = [w for x in cut for w in x]
    saved = []
    for pair in tried:
        with_toxic, with_ordinary = (compressor(x, WINDOW, LEVEL) for x in pair)
        saved.append(np.array([len(with_ordinary(w)) - len(with_toxic(w)) for w in flat], dtype=np.int64))
    chosen: list[int] = []
    total, ratios, evidence, best = np.zeros(len(flat), dtype=np.int64), np.zeros(1), np.zeros(len(held)), -1.0
    for n in range(1, PAIRS + 1):
        ranked = []
        for k in range(len(tried)):
            if k not in chosen:
                r = ratios_of(total + saved[k], y[owner], n)
                at = np.clip(total + saved[k], LEAST * n, GREATEST * n) - LEAST * n
                x = np.bincount(owner, weights=r[at], minlength=len(held))
                ranked.append((ranking(x, y), -k, r, x))
        value, k, r, x = max(ranked, key=lambda z: z[:2])
        if value <= best:
            break
        chosen.append(-k)
        total, ratios, evidence, best = total + saved[-k], r, x, value
    return Model([tried[k] for k in chosen], ratios.tolist(), logistic(evidence, y))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    work = lambda batch: {"doc_id": batch.column("doc_id"), "score": [shared.value.score(t) for t in batch.column("text").to_pylist()]}
    return map_batches(text_frame(docs), work, "doc_id long, score double")


def fitted(spark: SparkSession, sf_dir: str, most: int = MOST) -> Model:
    model = fit(training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", most, remainder(FOLD) != HELD))
    give_back()
    return model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: toxicity of all documents."""
    scored = score_documents(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    return scored.select("doc_id", (remainder(FOLD) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text scores below THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        from .common import chunks, texts_of

        for batch in batches:
            for part in chunks(batch):
                yield part.filter(np.array([shared.value.score(t) < THRESHOLD for t in texts_of(part)], dtype=bool))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)
