"""Document fingerprints from chains of content words that follow common words.

An anchor is a word of ANTECEDENTS, a word whose hash falls into one of ANCHOR_ONE_IN classes (so that texts in other
languages have anchors too) or the head of the text. The CHAIN next content words after an anchor, whatever common
words lie between, make a signature together with it. A fingerprint is the set of a text's signatures, written as
base64 of its sorted 32-bit hashes; two fingerprints are compared by the Jaccard coefficient of their sets. Sets are
partitioned by length into bands, and only sets of one band or of neighbouring ones are compared at all: farther apart,
the shorter set is too small a part of the longer one. A comparison goes through the sets a stretch at a time and stops
as soon as what is left cannot reach the threshold (LEAST for a text against its edited text and the next one, where
less counts as no likeness; 0.8 for near-duplicates).

Null counts as empty; texts without words have the empty fingerprint, whose likeness to another empty one is 1 and to
any other 0. Equal texts have equal fingerprints. Rows with one id are ordered by text; texts are read whole, in memory
linear in one text; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, chunks, cut, map_batches, mix, powers, table, text_frame, texts_of

CHAIN, ANCHOR_ONE_IN = 2, 12
#: Likeness below this counts as none; signatures that are compared before the bound is looked at again.
LEAST, STRETCH = 0.05, 256
#: Texts of fewer words have a signature for each word as well: a single chain would say too little about them.
SHORT = 16

# Common words of English, French, German and Spanish.
ANTECEDENTS = """
a an and are as at be by for from had has he in is it of on that the this to was were which with
au aux avec dans de des du elle en est et il la le les ne par pas pour que qui se sur un une
als auf aus bei das dem den der des die ein eine einen er für im ist mit nicht sich sie und von war zu
al como con del el ella es lo los las más no o para por su sus una y
""".split()

_U = np.uint64
#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the text number of each."""
    data = np.frombuffer(b"\n".join(texts).translate(LOWER), dtype=np.uint8)
    inside = _INSIDE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = (data[inside].astype(np.uint64) + _U(1)) * powers(int(lengths.max()))[place]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return mix(np.add.reduceat(value, first) ^ (lengths.astype(np.uint64) << _U(48))), np.searchsorted(bounds, starts, side="right")


_COMMON = np.unique(np.concatenate([_words([w.encode()])[0] for w in sorted(set(ANTECEDENTS))]))


def signature_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of every text."""
    words, owner = _words([t.encode("utf-8", "surrogatepass") for t in texts])
    n = len(words)
    if not n:
        return [np.zeros(0, dtype=np.uint32)] * len(texts)
    common = np.isin(words, _COMMON)
    content = np.flatnonzero(~common)
    head = np.ones(n, dtype=bool)
    head[1:] = owner[1:] != owner[:-1]
    anchors = np.flatnonzero(common | (words % _U(ANCHOR_ONE_IN) == 0))
    heads = np.flatnonzero(head)

    def chains(at: np.ndarray, name: np.ndarray, after: np.ndarray) -> np.ndarray:
        sig = mix(name + _U(0x51ED270B))
        k = np.searchsorted(content, after)
        for step in range(CHAIN):
            which = np.minimum(k + step, max(len(content) - 1, 0))
            there = (k + step < len(content)) & (owner[content[which]] == owner[at]) if len(content) else np.zeros(len(at), dtype=bool)
            word = np.where(there, words[content[which]], _U(0)) if len(content) else np.zeros(len(at), dtype=np.uint64)
            sig = mix(sig * _U(0x9FB21C651E98DF25) + word)
        return sig

    short = np.flatnonzero(np.bincount(owner, minlength=len(texts))[owner] < SHORT)
    sig = np.concatenate([chains(anchors, words[anchors], anchors + 1), chains(heads, np.zeros(len(heads), dtype=np.uint64), heads), mix(words[short] + _U(0x2545F491))])
    sig = (sig >> _U(32)).astype(np.int64) | (owner[np.concatenate([anchors, heads, short])] << 32)
    sig = np.unique(sig)
    bounds = np.searchsorted(sig >> 32, np.arange(len(texts) + 1))
    low = (sig & 0xFFFFFFFF).astype("<u4")
    return [low[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def written(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def band(n: int, least: float) -> int:
    """The length partition of a set of n signatures: sets that reach ``least`` lie in one band or in neighbours."""
    return int(math.floor(math.log(n) / math.log(1 / least) + 1e-9))


def likeness(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Jaccard of two sorted sets of distinct signatures; 0 if it is below ``least``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 1.0 if not len(b) else 0.0
    if band(len(b), least) - band(len(a), least) > 1 or len(a) < least * len(b):
        return 0.0
    total, same = len(a) + len(b), 0
    for at in range(0, len(a), STRETCH):
        part = a[at : at + STRETCH]
        same += int(np.count_nonzero(b[np.minimum(np.searchsorted(b, part), len(b) - 1)] == part))
        most = same + len(a) - at - len(part)  # if all that is left were shared
        if most < least * (total - most):
            return 0.0
    found = same / (total - same)
    return found if found >= least else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, n_signatures)."""

    def work(batch):
        sets = signature_sets(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "fingerprint": [written(s) for s in sets], "n_signatures": [len(s) for s in sets]}

    return map_batches(text_frame(docs), work, "doc_id long, fingerprint string, n_signatures int")


def similar_pairs(prints: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs of different fingerprints with a Jaccard of at least ``percent``: (a, b, likeness), a and b being the least
    doc_id of their class; documents with equal fingerprints are one class and are not paired.

    Sets are partitioned by length: lengths within one factor of percent / 100 share a band, and a set is posted in its
    own band and the next, so every pair that can qualify meets in the band of its longer set. Within a band sets meet
    under the signatures of their prefix, rarest first, so that a frequent passage does not bring everything together.
    """
    share = percent / 100
    classes = cut(prints.where("n_signatures > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.first("n_signatures").alias("n")), "prints")
    explode = classes.mapInArrow(_exploded, "id long, n int, s long")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / share))).cast("int")
    posted = explode.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("own", F.col("band") == band)
    often = posted.groupBy("band", "s").agg(F.count("*").alias("df")).where("df > 1")
    shared = posted.join(often, ["band", "s"])
    ranked = Window.partitionBy("band", "id").orderBy("df", "s")
    lone = F.col("n") - F.count("*").over(Window.partitionBy("band", "id"))
    # the prefix of a set of n: n - ceil(percent n / 100) + 1 signatures, those that no other set has counted first
    long = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    kept = shared.withColumn("r", F.row_number().over(ranked) + lone).where(F.col("r") <= long).select("band", "s", "id", "n", "own")
    left, right = kept.where("own").alias("l"), kept.alias("r")
    near = (F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * percent) & (F.col("l.id") != F.col("r.id"))
    pairs = left.join(right, ["band", "s"]).where(near).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    side = lambda c, x: classes.select(F.col("id").alias(c), F.col("fingerprint").alias(x))

    def compare(batches):
        for batch in batches:
            value = [likeness(read(x), read(y), share) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value, pa.float64())], ["a", "b", "likeness"])
            yield out.filter(np.array(value) >= share - 1e-12)

    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, likeness double")


def _exploded(batches):
    for batch in batches:
        for ids in chunks(batch, "fingerprint"):
            sets = [read(x) for x in ids.column("fingerprint").to_pylist()]
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(ids.column("id")), sizes)), pa.array(np.repeat(np.asarray(ids.column("n")), sizes)), pa.array(np.concatenate(sets).astype(np.int64))], ["id", "n", "s"])


# ---------------------------------------------------------------- a text, its edited text and the next one

COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _run_of(ids: list, texts: list[str]) -> dict:
    """Every text but the last against the one after it."""
    changed = [edited(t, a) for t, a in zip(texts[:-1], texts[1:], strict=True)]
    n = len(changed)
    sets = signature_sets([*texts, *changed])
    own, new = sets[: n + 1], sets[n + 1 :]
    return {
        "doc_id": ids[:-1],
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [written(s) for s in own[:-1]],
        "edited_fingerprint": [written(s) for s in new],
        "near_edited": [likeness(a, b) for a, b in zip(own[:-1], new, strict=True)],
        "near_next": [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
    }


def against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to it and to the next text by descending id.

    Ids are cut into ranges at quantiles, read from the id column alone. Texts are dealt once, a range a task, and the head of
    each range is dealt to the range before it as well, so a task that walks its range in order has all it needs."""
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = text_frame(docs).withColumn("id", F.coalesce("doc_id", F.lit(low)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    ids = rows.select("id")
    cuts = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))  # a number a range
    range_of = lambda x: len(cuts) - np.searchsorted(cuts, x, side="left")  # noqa: E731  descending: the greatest ids are in range 0

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(range_of(x.to_numpy()).astype(np.int32))

    heads = sorted((int(r[0]), int(r[1])) for r in ids.groupBy(part_of("id").alias("part")).agg(F.max("id")).collect())  # two numbers a range
    before = {head: heads[k - 1][0] for k, (_, head) in enumerate(heads)}  # the range that waits for this head
    if not before:
        return spark.createDataFrame([], COMPARED)
    guest = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])[F.col("id")] if len(before) < 200 else _lookup(before)(F.col("id"))
    place = F.struct(part_of("id").alias("part"), F.lit(0).alias("guest"))
    placed = rows.withColumn("guest_of", guest).withColumn("at", F.explode(F.filter(F.array(place, F.when(F.col("guest_of").isNotNull(), F.struct(F.col("guest_of").cast("int").alias("part"), F.lit(1).alias("guest")))), lambda x: x.isNotNull())))
    dealt = placed.select(F.col("at.part").alias("part"), F.col("at.guest").alias("guest"), "id", "doc_id", "text").repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "guest", F.desc("id"), "text")

    def walk(batches):
        part, last, ended = None, None, False
        for batch in batches:
            for piece in chunks(batch):
                where, guests = piece.column("part").to_pylist(), piece.column("guest").to_pylist()
                ids, texts = piece.column("doc_id").to_pylist(), texts_of(piece)
                run_ids, run_texts = [], []

                def done(run_ids=run_ids, run_texts=run_texts):
                    if len(run_ids) > 1:
                        yield _record(_run_of(run_ids, run_texts))

                if last is not None:
                    run_ids.append(last[0])
                    run_texts.append(last[1])
                for p, g, i, t in zip(where, guests, ids, texts, strict=True):
                    if p != part:
                        yield from done()
                        run_ids.clear()
                        run_texts.clear()
                        part, ended = p, False
                    if not ended:
                        run_ids.append(i)
                        run_texts.append(t)
                    ended = ended or g == 1  # equal ids may send more than one guest: the first in order counts
                yield from done()
                last = (run_ids[-1], run_texts[-1]) if run_ids else None

    return dealt.mapInArrow(walk, COMPARED)


def _lookup(numbers: dict[int, int]):
    @F.pandas_udf("int")
    def find(x: pd.Series) -> pd.Series:
        return x.map(numbers).astype("Int32")

    return find


_ARROW = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for c, k in (x.split() for x in COMPARED.split(", "))])


def _record(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in _ARROW], schema=_ARROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprints of all documents and their edited texts."""
    return against_next(table(spark, sf_dir, "documents"))
