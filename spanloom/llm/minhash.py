"""Near-duplicates by an inverted join on the coordinates of MinHash signatures.

A document's set is its distinct word shingles (64-bit hashes). Documents with equal sets form one class at once; the
rest of the work is on classes. A class is posted under each of its (coordinate, value) pairs. A pair of classes is a
candidate if at least MATCHES of the COORDINATES agree, so it must meet in the rarest
``shared postings - MATCHES + 1`` postings of each (prefix merging; postings of one class never count), and the other
postings are skipped. Candidates are confirmed by the exact Jaccard of their full sets.

Only connectivity is wanted, and no step writes all pairs of a group. First, the classes of each posting are compared
by signature, and each task writes a spanning forest of its candidate pairs: their components are families, and every
pair that can link lies in one. Then the full sets of a family meet: intersections of its pairs are one product of
incidence matrices, and again only a spanning forest of the links goes on. With similarity exactly at 0.8 a pair has
about 51 matching coordinates of 64, standard deviation 3.2; fewer than MATCHES = 32 happen to one such pair in some
50 million.

A posting or family of more than BLOCK classes is never one task, nor are all pairs of its blocks. It is dealt into
blocks at random (a family twice over, a posting differently from every other) and compared within them, which is
linear in its size. What is then connected needs no further comparison: only the classes outside the largest
component of their posting or family are compared with the others of it, block by block. A group of near copies is
connected by the first step, so the second has next to nothing to do, and no pair that could link two components is
left out. Counts are aggregated before the shuffle, hot keys meet their counts by broadcast, and full sets are made only
for members of families, in a second scan through a bitmap of fixed size (a filter that may let more pass, never fewer).

Null or blank texts have no set: they link with nothing and stay. Equal rows are one class; the least doc_id of a
component is its representative (ties, which are rows of one id with several texts, go to the least digest of a text).
Long texts are read whole, in memory linear in one text. An empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut, hot_join, map_batches, merged, mix, table, text_frame, word_hashes

COORDINATES, MATCHES = 64, 32
#: Classes of a posting or family that are compared with as many others at once.
BLOCK = 1024
#: Bits of the candidate bitmap are 64 times this.
BITMAP_WORDS = 1 << 17

_U = np.uint64
_keys = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
_XOR, _MUL = _keys[:COORDINATES], _keys[COORDINATES:] | _U(1)


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and len(texts) + 1 bounds."""
    words, owner = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    mixed = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        part = words[k : len(words) - width + 1 + k]
        mixed = mix(mixed * _U(0x9FB21C651E98DF25) + part)
    whole = owner[: len(mixed)] == owner[width - 1 :] if len(mixed) else np.zeros(0, dtype=bool)
    values, owners = mixed[whole], owner[: len(mixed)][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = []
        for d in short:
            h = np.zeros(1, dtype=np.uint64)
            for w in words[first[d] : first[d] + counts[d]]:
                h = mix(h * _U(0x9FB21C651E98DF25) + w)
            extra.append(mix(h + _U(int(counts[d]))))
        values, owners = np.concatenate([values, *extra]), np.concatenate([owners, short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) int32; rows of empty sets are 0."""
    out = np.zeros((len(bounds) - 1, COORDINATES), dtype=np.int32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[:-1][full]
        for k in range(COORDINATES):
            out[full, k] = (np.minimum.reduceat((values ^ _XOR[k]) * _MUL[k], starts) >> _U(32)).astype(np.uint32).view(np.int32)
    return out


def class_of(members: np.ndarray) -> int | None:
    """A 64-bit name of a set; null for the empty set."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True) if len(members) else None


def sketches(docs: DataFrame, width: int) -> DataFrame:
    def work(batch):
        values, bounds = shingles(batch.column("text").to_pylist(), width)
        return {
            "doc_id": batch.column("doc_id"),
            "h": batch.column("h"),
            "n_shingles": np.diff(bounds),
            "node": [class_of(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
            "sig": list(signatures(values, bounds)),
        }

    return map_batches(text_frame(docs).withColumn("h", F.xxhash64("text")), work, "doc_id long, h long, n_shingles long, node long, sig array<int>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, members) of the wanted (node, doc_id) rows, by a second scan of the texts."""
    h = F.xxhash64("doc_id")
    words = wanted.select(F.pmod(F.shiftright(h, 6), F.lit(BITMAP_WORDS)).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))").alias("bit"))
    bitmap = np.zeros(BITMAP_WORDS, dtype=np.int64)
    for w, bits in words.groupBy("w").agg(F.bit_or("bit")).toLocalIterator():  # BITMAP_WORDS rows at most
        bitmap[w] = bits
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def work(batch):
        h = np.asarray(batch.column("h"))
        hit = np.flatnonzero((shared.value[(h >> 6) % BITMAP_WORDS] >> (h % 64)) & 1)
        values, bounds = shingles(batch.column("text").take(hit).to_pylist(), width)
        sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return {"doc_id": batch.column("doc_id").take(hit), "node": [class_of(s) for s in sets], "members": [s.tobytes() for s in sets]}

    made = map_batches(text_frame(docs).withColumn("h", h), work, "doc_id long, node long, members binary")
    w = wanted.select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"))
    return made.join(w, (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").groupBy("node").agg(F.first("members").alias("members"))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph given as a symmetric boolean matrix."""
    n, out = len(linked), []
    new = np.ones(n, dtype=bool)
    for start in range(n):
        if not new[start]:
            continue
        new[start] = False
        front = [start]
        while front:
            i = front.pop()
            reached = np.flatnonzero(linked[i] & new)
            new[reached] = False
            out += [(i, int(j)) for j in reached]
            front += reached.tolist()
    return out


def _whole_groups(batches, keys: list[str]):
    """Tables of whole groups with the bounds of each, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []

    def ready(t: pa.Table, last: bool):
        columns = [np.asarray(t.column(k)) for k in keys]
        change = np.zeros(t.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = np.concatenate(([0], np.flatnonzero(change), [t.num_rows]))
        return bounds if last else bounds[:-1]

    for batch in batches:
        held.append(batch)
        t = pa.Table.from_batches(held)
        bounds = ready(t, False)
        if bounds[-1] > 0:
            yield t.slice(0, bounds[-1]), bounds
            held = t.slice(bounds[-1]).to_batches()
    if held and sum(b.num_rows for b in held):
        t = pa.Table.from_batches(held)
        yield t, ready(t, True)


def _within_blocks(rows: DataFrame, key: str, times: int = 1) -> DataFrame:
    """Deals the rows (key, node, n_blocks, ...) of each key into its blocks, ``times`` times over if there are several."""
    again = F.when(F.col("n_blocks") > 1, F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("time", F.explode(again)).withColumn("block", F.pmod(F.xxhash64(key, "node", "time"), F.col("n_blocks")).cast("int"))
    return dealt.repartition(key, "time", "block").sortWithinPartitions(key, "time", "block")


def _rest_with_all(rows: DataFrame, key: str, grouped: DataFrame, more: DataFrame) -> DataFrame | None:
    """Pairs of blocks in which the classes outside a key's largest component (guests) meet all classes of the key.

    rows (key, node, n_blocks) of the keys with several blocks; grouped (node, component) of what is connected so far;
    more (node, ...) is what the comparison reads. None if every key is one component."""
    told = cut(rows.join(grouped, "node", "left").select(key, "node", "n_blocks", F.coalesce("component", "node").alias("label")), "labels")
    sizes = told.groupBy(key, "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy(key).agg(F.max(F.struct("n", "label"))["label"].alias("main"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0").select(key, "main", F.ceil(F.col("rest") / BLOCK).cast("int").alias("n_guests"))
    main = cut(main, "mains")
    if not main.limit(1).count():
        return None
    marked = hot_join(told, main, key).where("main is not null").join(more, "node")
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), key, "node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = marked.withColumn("block", place(1, "n_blocks")).withColumn("guests", upto("n_guests")).withColumn("guest", F.lit(0))
    guests = marked.where("label <> main").withColumn("guests", place(2, "n_guests")).withColumn("block", upto("n_blocks")).withColumn("guest", F.lit(1))
    return home.unionByName(guests).repartition(key, "guests", "block").sortWithinPartitions(key, "guests", "block", "guest")


def _bridges(linked: np.ndarray, guests: list[int], home: list[int], of_guest: np.ndarray, of_home: np.ndarray) -> list[tuple[int, int]]:
    """One pair for each guest and each other component that it is linked with. linked (guests, home)."""
    out = []
    linked = linked & (of_guest[:, None] != of_home[None])
    for g in np.flatnonzero(linked.any(1)):
        hit = np.flatnonzero(linked[g])
        _, first = np.unique(of_home[hit], return_index=True)
        out += [(guests[g], home[hit[k]]) for k in first]
    return out


def _edges(pairs: list) -> pa.RecordBatch:
    a, b = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, dtype=np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _alike(own: np.ndarray, others: np.ndarray, n_own: np.ndarray, n_others: np.ndarray, percent: int) -> np.ndarray:
    """Which signatures and set sizes are those of candidates."""
    agree = np.stack([(others == r).sum(1) for r in own]) >= MATCHES
    return agree & (100 * np.minimum(n_own[:, None], n_others[None]) >= percent * np.maximum(n_own[:, None], n_others[None]))


def _signatures_in(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(t.column("node")), np.asarray(t.column("n")), np.frombuffer(b"".join(t.column("sig8").to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def candidate_forest(posts: DataFrame, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the candidates in each block of a posting. posts (token, node, n_blocks, n, sig8),
    where sig8 holds a byte of every coordinate: bytes agree at least as often as coordinates, so no candidate is lost."""

    def run(batches):
        for t, bounds in _whole_groups(batches, ["token", "block"]):
            node, n, sig = _signatures_in(t)
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            x, y = two, two + 1
            ok = ((sig[x] == sig[y]).sum(1) >= MATCHES) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            found = list(zip(node[x[ok]].tolist(), node[y[ok]].tolist(), strict=True))
            for k in np.flatnonzero(size > 2):
                s = slice(bounds[k], bounds[k + 1])
                names = node[s].tolist()
                found += [(names[p], names[q]) for p, q in forest(_alike(sig[s], sig[s], n[s], n[s], percent))]
            yield _edges(found)

    return _within_blocks(posts, "token").mapInArrow(run, "a long, b long")


def _candidate_bridges(meeting: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) between components that meet in a hot posting; meeting is what _rest_with_all deals."""

    def run(batches):
        for t, bounds in _whole_groups(batches, ["token", "guests", "block"]):
            node, n, sig = _signatures_in(t)
            label, guest = np.asarray(t.column("label")), np.asarray(t.column("guest")) == 1
            found = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                g, h = a + np.flatnonzero(guest[a:b]), a + np.flatnonzero(~guest[a:b])
                if len(g) and len(h):
                    found += _bridges(_alike(sig[g], sig[h], n[g], n[h], percent), node[g].tolist(), node[h].tolist(), label[g], label[h])
            yield _edges(found)

    return meeting.mapInArrow(run, "a long, b long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: products of incidence matrices, a stretch of values at a time."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[place] > 1  # a value of one set meets no other
    names = np.cumsum(count > 1) - 1
    place, owner = names[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    most = int(place[-1]) + 1 if len(place) else 0
    for at in range(0, most, 2048):
        lo, hi = np.searchsorted(place, [at, at + 2048])
        m = np.zeros((len(sets), min(2048, most - at)), dtype=np.float32)
        m[owner[lo:hi], place[lo:hi] - at] = 1
        out += m @ m.T
    np.fill_diagonal(out, sizes)
    return out.astype(np.int64)


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    same = intersections(sets)
    sizes = np.diag(same)
    return 100 * same >= percent * (sizes[:, None] + sizes[None] - same)


def link_forest(members: DataFrame, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the links in each block of a family. members (family, node, n_blocks, members)."""

    def run(batches):
        for t, bounds in _whole_groups(batches, ["family", "time", "block"]):
            node, raw = np.asarray(t.column("node")).tolist(), t.column("members")
            found = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    found += [(node[a + p], node[a + q]) for p, q in forest(_linked([np.frombuffer(raw[k].as_py(), dtype=np.uint64) for k in range(a, b)], percent))]
            yield _edges(found)

    return _within_blocks(members, "family", 2).mapInArrow(run, "a long, b long")


def _link_bridges(meeting: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that meet in a large family; meeting is what _rest_with_all deals."""

    def run(batches):
        for t, bounds in _whole_groups(batches, ["family", "guests", "block"]):
            node, raw, label, guest = np.asarray(t.column("node")), t.column("members"), np.asarray(t.column("label")), np.asarray(t.column("guest")) == 1
            found = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                g, h = a + np.flatnonzero(guest[a:b]), a + np.flatnonzero(~guest[a:b])
                if len(g) and len(h):
                    both = np.concatenate([g, h])
                    linked = _linked([np.frombuffer(raw[int(k)].as_py(), dtype=np.uint64) for k in both], percent)[: len(g), len(g) :]
                    found += _bridges(linked, node[g].tolist(), node[h].tolist(), label[g], label[h])
            yield _edges(found)

    return meeting.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, node, component_id, h, stays) for every row of ``docs``; node names the class of equal sets,
    component_id is the least doc_id of all documents that links reach, h a digest of the text, and stays says whether
    the row is the one text that is kept of them (null ids come last)."""
    rows = cut(sketches(docs, width), "sketches")
    classes = cut(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    n_blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int").alias("n_blocks")
    posted = classes.select("node", F.posexplode("sig").alias("k", "v")).select(F.xxhash64("k", "v").alias("token"), "node")
    often = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = hot_join(posted, often, "token", often.select("token", F.col("df").alias("n")), COORDINATES * classes.count()).where("df is not null")
    by_node = Window.partitionBy("node")
    prefix = (
        shared.withColumn("m", F.count("*").over(by_node))
        .where(F.col("m") >= MATCHES)
        .withColumn("r", F.row_number().over(by_node.orderBy("df", "token")))
        .where(F.col("r") <= F.col("m") - MATCHES + 1)
        .select("token", "node", n_blocks("df"))
    )
    prefix = cut(prefix, "prefix")
    low = F.unhex(F.array_join(F.transform("sig", lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(255))), 2, "0")), ""))
    looks = classes.select("node", "n", low.alias("sig8"))
    tried = cut(candidate_forest(prefix.join(looks, "node"), percent).distinct(), "candidates")
    families = cut(components(tried), "families")
    large = prefix.where("n_blocks > 1")
    if large.limit(1).count() and (meeting := _rest_with_all(large, "token", families, looks)) is not None:
        bridges = cut(_candidate_bridges(meeting, percent).distinct(), "bridges")
        if bridges.limit(1).count():
            families = cut(merged(families, bridges), "families")
    families = families.withColumnRenamed("component", "family")
    sizes = families.groupBy("family").agg(F.count("*").alias("n"))
    wanted = hot_join(families, sizes.select("family", n_blocks("n")), "family", sizes).join(classes.select("node", "doc_id"), "node")
    wanted = cut(wanted, "wanted")
    sets = full_sets(docs, wanted.select("node", "doc_id"), width)
    large = wanted.where("n_blocks > 1").select("family", "node", "n_blocks")
    several = large.limit(1).count() > 0
    if several:  # read more than once
        sets = cut(sets, "sets")
    links = link_forest(wanted.select("family", "node", "n_blocks").join(sets, "node"), percent)
    found = cut(components(links), "components")
    if several and (meeting := _rest_with_all(large, "family", found, sets)) is not None:
        bridges = cut(_link_bridges(meeting, percent).distinct(), "bridges")
        if bridges.limit(1).count():
            found = cut(merged(found, bridges), "components")
    named = cut(found.join(classes.select("node", "best"), "node"), "named")
    least = named.groupBy("component").agg(F.min("best").alias("linked"), F.count("*").alias("n"))
    named = hot_join(named.select("node", "component"), least.select("component", "linked"), "component", least.select("component", "n")).select("node", "linked")
    own = classes.select("node", "best").join(named, "node", "left").select("node", F.coalesce("linked", "best").alias("best"))
    out = hot_join(rows.select("doc_id", "n_shingles", "node", "h"), own, "node")
    stays = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h")))
    return out.select("doc_id", "n_shingles", "node", F.coalesce("best.doc_id", "doc_id").alias("component_id"), "h", stays.alias("stays"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of every group of near-duplicates is kept, with all their
    columns. Rows equal in doc_id and text count as one document."""
    found = cut(near_duplicates(docs, width, percent), "groups")
    stay = found.where("stays").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__h")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: groups of near-duplicates on two-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("stays").alias("kept"))
