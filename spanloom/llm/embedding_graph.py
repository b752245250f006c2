"""Near-duplicate embeddings by a robust-pruned flat graph.

Identical vectors form one class; the rest works on one vector a class. Centroids from a bounded sample cut the space
into cluster shards, and a vector belongs to its OVERLAP nearest shards. A shard that is still large is cut again by
centroids of its own, from a bounded sample of its members, so shards stay small at every size of the table; only a
place so crowded that no centroids divide it stays whole, and it is dealt into blocks of about BLOCK vectors, so that no
task grows with it (its vectors are near copies, whose links have to be counted one by one). On every block a flat graph
is built: each vector's nearest candidates are pruned so that no kept neighbour is better reached through another one,
edges are made mutual, and the medoid is tied in. The adjacency lists of all blocks are united by vector. A search
starts at the block's medoid, walks greedily with a beam, and once it is in range expands over everything within range
(with some slack, to step over gaps). Each vector searches every block of its shards, so a pair in one shard is met
whichever blocks it is in. What is found is verified by exact cosines in double precision, so no link is below the
threshold.

Links are counted where they are found (a pair belongs to the least shard that both are in) and components get a
spanning forest a task, so dense groups do not write all their pairs. Recall is audited by exact cosines of a bounded
random sample against all vectors, in blocks, as the mean over the sampled vectors that have links. Below LEAST_RECALL
the search is repeated with twice the overlap and the beam; this goes on until recall suffices or the overlap
takes in every shard; then all vectors are one shard and every search walks whole blocks, which is the exact comparison
of all with all.

Vectors that are null, zero, or hold null or non-finite components link with nothing and are their own component;
vectors of different lengths never meet. Rows with equal vec_id are compared like any other; an empty table gives an
empty result; labels and further columns are not read. There are no ties: links are pairs at or above the threshold, and a
component is named by its least vec_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, hot_join, table

THRESHOLD = 0.9
#: Vectors of a sample for centroids, vectors to a centroid, centroids of one cut at most, shards a vector belongs to.
SAMPLE, PER_CENTROID, CENTROIDS, OVERLAP = 8000, 1500, 512, 3
#: A shard of more vectors than this is cut again, into parts of which a vector belongs to PART_OVERLAP, CUTS times.
LARGE, PART_OVERLAP, CUTS = 6000, 2, 3
#: Vectors in a block; neighbours kept, candidates looked at, slack of the pruning; beam of the search.
BLOCK, DEGREE, CANDIDATES, ALPHA, BEAM = 1500, 20, 60, 1.2, 24
#: How far below the threshold a vector may lie to be walked over while a range is expanded.
SLACK = 0.06
#: Audited vectors, and the recall at which the search is widened.
AUDIT, LEAST_RECALL = 1000, 0.97


# ---------------------------------------------------------------- one block's graph


def prune(own: int, near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Keeps the nearest candidate and drops those that it brings alpha times nearer, again and again."""
    order = np.argsort(-sims, kind="stable")
    near, dist = near[order], np.sqrt(np.maximum(0, 2 - 2 * sims[order]))
    between = np.sqrt(np.maximum(0, 2 - 2 * (vectors[near] @ vectors[near].T)))
    alive, kept = np.ones(len(near), dtype=bool), []
    for k in range(len(near)):
        if alive[k]:
            kept.append(int(near[k]))
            if len(kept) == degree:
                break
            alive &= alpha * between[k] > dist
    return kept


def build(vectors: np.ndarray, degree: int = DEGREE) -> tuple[list[list[int]], int]:
    """Adjacency lists of a block and its medoid."""
    n = len(vectors)
    medoid = int(np.argmax(vectors @ vectors.mean(0)))
    if n == 1:
        return [[]], medoid
    k = min(n - 1, CANDIDATES)
    edges: list[list[int]] = [[] for _ in range(n)]
    for at in range(0, n, 256):
        sims = vectors[at : at + 256] @ vectors.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        for i in range(len(sims)):
            edges[at + i] = prune(at + i, top[i], sims[i, top[i]], vectors, degree)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, out in enumerate(edges):
        for j in out:
            back[j].append(i)
    full = []
    for i in range(n):
        both = sorted(set(edges[i]) | set(back[i]))
        if len(both) > 2 * degree:
            both = np.array(both)
            both = prune(i, both, vectors[both] @ vectors[i], vectors, 2 * degree)
        full.append([int(x) for x in both])
    # whatever the medoid does not reach is tied to it
    seen, walk = {medoid}, [medoid]
    while walk:
        for j in full[walk.pop()]:
            if j not in seen:
                seen.add(j)
                walk.append(j)
    for i in range(n):
        if i not in seen:
            full[medoid].append(i)
            full[i].append(medoid)
            seen.add(i)
            walk = [i]
            while walk:
                for j in full[walk.pop()]:
                    if j not in seen:
                        seen.add(j)
                        walk.append(j)
    return full, medoid


def search(query: np.ndarray, vectors: np.ndarray, edges: list[np.ndarray], medoid: int, threshold: float, beam: int, seen: np.ndarray, mark: int) -> np.ndarray:
    """Numbers of vectors in range of the query: greedy walk from the medoid, then range expansion."""
    seen[medoid] = mark
    ids, sims, done = np.array([medoid]), np.array([vectors[medoid] @ query]), np.zeros(1, dtype=bool)
    visited, values = [ids], [sims]
    while True:
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        # a few of the best unexplored at a time
        pick = open_[:4]
        done[pick] = True
        new = np.concatenate([edges[i] for i in ids[pick]]) if len(pick) else np.zeros(0, dtype=int)
        new = np.unique(new[seen[new] != mark]) if len(new) else new
        if len(new):
            seen[new] = mark
            s = vectors[new] @ query
            visited.append(new)
            values.append(s)
            ids, sims, done = np.concatenate([ids, new]), np.concatenate([sims, s]), np.concatenate([done, np.zeros(len(new), dtype=bool)])
            order = np.argsort(-sims, kind="stable")[:beam]
            ids, sims, done = ids[order], sims[order], done[order]
    found, close = np.concatenate(visited), np.concatenate(values)
    front = found[close >= threshold - SLACK]
    while len(front):
        new = np.concatenate([edges[i] for i in front])
        new = np.unique(new[seen[new] != mark]) if len(new) else new
        if not len(new):
            break
        seen[new] = mark
        s = vectors[new] @ query
        found, close = np.concatenate([found, new]), np.concatenate([close, s])
        front = new[s >= threshold - SLACK]
    return found[close >= threshold]


# ---------------------------------------------------------------- shards


def centroids_of(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    c = sample[np.sort(rng.choice(len(sample), k, replace=False))]
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def unit(batch_column) -> list[bytes | None]:
    """Normalised double vectors as bytes; null for those that link with nothing."""
    out = []
    for v in batch_column.to_pylist():
        x = None if v is None or not len(v) or any(e is None for e in v) else np.array(v, dtype=np.float64)
        if x is None or not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        x = x / np.abs(x).max()
        out.append((x / np.linalg.norm(x)).tobytes())
    return out


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) and classes (node, vec_id, copies, v, width); node names a class of identical vectors."""

    def work(batches):
        for batch in batches:
            v = unit(batch.column("embedding"))
            node = [None if x is None else int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in v]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(node, pa.int64()), pa.array(v, pa.binary())], ["vec_id", "node", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(work, "vec_id long, node long, v binary")
    rows = cut(rows, "vectors")
    classes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return rows.select("vec_id", "node"), cut(classes.withColumn("width", (F.octet_length("v") / 8).cast("int")), "classes")


def _assigned(classes: DataFrame, centres: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """classes with ``shards``: numbers of the nearest centroids of their width, ascending."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def work(batches):
        for batch in batches:
            widths, raw, out = batch.column("width").to_pylist(), batch.column("v").to_pylist(), []
            for at in range(0, len(raw), 512):
                block: list[list[int]] = [[] for _ in raw[at : at + 512]]
                for w in set(widths[at : at + 512]):
                    pick = [i for i in range(len(block)) if widths[at + i] == w]
                    c = shared.value[w]
                    k = min(overlap, len(c))
                    sims = np.frombuffer(b"".join([raw[at + i] for i in pick]), dtype=np.float64).reshape(len(pick), w) @ c.T
                    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    for i, t in zip(pick, top, strict=True):
                        block[i] = sorted(w * CENTROIDS + int(x) for x in t)  # a number a width and centroid
                out += block
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "copies", "v")], pa.array(out, pa.list_(pa.int64()))], ["node", "copies", "v", "shards"])

    return classes.mapInArrow(work, "node long, copies long, v binary, shards array<long>")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _adjacency(members: DataFrame) -> DataFrame:
    """(node, near): the lists of every block's graph. members (shard, block, node, v)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        nodes = frame["node"].to_numpy()
        edges, _ = build(_matrix(frame["v"]))
        return pd.DataFrame({"node": nodes, "near": [nodes[e] for e in edges]})

    return members.groupBy("shard", "block").applyInPandas(run, "node long, near array<long>")


FOUND = "role string, a long, b long"


def _found(members: DataFrame, adjacency: DataFrame, threshold: float, beam: int) -> DataFrame:
    """('links', node, count) and ('edge', a, b) rows of every block searched.

    members (shard, block, n_blocks, node, copies, v, shards). A block's vectors are searched by its own and by those of
    the later blocks of the shard; a pair is counted in the least shard that both belong to."""
    united = adjacency.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    own = members.join(united, "node").withColumn("target", F.col("block"))
    others = members.where("n_blocks > 1").withColumn("target", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).where("target < block").withColumn("near", F.lit(None).cast("array<long>"))
    columns = ["shard", "target", "block", "node", "copies", "v", "shards", "near"]
    rows = own.select(*columns).unionByName(others.select(*columns))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard, target = int(frame["shard"].iat[0]), int(frame["target"].iat[0])
        home = frame[frame["block"] == target].sort_values("node", ignore_index=True)
        guests = frame[frame["block"] != target]
        vectors, nodes = _matrix(home["v"]), home["node"].to_numpy()
        place = {int(x): i for i, x in enumerate(nodes)}
        edges = [np.array([place[x] for x in near.tolist() if x in place], dtype=np.int64) for near in home["near"]]
        medoid = int(np.argmax(vectors @ vectors.mean(0)))
        copies = home["copies"].to_numpy()
        shards = home["shards"].to_list()
        seen = np.zeros(len(vectors), dtype=np.int64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links: dict[int, int] = {}
        forest = []

        def meet(a: int, b: int, na: int, nb: int) -> None:
            """Vectors a and b, na and nb copies of them, are linked."""
            links[a] = links.get(a, 0) + nb
            links[b] = links.get(b, 0) + na
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                forest.append(("edge", max(a, b), min(a, b)))

        least = [int(s[0]) for s in shards]
        sets = [frozenset(int(x) for x in s) for s in shards]
        owned = lambda sa, j: min(sa & sets[j]) == shard  # noqa: E731  the pair belongs to this shard
        pairs: set[tuple[int, int]] = set()
        for i in range(len(vectors)):
            for j in search(vectors[i], vectors, edges, medoid, threshold, beam, seen, i + 1).tolist():
                if i != j:
                    pairs.add((i, j) if i < j else (j, i))
        for i, j in sorted(pairs):
            if (least[i] == shard and least[j] == shard) or owned(sets[i], j):
                meet(int(nodes[i]), int(nodes[j]), int(copies[i]), int(copies[j]))
        for k, (node, n, v, s) in enumerate(zip(guests["node"], guests["copies"], guests["v"], guests["shards"], strict=True)):
            mine = frozenset(int(x) for x in s)
            for j in search(np.frombuffer(v, dtype=np.float64), vectors, edges, medoid, threshold, beam, seen, len(vectors) + k + 1).tolist():
                if owned(mine, j):
                    meet(int(node), int(nodes[j]), int(n), int(copies[j]))
        return pd.DataFrame([*(("links", a, n) for a, n in links.items()), *forest], columns=["role", "a", "b"])

    return rows.groupBy("shard", "target").applyInPandas(run, FOUND)


def _audit(classes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Mean recall of n_links over the linked vectors of a bounded random sample, by exact cosines against all."""
    picked = classes.orderBy(F.xxhash64("node", F.lit(3))).select("node", "v", "width").limit(AUDIT)
    linked = found.where("role = 'links'").groupBy("a").agg(F.sum("b").alias("n"))
    asked = {r[0]: (r[1], r[2]) for r in picked.collect()}  # AUDIT vectors at most
    if not asked:
        return 1.0
    by_width: dict[int, tuple[list[int], np.ndarray]] = {}
    for w in {x[1] for x in asked.values()}:
        ids = [k for k, x in asked.items() if x[1] == w]
        by_width[w] = (ids, _matrix([bytes(asked[k][0]) for k in ids]))
    shared = classes.sparkSession.sparkContext.broadcast(by_width)

    def work(batches):
        for batch in batches:
            widths, raw, copies = np.asarray(batch.column("width")), batch.column("v").to_pylist(), np.asarray(batch.column("copies"))
            out_a, out_n = [], []
            for w, (ids, q) in shared.value.items():
                pick = np.flatnonzero(widths == w)
                for at in range(0, len(pick), 2048):
                    part = pick[at : at + 2048]
                    near = (_matrix([raw[i] for i in part]) @ q.T >= threshold) * copies[part][:, None]
                    out_a += ids
                    out_n += near.sum(0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_n, pa.int64())], ["a", "true"])

    truth = classes.select("v", "width", "copies").mapInArrow(work, "a long, true long").groupBy("a").agg(F.sum("true").alias("true"))
    own = classes.select(F.col("node").alias("a"), "copies")
    true = F.col("true") - F.col("copies")
    r = truth.join(own, "a").join(linked, "a", "left").where(true > 0).agg(F.avg(F.coalesce("n", F.lit(0)) / true)).first()
    return 1.0 if r[0] is None else float(r[0])


def _cut_again(spread: DataFrame) -> tuple[DataFrame, bool]:
    """``spread`` (node, copies, v, shards) with large shards replaced by parts, and whether there were any.

    A shard's own centroids come from a bounded sample of its members; every member goes to the nearest few. Members are
    dealt into chunks, and each chunk meets the centroids of its shard."""
    members = spread.select("node", "v", F.explode("shards").alias("shard"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > LARGE)
    sizes = cut(sizes, "large")
    if not sizes.limit(1).count():
        return spread, False
    # few shards are large while the table is small, and none has less than LARGE vectors: a join by shard, dealt into chunks
    inside = members.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "shard").withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / LARGE)).cast("int"))
    inside = cut(inside, "inside")
    chosen = inside.where(F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")) < SAMPLE // 2)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", ignore_index=True)
        n = int(frame["n"].iat[0])
        c = centroids_of(_matrix(frame["v"]), min(CENTROIDS, len(frame), -(-n // PER_CENTROID)))
        return pd.DataFrame({"shard": int(frame["shard"].iat[0]), "chunks": -(-n // LARGE), "centres": [c.tobytes()], "k": len(c)})

    centres = chosen.groupBy("shard").applyInPandas(fit, "shard long, chunks int, centres binary, k int").where("k > 1")
    dealt = centres.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def place(own: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        shard = own["shard"].to_numpy()
        if not len(own) or not len(c):  # nothing divides this shard
            return pd.DataFrame({"node": own["node"], "shard": shard, "part": shard})
        v = _matrix(own["v"])
        centre = np.frombuffer(c["centres"].iat[0], dtype=np.float64).reshape(-1, v.shape[1])
        k = min(PART_OVERLAP, len(centre))
        top = np.argpartition(-(v @ centre.T), k - 1, axis=1)[:, :k]
        # parts are numbered by a hash of shard and centroid: two with one number are one shard, which is harmless
        name = (shard.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + top.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
        return pd.DataFrame({"node": np.repeat(own["node"].to_numpy(), k), "shard": np.repeat(shard, k), "part": name.ravel()})

    parts = inside.groupBy("shard", "chunk").cogroup(dealt.groupBy("shard", "chunk")).applyInPandas(place, "node long, shard long, part long")
    parts = parts.groupBy("node").agg(F.collect_set("shard").alias("gone"), F.collect_set("part").alias("parts"))
    out = spread.join(parts, "node", "left")
    kept = F.when(F.col("parts").isNull(), F.col("shards")).otherwise(F.array_sort(F.array_union(F.array_except("shards", "gone"), "parts")))
    return cut(out.select("node", "copies", "v", kept.alias("shards")), "assigned"), True


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id) for every row, audited recall)."""
    rows, classes = _classes(vectors)
    sizes = {r[0]: r[1] for r in classes.groupBy("width").count().collect()}
    centres = {}
    for w, n in sizes.items():
        sample = classes.where(F.col("width") == w).orderBy(F.xxhash64("node")).select("v").limit(SAMPLE)
        centres[w] = centroids_of(_matrix([bytes(r[0]) for r in sample.collect()]), min(CENTROIDS, -(-n // PER_CENTROID)))
    most = max((len(c) for c in centres.values()), default=1)
    exact = False
    while True:
        spread = cut(_assigned(classes, centres, overlap), "assigned")
        for _ in range(0 if exact else CUTS):
            spread, again = _cut_again(spread)
            if not again:
                break
        members = cut(spread.withColumn("shard", F.explode("shards")), "members")
        counts = members.groupBy("shard").agg(F.count("*").alias("n"))
        members = hot_join(members, counts.select("shard", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int").alias("n_blocks")), "shard", counts)
        members = cut(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")), "members")
        adjacency = cut(_adjacency(members.select("shard", "block", "node", "v")), "adjacency")
        found = cut(_found(members, adjacency, threshold, beam), "found")
        recall = _audit(classes, found, threshold)
        if recall >= LEAST_RECALL or exact:
            break
        exact = overlap >= most
        if exact:  # one shard of all, and searches that walk whole blocks
            centres, overlap, beam = {w: c[:1] for w, c in centres.items()}, 1, 2 * BLOCK
        else:
            overlap, beam = 2 * overlap, 2 * beam
    linked = found.where("role = 'links'").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    grouped = components(found.where("role = 'edge'").select("a", "b"))
    named = classes.select("node", "vec_id", "copies").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least, "component").join(linked, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.join(named, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out, recall


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: links and components of all vectors, with the audited recall."""
    found, recall = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audited_recall", F.lit(float(recall)))
