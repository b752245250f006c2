"""Helpers shared by the training-data operators: tables, scratch tables, byte arrays, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


#: Bytes of rows that Spark sends to Python at once; its own default would be 64 MiB a task on either side.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of a session that has not said otherwise (a longer row is a batch of its own)."""
    if spark.conf.get(_BATCH, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data folder; any path that Spark can open will do."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet") if name == "labels" else read_table(spark, sf_dir, name)


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return shared_dir.own


_made: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back: later stages survive a lost
    executor without recomputing what is above, and the plan starts anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete all scratch tables written so far; results that still read them must have been written before."""
    while _made:
        spark, path = _made.pop()
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


atexit.register(release)


# ---------------------------------------------------------------- texts in batches

CHUNK_BYTES = 2 << 20


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each (one row at least), so that work arrays are bounded
    by the longest text and not by the number of rows in an Arrow batch."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Python strings; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def text_frame(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator reads, so that further columns never clash with what it adds."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def map_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow over text chunks. ``work(batch) -> dict of columns``."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                made = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Odd base of the polynomial word hash.
BASE = 0x9E3779B97F4A7C15

_pow = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    global _pow
    if len(_pow) < n:
        more = np.full(max(n, 2 * len(_pow)), BASE, dtype=np.uint64)
        more[0] = 1
        _pow = np.multiply.accumulate(more)
    return _pow[:n]


#: A-Z to a-z; the six white-space bytes to 0x20.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of lower-cased (A-Z) UTF-8 texts, all in one array, and the
    text number of each."""
    joined = b"\n".join(texts).translate(LOWER)
    if not joined:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(joined, dtype=np.uint8)
    inside = ~SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    lengths = ends - starts
    where = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(where)) - np.repeat(first, lengths)
    value = (data[where].astype(np.uint64) + _U(1)) * powers(int(lengths.max()))[place]
    sums = np.add.reduceat(value, first)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return mix(sums ^ (lengths.astype(np.uint64) << _U(48))), np.searchsorted(bounds, starts, side="right")


# ---------------------------------------------------------------- joins with hot keys

#: A key is hot if it holds more than one in so many of the rows; so there are fewer hot keys than this.
HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """left join of ``right``, which has one row a key (a long, a string or bytes). Rows of a hot key meet theirs by broadcast, wherever they are;
    only the others are shuffled by key, and no task gets a whole hot key.

    ``left`` is read twice, so it should be a written table. counts (key, n) and the number of rows may be given."""
    counts = counts if counts is not None else left.groupBy(key).agg(F.count("*").alias("n"))
    rows = rows if rows is not None else left.count()
    added = [c for c in right.columns if c != key]
    hot = right.join(counts.where(F.col("n") * HOT > rows).select(key), key, "left_semi")  # fewer than HOT rows
    warm = hot.select(key, F.struct(*added).alias("__hot"))
    # rows that have met theirs, or have no key, are spread over all tasks by a key whose row is not taken
    kind, spread = dict(left.dtypes)[key], F.xxhash64(*left.columns)
    spread = spread if kind == "bigint" else spread.cast("string").cast(kind)
    asks = F.col("__hot").isNull() & F.col(key).isNotNull()
    met = left.join(F.broadcast(warm), key, "left").withColumn("__asks", asks).withColumn("__key", F.when(F.col("__asks"), F.col(key)).otherwise(spread))
    cold = right.select(F.col(key).alias("__key"), F.struct(*added).alias("__cold"))
    both = met.join(cold, "__key", "left").withColumn("__row", F.when(F.col("__asks"), F.col("__cold")).otherwise(F.col("__hot")))
    return both.select(*left.columns, *[F.col(f"__row.{c}").alias(c) for c in added])


# ---------------------------------------------------------------- connected components


#: Links in a file between rounds.
EDGES = 50_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges (a, b): links between longs. Returns (node, component) for every node in a link, component being the
    smallest node reachable. Each round is a constant number of shuffles over a linear number of rows and is written
    to the shared folder; nothing is collected but the number of rows of each round. The links of a node in the middle
    of a large star are not brought into one task: such nodes are few, and their least neighbour is broadcast.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "links")
    for _ in range(most_rounds):
        rows = e.count()
        if not rows:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = hot_join(both.where("b > a"), low.select("a", "m"), "a", low.select("a", "n"), 2 * rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = (
            hot_join(large, low.select("a", "m"), "a", low.select("a", "n"), rows)
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct()
        )
        e = cut(small.coalesce(rows // EDGES + 8), "links")  # no more files than the links are worth
        # settled when every node points to one other, and none that is pointed to points on itself
        told = e.select("a", F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("s"), F.lit(1).alias("t")))
        if not told.groupBy("a").agg(F.sum("s").alias("s"), F.max("t").alias("t")).where("s > 1 or (s = 1 and t = 1)").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) when further links (a, b) join nodes of components that are known, or new nodes: only the graph
    of the components is solved again. Both should be written tables."""
    own = grouped.select("node", "component")
    ends = links.select("a", "b").join(own.select(F.col("node").alias("a"), F.col("component").alias("x")), "a", "left").join(own.select(F.col("node").alias("b"), F.col("component").alias("y")), "b", "left")
    ends = cut(ends, "ends")
    over = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    new = ends.where("x is null").select(F.col("a").alias("node")).unionByName(ends.where("y is null").select(F.col("b").alias("node"))).distinct()
    nodes = cut(own.unionByName(new.select("node", F.col("node").alias("component"))), "nodes")
    return hot_join(nodes, over.select(F.col("node").alias("component"), F.col("component").alias("least")), "component").select("node", F.coalesce("least", "component").alias("component"))
