"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a 64-bit ring; a row belongs to the arc in which the hash of its key falls, and
the arc's points, taken clockwise, name the shards it may go to, nearest first. Every shard has a bound on its load; a
row that finds a shard full continues clockwise. With the tight bound used here (total / shards, rounded up for the
first ``total % shards`` shards and down for the others) counts are at most one apart.

The ring is cut into CELLS equal cells, whatever the size of the table; rows of one cell start from the cell's place and
so see the same sequence of shards. The walk is then decided on one count a cell, so the driver's part has a fixed size,
and only ids and hashes are shuffled, never texts. Equal rows are counted before they are shuffled and dealt out again
at the end, a stretch of copies a task; a cell with many different rows (one repeated key, say) is dealt into parts by a
hash of the whole row, and each part is ranked on its own. No task grows with a hot key or with copies of a row.

Nulls, repeats, ties: a null key hashes like the text "null"; equal keys are told apart by the other columns, and rows
equal in all columns are interchangeable. A text's length does not matter: texts are read once and not moved. An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

SHARDS = 8
VNODES = 64
#: Cells of the ring are 2 to this power.
BITS = 14
#: Different rows that are ranked in one part of a cell; copies of a row that are dealt out in one piece.
PART_ROWS, COPIES = 50_000, 100_000


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard), by point; a shard's points do not depend on how many other shards there are."""
    points = []
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.sha256(f"shard {s} point {v}".encode()).digest()
            points.append((int.from_bytes(h[:8], "big") >> 1, s))
    return sorted(points)


def clockwise(points: list[tuple[int, int]], at: int, shards: int) -> list[int]:
    """Shards in the order in which they are met clockwise from place ``at``."""
    i, order = bisect.bisect_left(points, (at, -1)), []
    for k in range(len(points)):
        s = points[(i + k) % len(points)][1]
        if s not in order:
            order.append(s)
            if len(order) == shards:
                break
    return order


def walk(cells: list[tuple[int, int, int]], shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """cells (cell, place, rows), in ring order. Returns (cell, shard, first rank, end rank, first slot) slices.

    All rows first ask their nearest shard, round by round; a shard grants requests in ring order until it is full, so
    nearer rows never lose to ones that came by overflow, and the outcome does not depend on how rows are stored.
    """
    points, total = ring(shards, vnodes), sum(n for _, _, n in cells)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    order = {c: clockwise(points, at, shards) for c, at, _ in cells}
    left, taken, out = {c: n for c, _, n in cells}, {c: 0 for c, _, _ in cells}, []
    for step in range(shards):
        for c, _, _ in cells:
            s = order[c][step] if step < len(order[c]) else None
            if s is None or not left[c]:
                continue
            n = min(left[c], room[s] - filled[s])
            if n > 0:
                out.append((c, s, taken[c], taken[c] + n, filled[s]))
                filled[s] += n
                taken[c] += n
                left[c] -= n
    return out


def shard_rows(rows: DataFrame, key: str, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """Adds shard int and slot long (gapless from 0 in each shard) to ``rows``, which must not have these columns. Rows
    with equal columns are interchangeable."""
    spark, columns = rows.sparkSession, rows.columns
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1)
    placed = cut(rows.groupBy(*columns).agg(F.count("*").alias("__copies")).withColumn("__place", place).withColumn("__cell", F.shiftrightunsigned("__place", 63 - BITS)), "ring")
    counts = placed.groupBy("__cell").agg(F.sum("__copies"), F.count("*")).orderBy("__cell").collect()  # 2 ** BITS rows at most
    plan = walk([(c, c << (63 - BITS), n) for c, n, _ in counts], shards, vnodes)
    by_cell: dict[int, list] = {c: [] for c, _, _ in counts}
    for c, shard, start, end, slot in plan:
        by_cell[c].append((start, end, shard, slot))
    slices = spark.createDataFrame([(c, -(-different // PART_ROWS), by_cell[c]) for c, _, different in counts], SLICES)
    own_hash = F.xxhash64("__place", *columns)
    dealt = placed.join(F.broadcast(slices), "__cell").withColumn("__part", F.pmod(own_hash, F.col("__parts")).cast("int"))  # 2 ** BITS rows at most
    sizes = dealt.where("__parts > 1").groupBy("__cell", "__part").agg(F.sum("__copies").alias("__n"))
    before = sizes.select("__cell", "__part", (F.sum("__n").over(Window.partitionBy("__cell").orderBy("__part")) - F.col("__n")).alias("__before"))
    upto = F.sum("__copies").over(Window.partitionBy("__cell", "__part").orderBy("__place", *columns))
    ranked = dealt.withColumn("__rank", upto - F.col("__copies")).join(before, ["__cell", "__part"], "left").withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0)))
    piece = F.explode(F.sequence(F.lit(0), F.expr(f"cast((__copies - 1) div {COPIES} as int)")))
    few, many = ranked.where(F.col("__copies") <= COPIES).withColumn("__piece", F.lit(0)), ranked.where(F.col("__copies") > COPIES).withColumn("__piece", piece).repartition("__place", "__piece")
    first = F.col("__piece").cast("long") * COPIES
    each = few.unionByName(many).withColumn("__copy", F.explode(F.sequence(first, F.least(first + COPIES, "__copies") - 1)))
    own = F.filter("__plan", lambda p: (p["from"] <= F.col("__rank")) & (F.col("__rank") < p["to"]))[0]
    each = each.withColumn("__rank", F.col("__rank") + F.col("__copy")).withColumn("__own", own)
    return each.select(*columns, F.col("__own.shard").cast("int").alias("shard"), (F.col("__own.slot") + F.col("__rank") - F.col("__own.from")).cast("long").alias("slot"))


SLICES = "__cell long, __parts int, __plan array<struct<from: long, to: long, shard: long, slot: long>>"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in shards 0 to 7; the law is ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return shard_rows(rows, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
