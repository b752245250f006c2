"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_frame

#: Bytes of text of each class that are read at most.
MOST_BYTES = 24 << 20


def remainder(mod: int):
    """crc32 of the document's id as text, modulo ``mod``."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(mod)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, keep, most_bytes: int = MOST_BYTES) -> list[tuple[str, int]]:
    """Whole texts with their label, drawn by a hash of the id: (text, label).

    At most ``most`` texts and ``most_bytes`` bytes of each class, whatever the size of the table: the driver first gets
    ids and lengths of ``most`` texts a class, and a text that no longer fits is left out whole. Ids without a label,
    and labels whose id occurs with both values, are left out; an id that occurs with several texts counts with each,
    equal rows count once."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("__y")).where("__y in (0, 1)").groupBy("doc_id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).where("__y = __z").select("doc_id", "__y")
    order = F.xxhash64("doc_id", F.lit(17))
    told = text_frame(docs).where(keep).select("doc_id", F.xxhash64("text").alias("__h"), F.octet_length("text").alias("__n")).distinct().join(own, "doc_id")
    chosen: list[tuple[int, int, int]] = []
    for y in (0, 1):
        left = most_bytes
        # numbers only, ``most`` rows
        for doc_id, h, n in told.where(F.col("__y") == y).orderBy(order, "doc_id", "__h").limit(most).select("doc_id", "__h", "__n").collect():
            if n <= left:
                left -= n
                chosen.append((doc_id, h, y))
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, __h long, __y int")  # 2 x most rows
    rows = text_frame(docs).withColumn("__h", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "__h"]).groupBy("doc_id", "__h", "__y").agg(F.first("text").alias("text"))
    return sorted((r["text"], r["__y"]) for r in rows.select("text", "__y").collect())  # 2 x most_bytes


def give_back() -> None:
    """Returns memory that a fit has used on the driver to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
