"""Token counts by a digest cache.

A document's content is normalised in a way that the tokenizer cannot tell (runs of ASCII white space become one
space) and digested; the cache is a parquet table of (tokenizer digest, content digest, count) in the shared folder.
Documents join the cache on both digests; only texts whose digest is missing are encoded, each distinct one once, and
their counts are appended before the counts are read back. A cache written twice for one digest (two jobs at once) is
harmless: both hold the same count. A content that very many documents share is not brought into one task: copies meet
in their map tasks before they are shuffled, and the count of such a content is broadcast to its documents.

Null text counts as empty (0 tokens); repeated rows stay; an empty table gives an empty result; further columns of the
input are not read. Texts are encoded whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _made, cut, hot_join, map_batches, shared_dir, table, text_frame
from .wordtokens import tokens_for, version, vocabulary_path

LIMIT = 2048
CACHE = "tokenizer string, digest binary, n_tokens long"


def content_digest(text):
    return F.unhex(F.sha2(F.regexp_replace(text, r"[ \t\n\x0B\f\r]++", " "), 256))


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except Exception as e:  # noqa: BLE001  only a cache that does not exist yet counts as empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``; ``cache`` is a folder that all executors share."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    tokenizer = version(path)
    rows = text_frame(docs).withColumn("digest", content_digest(F.col("text")))
    stored = read_cache(spark, cache, tokenizer)
    wanted = rows.select("digest", "text")
    if stored.limit(1).count():
        wanted = wanted.join(stored.select("digest"), "digest", "left_anti")
    # one text of each digest; copies meet in their own map task first
    missing = wanted.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batch):
        tok = tokens_for(path)
        return {
            "tokenizer": [tokenizer] * batch.num_rows,
            "digest": batch.column("digest"),
            "n_tokens": [len(tok.ids(t)) // 4 for t in batch.column("text").to_pylist()],
        }

    map_batches(missing, encode, CACHE).write.mode("append").parquet(cache)
    keyed = cut(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    return hot_join(keyed, read_cache(spark, cache, tokenizer), "digest").select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: counts for all documents, starting from an empty cache of this call's own."""
    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    _made.append((spark, cache))
    counts = count_tokens(table(spark, sf_dir, "documents"), cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
