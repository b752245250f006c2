"""Inputs derived from the tables by expressions that read the same in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .base import read

#: Messages with prose, key-value lines and a fenced block, from customer keys.
KV_MESSAGES = """SELECT c_custkey AS doc_id, concat('note for ', c_name, chr(10), 'acct_key=', c_name, '-', c_custkey * 7919, chr(10),
  '- region: r', c_nationkey, chr(10), 'plain words here', chr(10), 'CODE', chr(10), 'x', c_custkey % 97, ' = ', substring(md5(CAST(c_custkey AS STRING)), 1, 24), 'QzWx', c_custkey * 31, chr(10),
  'CODE', chr(10), 'bye ', c_mktsegment) AS text FROM customer"""
#: Spans by order: found ones and gold ones that are shifted on every other line.
SPAN_PAIRS = """SELECT l_orderkey AS item_id, l_linenumber AS line, l_linenumber * 20 AS f_start, l_linenumber * 20 + CAST(l_quantity AS BIGINT) AS f_end,
  l_linenumber * 20 + (l_linenumber % 2) * 7 AS g_start, l_linenumber * 20 + (l_linenumber % 2) * 7 + CAST(l_quantity AS BIGINT) AS g_end, l_returnflag AS f_type, l_linestatus AS g_type FROM lineitem"""
#: Probabilities with boolean gold.
SCORES = """SELECT l.doc_id AS item_id, CAST((l.doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS p, l.toxic = 1 AS gold, l.quality = 1 AS other FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
#: Model calls: arm, latency, tokens.
CALLS = """SELECT event_id AS call_id, event_type AS arm, user_id AS item_id, value AS latency, event_id % 3 AS pass, CAST(user_id % 50 + 1 AS BIGINT) AS tokens,
  CASE WHEN event_id % 11 = 0 THEN 'stop' WHEN event_id % 7 = 0 THEN 'length' ELSE 'done' END AS finish, CASE WHEN event_id % 13 = 0 THEN 429 ELSE 200 END AS status FROM events"""
#: Two annotators.
RATINGS = """SELECT doc_id AS item_id, quality AS a, (quality + CAST(doc_id % 3 = 0 AS INT)) % 2 AS b FROM labels"""


def fenced(sql: str) -> str:
    """The same statement with the marks of a fenced block in place of the word that stands for them."""
    return sql.replace("'CODE'", "'```'")


KV_MESSAGES = fenced(KV_MESSAGES)


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a derived input over freshly read tables, without leaving views behind."""
    names = {t: read(spark, sf_dir, t) for t in tables}
    import re

    text = sql
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **names)
