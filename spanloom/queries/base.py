"""Registration of queries and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with DuckDB SQL for the same rows where there is any."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


#: Tables whose rows are worth dealing out: those with texts.
TEXTS = ("documents", "pages", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name) if name in TEXTS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_spans(source: str, pattern: str, key: str = "doc_id", text: str = "text") -> str:
    """DuckDB rows (key, message, s_start, s_end, s_text) of the matches of a pattern in a table or subquery."""
    p = quoted(pattern)
    lengths = lambda x: f"coalesce(list_sum(list_transform({x}, lambda q: length(q))), 0)"
    return f"""(SELECT {key}, message, ({lengths("g[1:i]")} + {lengths("m[1:i-1]")})::BIGINT AS s_start,
        ({lengths("g[1:i]")} + {lengths("m[1:i]")})::BIGINT AS s_end, m[i] AS s_text
      FROM (SELECT {key}, {text} AS message, regexp_extract_all({text}, {p}) AS m, string_split_regex({text}, {p}) AS g FROM {source} AS src) AS found,
           unnest(range(1, len(m) + 1)) AS numbers(i))"""


def sql_values(rows: list[tuple], names: str) -> str:
    """A VALUES table."""

    def one(x):
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else quoted(x) if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows) + f") AS v({names})"
