"""JSON Lines sources and sinks with explicit schemas; rows that break a rule are found by joins and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string,entityType:string,action:string>"
CORPUS = f"id string, text string, policy string, gold array<{SPAN}>, meta string"
GOLD = "itemId string, rowId string, round string, policy string, policyHash string, predicateId string, entityType string, status string, satisfies boolean, confidence string, adjudication string, spans array<struct<start:int,end:int,text:string>>, annotators struct<a:struct<satisfies:boolean,confidence:string,quote:string,rationale:string>,b:struct<satisfies:boolean,confidence:string,quote:string,rationale:string>>"
CALL = "struct<finishReason:string,promptTokens:int,completionTokens:int,ttftMs:double,decodeTokPerSec:double>"
FINDING = "struct<start:int,end:int,text:string,entityType:string,severity:string,tier:int,source:string,confidence:double,action:string>"
RUN = f"schemaVersion int, runId string, itemId string, policy string, irHash string, policyHash string, arm string, detector string, backend string, provider string, text string, findings array<{FINDING}>, gold array<{SPAN}>, timings struct<tier0Ms:double,tier1Ms:double,tier2Ms:double>, degraded array<struct<tier:int,reason:string,detail:string>>, error string, abandonedWorkInFlight boolean, calls array<{CALL}>"
JUDGMENT = "itemId string, predicateProbability double, candidates array<struct<index:int,start:int,end:int,text:string,source:string,tier0EntityType:string,choice:string,probability:double,confidence:double,probabilities:map<string,double>>>, promptTokens int, costUsd double, wallMs double, retries int"
HOSTED = "runId string, itemId string, arm string, model string, calls array<struct<provider:string,transport:string,reasoningTokens:int,wallMs:double,costUsd:double,parse:string,repair:boolean,retries:array<struct<attempt:int,status:int,delayMs:double,detail:string>>>>"
RETURNS = "rowId string, violates boolean, confidence string, quote string, rationale string"
QUEUE = "rowId string, text string"


class SourceError(ValueError):
    pass


def scan(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Lines of JSON under a fixed schema; a line that is not JSON fails the job. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(key)


def corpus_violations(items: DataFrame) -> DataFrame:
    """(id, reason): gold spans that do not lie in their text or differ from it, and repeated ids."""
    g = items.select("id", "text", F.explode("gold").alias("g"))
    bad = g.select("id", F.when((F.col("g.start") < 0) | (F.col("g.start") >= F.col("g.end")), "bad-offsets").when(F.col("g.end") > F.length("text"), "out-of-range").when(F.expr("substring(text, g.start + 1, g.end - g.start) <> g.text"), "text-mismatch").alias("reason")).where("reason is not null")
    return bad.unionByName(duplicates(items, "id").select("id", F.lit("duplicate-id").alias("reason")))


def gold_violations(rows: DataFrame) -> DataFrame:
    n = F.size(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,text:string>>")))
    reason = (
        F.when(~F.col("satisfies") & (n > 0), "spans-without-satisfaction")
        .when((F.col("status") == "disputed") & (n > 0), "spans-on-disputed")
        .when((F.col("status") == "scored") & F.col("satisfies") & (n == 0), "satisfied-without-spans")
        .when(~F.col("policyHash").rlike(r"\A[0-9a-f]{64}\z"), "bad-policy-hash")
    )
    bad = rows.select(F.col("itemId").alias("id"), reason.alias("reason")).where("reason is not null")
    return bad.unionByName(duplicates(rows, "itemId").select(F.col("itemId").alias("id"), F.lit("duplicate-id").alias("reason")))


def returns_violations(rows: DataFrame) -> DataFrame:
    reason = F.when(~F.col("rowId").rlike(r"\A[0-9a-f]{16}\z"), "bad-row-id").when(F.col("violates") != F.col("quote").isNotNull(), "quote-rule")
    bad = rows.select(F.col("rowId").alias("id"), reason.alias("reason")).where("reason is not null")
    return bad.unionByName(duplicates(rows, "rowId").select(F.col("rowId").alias("id"), F.lit("duplicate-id").alias("reason")))


def selftest_examples(cases: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(source, n, text): compiled cases (array of text, corpusTag) and fixtures {positives, negatives} in one table."""
    a = cases.select(F.posexplode("cases").alias("n", "c")).select(F.concat(F.lit("case:"), F.coalesce("c.corpusTag", F.lit(""))).alias("source"), "n", F.col("c.text").alias("text"))
    kind = lambda k: fixtures.select("id", F.posexplode(k).alias("n", "text")).select(F.concat_ws(":", "id", F.lit(k)).alias("source"), "n", "text")
    return a.unionByName(kind("positives")).unionByName(kind("negatives"))


def utf16_to_points(text: str, offset: int) -> int:
    """An offset in UTF-16 units as one in code points; inside a surrogate pair is an error."""
    head = text.encode("utf-16-le", "surrogatepass")[: 2 * offset].decode("utf-16-le", "surrogatepass")
    if head and 0xD800 <= ord(head[-1]) < 0xDC00:
        raise SourceError("the offset splits a character")
    return len(head)


# ---------------------------------------------------------------- sinks


def write_once(rows: DataFrame, path: str, *by: str) -> None:
    """JSON Lines to a folder that must not exist: a finished run is never overwritten. U+2028 and U+2029 are escaped,
    so that every reader sees one record a line."""
    line = F.to_json(F.struct(*[c for c in rows.columns if c not in by]))
    text = F.replace(F.replace(line, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))
    out = rows.select(*by, text.alias("value")).write.mode("errorifexists")
    (out.partitionBy(*by) if by else out).text(path)


def write_sorted(rows: DataFrame, path: str, *order: str) -> None:
    """A small artifact as one file in a fixed order, the same bytes each time."""
    rows.orderBy(*order).coalesce(1).select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("errorifexists").text(path)


def hashed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
