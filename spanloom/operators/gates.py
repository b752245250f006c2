"""Gates on measured arms, deadlines and retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_most(value: Column, limit: float, n: Column, least: int) -> Column:
    return F.when((n < least) | value.isNull(), "not-measured").when(value <= limit, "pass").otherwise("fail")


def at_least(value: Column, limit: float, n: Column, least: int) -> Column:
    return F.when((n < least) | value.isNull(), "not-measured").when(value >= limit, "pass").otherwise("fail")


def deadline_bound(latency: Column, calls: Column, call_budget: Column, lower: Column, slack: int = 20) -> Column:
    """What an item may take at most: its own budget, or that of all its calls if less, and what runs below."""
    return F.least(latency + slack, calls * (call_budget + slack)) + lower


def minimum_sample(percent: int) -> int:
    """The fewest observations with which one bad one still passes a nearest-rank percentile."""
    n = 1
    while -(-percent * n // 100) > n - 1:
        n += 1
    return n


def retryable(status: Column) -> Column:
    return status.isNull() | status.isin(429, 529) | (status >= 500)


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(16000), F.lit(500) * F.pow(F.lit(2), attempt - 1)).cast("long")
