"""Two annotators' answers: verdicts, admission, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def verdict(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "uncovered").when(a != b, "disputed").otherwise("labelled")


def admission(first_clear: Column, second_clear: Column) -> Column:
    """A carrier is admitted if both annotators call it clear; else the first that does not is named."""
    return F.when(first_clear & second_clear, "admitted").when(~first_clear, "refused:first").otherwise("refused:second")
