"""Ranks and running sums over long orders without one task that sees them all.

Rows are cut into stretches of the order, sums of the stretches are added up (a few numbers), and windows run within a
stretch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stretches that an order is cut into; groups whose cuts are sent to every task at most.
STRETCHES, MOST_GROUPS = 64, 10_000


def offsets(sizes: DataFrame, by: list[str], amounts: list[str], descending: bool = False) -> DataFrame:
    """sizes (by, stretch, amounts) with each amount replaced by the sum of the stretches before: a few rows a group."""
    w = Window.partitionBy(*by).orderBy(F.desc("stretch") if descending else F.asc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*by, "stretch", *[F.coalesce(F.sum(a).over(w), F.lit(0)).alias(a) for a in amounts])


def cut_by(rows: DataFrame, by: list[str], value: str, stretches: int = STRETCHES) -> DataFrame:
    """``rows`` with ``stretch``, ascending with ``value``, about as many rows in each: equal values lie in one."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [k / stretches for k in range(1, stretches)], F.lit(1000)).alias("__cuts"))
    few = cuts.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    j = rows.join(F.broadcast(cuts) if few else cuts, by) if by else rows.crossJoin(F.broadcast(cuts))  # one row
    return j.withColumn("stretch", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")


def ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows (by, stretch, ...) with rank (from 1) and n, the rows of the group."""
    sizes = rows.groupBy(*by, "stretch").agg(F.count("*").alias("rows"))
    total = sizes.groupBy(*by).agg(F.sum("rows").alias("n")) if by else sizes.agg(F.sum("rows").alias("n"))
    before = offsets(sizes, by, ["rows"])
    before = before.join(total, by) if by else before.crossJoin(total)  # one row
    own = F.row_number().over(Window.partitionBy(*by, "stretch").orderBy(*order))
    small = before.limit(MOST_GROUPS * STRETCHES + 1).count() <= MOST_GROUPS * STRETCHES
    j = rows.withColumn("rank", own).join(F.broadcast(before) if small else before, [*by, "stretch"])
    return j.withColumn("rank", F.col("rank") + F.col("rows")).drop("rows", "stretch")
