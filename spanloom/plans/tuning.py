"""Threshold tuning: split halves, per-type coordinate ascent, cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fold_hash, half_hash
from ..operators import metrics as M

GRID = [round(i / 20, 2) for i in range(21)]


def split_half(rows: DataFrame) -> DataFrame:
    """(tau_from_a, f1_on_b, tau_from_b, f1_on_a, mean): a threshold chosen on one half and spent on the other."""
    halves = rows.withColumn("half", half_hash(F.col("item_id").cast("string")))
    tau = {h: (M.best_point(M.sweep(halves.where(F.col("half") == h))).first() or [None])[0] for h in (0, 1)}
    f1 = {}
    for tuned, tested in ((0, 1), (1, 0)):
        part = halves.where(F.col("half") == tested)
        f1[tested] = None if tau[tuned] is None or not part.limit(1).count() else M.threshold_point(part, tau[tuned]).first()["f1"]
    both = [x for x in (f1[1], f1[0]) if x is not None]
    mean = sum(both) / len(both) if both else None
    return rows.sparkSession.createDataFrame([(tau[0], f1[1], tau[1], f1[0], mean)], "tau_from_a double, f1_on_b double, tau_from_b double, f1_on_a double, mean double")


def _counts(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int, int]]:
    """Counts at each type and grid step: one aggregate, 21 rows a type."""
    step = F.explode(F.sequence(F.lit(0), F.lit(20)))
    hit = F.col("p") >= F.col("k") / F.lit(20.0)
    g = rows.withColumn("k", step).groupBy("type", "k").agg(F.count_if(hit & F.col("gold")).alias("tp"), F.count_if(hit & ~F.col("gold")).alias("fp"), F.count_if(~hit & F.col("gold")).alias("fn"))
    return {(r["type"], r["k"]): (r["tp"], r["fp"], r["fn"]) for r in g.collect()}


def _ascend(counts: dict, base: int, rounds: int) -> dict[str, int]:
    types = sorted({t for t, _ in counts})
    at = dict.fromkeys(types, base)

    def f1() -> float:
        tp, fp, fn = (sum(counts[t, at[t]][i] for t in types) for i in range(3))
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    best = f1()
    for _ in range(rounds):
        for t in types:
            keep = at[t]
            for k in range(21):
                at[t] = k
                if f1() > best:
                    best, keep = f1(), k
            at[t] = keep
    return at


def tune_per_type(rows: DataFrame, base: float = 0.5, rounds: int = 3) -> dict[str, float]:
    """Per-type thresholds on the grid by coordinate ascent with strict improvement. rows (type, p, gold)."""
    return {t: GRID[k] for t, k in _ascend(_counts(rows), round(base * 20), rounds).items()}


def cross_validate(rows: DataFrame, folds: int = 5, base: float = 0.5) -> tuple[int, int, int]:
    """Pooled (tp, fp, fn): thresholds tuned on the other folds. rows (item_id, type, p, gold)."""
    dealt = rows.withColumn("fold", fold_hash(F.col("item_id").cast("string"), folds))
    pooled = [0, 0, 0]
    for f in range(folds):
        tuned = _ascend(_counts(dealt.where(F.col("fold") != f)), round(base * 20), 3)
        held = _counts(dealt.where(F.col("fold") == f))
        for t in {t for t, _ in held}:
            for i, n in enumerate(held[t, tuned.get(t, round(base * 20))]):
                pooled[i] += n
    return tuple(pooled)
