"""Evaluation aggregates: counts to precision, recall and F1 in three conventions, thresholds, curves, agreement,
percentiles, gates, cost and reports. All are plain aggregates or windows over keyed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranking


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null for an empty denominator."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def prf_null(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Null on empty denominators; F1 = 2tp / (2tp + fp + fn)."""
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def prf_strict(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """As above, but F1 is null as well when precision and recall are both 0 or either is null."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1")]


def prf_zero(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """0 instead of null."""
    zero = F.lit(0.0)
    p, r = F.coalesce(ratio(tp, tp + fp), zero), F.coalesce(ratio(tp, tp + fn), zero)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(zero).alias("f1")]


# ---------------------------------------------------------------- thresholds over (item_id, p, gold)


def threshold_point(rows: DataFrame, tau: float) -> DataFrame:
    hit = F.col("p") >= tau
    counts = rows.agg(F.count_if(hit & F.col("gold")).alias("tp"), F.count_if(hit & ~F.col("gold")).alias("fp"), F.count_if(~hit & F.col("gold")).alias("fn"))
    return counts.select(F.lit(tau).alias("tau"), "tp", "fp", "fn", *prf_zero(F.col("tp"), F.col("fp"), F.col("fn")))


def sweep(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts at every distinct probability and at 0.5: (tau, tp, fp, fn, precision, recall, f1).

    Rows are counted by probability first, and the counts are summed from the top; no row meets every threshold. The
    running sum goes over distinct probabilities, two-level so that it is not one task: buckets of 1/64 first."""
    by = by or []
    counted = rows.groupBy(*by, "p").agg(F.count_if("gold").alias("pos"), F.count_if(~F.col("gold")).alias("neg"))
    half = rows.select(*by, F.lit(0.5).alias("p"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")).distinct() if by else rows.sparkSession.createDataFrame([(0.5, 0, 0)], "p double, pos long, neg long")
    counted = counted.unionByName(half).groupBy(*by, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("bucket", F.floor(F.col("p") * 64))
    buckets = counted.groupBy(*by, "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    above = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*by)
    buckets = buckets.select(*by, "bucket", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"), F.sum("bp").over(all_of).alias("total"))
    own = Window.partitionBy(*by, "bucket").orderBy(F.desc("p"))
    j = counted.join(F.broadcast(buckets), [*by, "bucket"])  # 65 rows a group
    tp, fp = F.col("ap") + F.sum("pos").over(own), F.col("an") + F.sum("neg").over(own)
    out = j.select(*by, F.col("p").alias("tau"), tp.alias("tp"), fp.alias("fp"), "total").withColumn("fn", F.col("total") - F.col("tp"))
    return out.select(*by, "tau", "tp", "fp", "fn", *prf_zero(F.col("tp"), F.col("fp"), F.col("fn")))


def best_point(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold of the greatest F1; the least one on ties."""
    best = F.max_by(F.struct("tau", "f1"), F.struct("f1", -F.col("tau"))).alias("b")
    return points.groupBy(*(by or [])).agg(best).select(*(by or []), "b.tau", "b.f1")


#: Stretches of the probabilities, from 0 to 1.
STRETCHES = 256


def _stretch(p: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(F.col(p) * STRETCHES), F.lit(STRETCHES - 1))).cast("int")


def roc_auc(rows: DataFrame) -> DataFrame:
    """Mann-Whitney over counts by probability; null if a class is empty."""
    counted = rows.groupBy("p").agg(F.count_if("gold").alias("pos"), F.count_if(~F.col("gold")).alias("neg")).withColumn("stretch", _stretch("p"))
    before = ranking.offsets(counted.groupBy("stretch").agg(F.sum("neg").alias("before")), [], ["before"])  # STRETCHES rows
    below = Window.partitionBy("stretch").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    j = counted.join(F.broadcast(before), "stretch").withColumn("less", F.col("before") + F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return j.agg(ratio(F.sum(F.col("pos") * (F.col("less") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Mean precision at the positives, by descending probability, ties by item."""
    r = rows.select("gold", "p", "item_id", _stretch("p").alias("stretch"))
    before = ranking.offsets(r.groupBy("stretch").agg(F.count("*").alias("n_before"), F.count_if("gold").alias("tp_before")), [], ["n_before", "tp_before"], descending=True)  # STRETCHES rows
    w = Window.partitionBy("stretch").orderBy(F.desc("p"), "item_id")
    r = r.withColumn("rank", F.row_number().over(w)).withColumn("tp", F.sum(F.col("gold").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.where("gold").join(F.broadcast(before), "stretch")
    return r.agg(F.avg((F.col("tp_before") + F.col("tp")) / (F.col("n_before") + F.col("rank"))).alias("average_precision"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, observed) for equal-width bins, the last one closed; empty bins stay, with nulls."""
    every = rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    own = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long").alias("bin")
    have = rows.groupBy(own).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("gold").cast("double")).alias("observed"))
    return every.join(have, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mid_gap(rows: DataFrame, tau: float | Column) -> DataFrame:
    """Half-way between the greatest negative and the least positive around a threshold, to four places."""
    hit = F.col("p") >= tau
    j = rows.agg(F.max(F.when(~hit, F.col("p"))).alias("low"), F.min(F.when(hit, F.col("p"))).alias("high"))
    return j.select("low", "high", F.round((F.col("low") + F.col("high")) / 2, 4).alias("tau"))


# ---------------------------------------------------------------- percentiles


def nearest_rank(values: Column, p: int) -> Column:
    """The ceil(p n / 100)-th value in order; p in (0, 100]."""
    if not 0 < p <= 100:
        raise ValueError("a percentile lies in (0, 100]")
    return F.element_at(F.sort_array(F.collect_list(values)), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.count(values) / 100)).cast("int"))


def _ranked(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    known = rows.where(F.col(value).isNotNull()).select(*by, value)
    return ranking.ranked(ranking.cut_by(known, by, value), by, [F.col(value)])


def nearest_rank_by(rows: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles of large groups: by ranks within stretches of each, without gathering a group."""
    r = _ranked(rows, by, value)
    pick = lambda p: F.max(F.when(F.col("rank") == F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") / 100)), F.col(value))).alias(f"p{p}")
    return r.groupBy(*by).agg(*[pick(p) for p in percents])


def floor_index_by(rows: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """The other rule: the value at index min(n - 1, floor(q n))."""
    r = _ranked(rows, by, value)
    pick = lambda p: F.max(F.when(F.col("rank") - 1 == F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n") / 100)), F.col(value))).alias(f"p{p}")
    return r.groupBy(*by).agg(*[pick(p) for p in percents])


# ---------------------------------------------------------------- agreement over (item_id, a, b)


def kappa_boolean(rows: DataFrame) -> DataFrame:
    c = rows.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a")).alias("pa"), F.count_if(F.col("b")).alias("pb"))
    po = F.col("same") / F.col("n")
    pe = (F.col("pa") * F.col("pb") + (F.col("n") - F.col("pa")) * (F.col("n") - F.col("pb"))) / (F.col("n") * F.col("n"))
    return c.select("n", po.alias("po"), pe.alias("pe"), F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"))


def kappa(rows: DataFrame) -> DataFrame:
    """Cohen's kappa for any categories: marginals are joined by category."""
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    ma = rows.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("na"))
    mb = rows.groupBy(F.col("b").alias("c")).agg(F.count("*").alias("nb"))
    chance = ma.join(mb, "c").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("x"))
    j = n.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("x") / (F.col("n") * F.col("n"))
    return j.select("n", po.alias("po"), pe.alias("pe"), F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"))


# ---------------------------------------------------------------- span matching on co-keyed pairs


def overlapping(found: DataFrame, gold: DataFrame, rule: str = "overlap") -> DataFrame:
    """found (item_id, f_start, f_end, ...) with gold (item_id, g_start, g_end, ...): pairs that match by a rule."""
    both = F.least("f_end", "g_end") - F.greatest("f_start", "g_start")
    tests = {
        "exact": (F.col("f_start") == F.col("g_start")) & (F.col("f_end") == F.col("g_end")),
        "overlap": (F.col("f_start") < F.col("g_end")) & (F.col("g_start") < F.col("f_end")),
        "iou50": (both > 0) & (2 * both >= (F.col("f_end") - F.col("f_start")) + (F.col("g_end") - F.col("g_start")) - both),
    }
    return found.join(gold, "item_id").where(tests[rule])


def leak_rates(gold: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """Prevention (every gold span of an item touched) and over-blocking (a finding on an item without gold)."""
    hit = gold.join(found, "item_id", "left").groupBy("item_id", "g_start", "g_end").agg(F.coalesce(F.bool_or((F.col("f_start") < F.col("g_end")) & (F.col("g_start") < F.col("f_end"))), F.lit(False)).alias("hit"))
    bearing = hit.groupBy("item_id").agg(F.bool_and("hit").alias("caught"))
    any_found = found.groupBy("item_id").agg(F.count("*").alias("n_found"))
    j = items.join(bearing, "item_id", "left").join(any_found, "item_id", "left")
    clean = F.col("caught").isNull()
    return j.agg(F.count_if(~clean).alias("bearing"), F.count_if(F.col("caught")).alias("caught"), F.count_if(clean).alias("clean"), F.count_if(clean & (F.col("n_found") > 0)).alias("overblocked")).select("*", ratio(F.col("caught"), F.col("bearing")).alias("prevention"), ratio(F.col("overblocked"), F.col("clean")).alias("overblocking"))


def zero_event_bound(n: Column) -> Column:
    """Upper 95 % bound of a rate of which nothing was seen in n tries."""
    return F.lit(1.0) - F.pow(F.lit(0.05), F.lit(1.0) / n)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
