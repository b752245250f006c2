"""Evaluation aggregates over derived spans, scores, calls and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from .base import query, read
from .inputs import CALLS, RATINGS, SCORES, SPAN_PAIRS, view

R = 9


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


def spans(spark, d):
    return view(spark, d, SPAN_PAIRS, "lineitem")


def scores(spark, d):
    return view(spark, d, SCORES, "labels", "documents")


def calls(spark, d):
    return view(spark, d, CALLS, "events")


def ratings(spark, d):
    return view(spark, d, RATINGS, "labels")


def found_gold(spark, d):
    s = spans(spark, d)
    # gold exists on three items of four
    return s.select("item_id", "line", "f_start", "f_end", "f_type"), s.where("item_id % 4 <> 0").select("item_id", F.col("line").alias("g_line"), "g_start", "g_end", "g_type")


FG = f"found AS (SELECT item_id, line, f_start, f_end, f_type FROM ({SPAN_PAIRS}) AS s), gold AS (SELECT item_id, line AS g_line, g_start, g_end, g_type FROM ({SPAN_PAIRS}) AS s WHERE item_id % 4 <> 0)"
OVER = "f_start < g_end AND g_start < f_end"
BOTH = "(least(f_end, g_end) - greatest(f_start, g_start))"
IOU = f"({BOTH} > 0 AND 2 * {BOTH} >= (f_end - f_start) + (g_end - g_start) - {BOTH})"
EXACT = "f_start = g_start AND f_end = g_end"


@query("J05_interval_overlap", f"WITH {FG} SELECT item_id, count(*) AS n_pairs, sum({BOTH})::BIGINT AS chars FROM found JOIN gold USING (item_id) WHERE {OVER} GROUP BY item_id")
def interval_overlap(spark, d):
    f, g = found_gold(spark, d)
    both = F.least("f_end", "g_end") - F.greatest("f_start", "g_start")
    return M.overlapping(f, g).groupBy("item_id").agg(F.count("*").alias("n_pairs"), F.sum(both).alias("chars"))


@query("J06_span_match_rules", f"WITH {FG} SELECT count(*) FILTER (WHERE {EXACT}) AS n_exact, count(*) FILTER (WHERE {OVER}) AS n_overlap, count(*) FILTER (WHERE {IOU}) AS n_iou50 FROM found JOIN gold USING (item_id)")
def match_rules(spark, d):
    f, g = found_gold(spark, d)
    both = F.least("f_end", "g_end") - F.greatest("f_start", "g_start")
    j = f.join(g, "item_id")
    return j.agg(F.count_if((F.col("f_start") == F.col("g_start")) & (F.col("f_end") == F.col("g_end"))).alias("n_exact"), F.count_if((F.col("f_start") < F.col("g_end")) & (F.col("g_start") < F.col("f_end"))).alias("n_overlap"), F.count_if((both > 0) & (2 * both >= (F.col("f_end") - F.col("f_start")) + (F.col("g_end") - F.col("g_start")) - both)).alias("n_iou50"))


@query("F21_iou", f"WITH {FG} SELECT item_id, line, round(greatest(0, {BOTH}) / ((f_end - f_start) + (g_end - g_start) - greatest(0, {BOTH}))::DOUBLE, 9) AS iou FROM found JOIN gold USING (item_id) WHERE line = g_line")
def ious(spark, d):
    from ..functions.scalars import iou

    f, g = found_gold(spark, d)
    return f.join(g, "item_id").where("line = g_line").select("item_id", "line", F.round(iou(F.col("f_start"), F.col("f_end"), F.col("g_start"), F.col("g_end")), R).alias("iou"))


# exact matching by line is one to one here, so its size is a join
EXACT_COUNTS = f"""WITH {FG}, f AS (SELECT DISTINCT item_id, f_start AS s, f_end AS e FROM found), g AS (SELECT DISTINCT item_id, g_start AS s, g_end AS e FROM gold),
  c AS (SELECT (SELECT count(*) FROM f SEMI JOIN g USING (item_id, s, e)) AS tp, (SELECT count(*) FROM f ANTI JOIN g USING (item_id, s, e)) AS fp, (SELECT count(*) FROM g ANTI JOIN f USING (item_id, s, e)) AS fn)"""


def exact_counts(spark, d):
    f, g = found_gold(spark, d)
    a = f.select("item_id", F.col("f_start").alias("s"), F.col("f_end").alias("e")).distinct().withColumn("f", F.lit(1))
    b = g.select("item_id", F.col("g_start").alias("s"), F.col("g_end").alias("e")).distinct().withColumn("g", F.lit(1))
    j = a.join(b, ["item_id", "s", "e"], "full_outer")
    return j.agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))


for name, form, sql in (
    ("A02_micro_prf", M.prf_null, "tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1"),
    ("A03_prf_null_form", M.prf_strict, "tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / nullif(tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE, 0) AS f1"),
    ("A04_prf_zero_form", M.prf_zero, "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / nullif(tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE, 0), 0) AS f1"),
):

    def _prf(spark, d, form=form):
        return rounded(exact_counts(spark, d).select("tp", "fp", "fn", *form(F.col("tp"), F.col("fp"), F.col("fn"))), "precision", "recall", "f1")

    query(name, f"{EXACT_COUNTS} SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (SELECT *, {sql} FROM c) AS x")(_prf)


@query("A01_group_gold", f"SELECT g_type, count(*) AS n_spans, count(DISTINCT item_id) AS n_items FROM ({SPAN_PAIRS}) AS s GROUP BY g_type")
def group_gold(spark, d):
    return spans(spark, d).groupBy("g_type").agg(F.count("*").alias("n_spans"), F.countDistinct("item_id").alias("n_items"))


@query("A09_leak_prevention", f"""WITH {FG}, hit AS (SELECT gold.item_id, g_start, g_end, coalesce(bool_or({OVER}), FALSE) AS hit FROM gold LEFT JOIN (SELECT * FROM found WHERE line % 3 <> 0) AS f ON f.item_id = gold.item_id GROUP BY ALL),
  bearing AS (SELECT item_id, bool_and(hit) AS caught FROM hit GROUP BY item_id), anyf AS (SELECT item_id, count(*) AS n_found FROM found WHERE line % 3 <> 0 GROUP BY item_id),
  t AS (SELECT count(caught) AS bearing, count(*) FILTER (WHERE caught) AS caught, count(*) FILTER (WHERE caught IS NULL) AS clean, count(*) FILTER (WHERE caught IS NULL AND n_found > 0) AS overblocked FROM (SELECT DISTINCT item_id FROM found) AS i LEFT JOIN bearing USING (item_id) LEFT JOIN anyf USING (item_id))
  SELECT *, round(caught / nullif(bearing, 0)::DOUBLE, 9) AS prevention, round(overblocked / nullif(clean, 0)::DOUBLE, 9) AS overblocking FROM t""")
def leak_prevention(spark, d):
    f, g = found_gold(spark, d)
    return rounded(M.leak_rates(g, f.where("line % 3 <> 0"), f.select("item_id").distinct()), "prevention", "overblocking")


@query("A10_blocked_share", f"SELECT round(avg(CAST(b AS DOUBLE)), 9) AS blocked_share FROM (SELECT item_id, CAST(bool_or(f_type = 'R') AS INT) AS b FROM ({SPAN_PAIRS}) AS s WHERE item_id % 4 = 0 GROUP BY item_id) AS x")
def blocked_share(spark, d):
    return spans(spark, d).where("item_id % 4 = 0").groupBy("item_id").agg(F.bool_or(F.col("f_type") == "R").cast("int").alias("b")).agg(F.round(F.avg(F.col("b").cast("double")), R).alias("blocked_share"))


@query("A11_tier0_baseline", f"""WITH {FG}, t AS (SELECT DISTINCT gold.item_id FROM gold JOIN found ON found.item_id = gold.item_id AND {OVER} WHERE f_type = 'N')
  SELECT count(*) AS touched, (SELECT count(DISTINCT item_id) FROM gold) AS bearing FROM t""")
def tier0_baseline(spark, d):
    f, g = found_gold(spark, d)
    touched = M.overlapping(f.where("f_type = 'N'"), g).select("item_id").distinct()
    b = g.select("item_id").distinct().join(touched.withColumn("t", F.lit(1)), "item_id", "left")
    return b.agg(F.count("t").alias("touched"), F.count("*").alias("bearing"))


@query("A12_filter_effect", f"""WITH {FG}, c AS (SELECT found.item_id, line, f_type, coalesce(bool_or({OVER}), FALSE) AS on_gold FROM found LEFT JOIN gold ON gold.item_id = found.item_id GROUP BY ALL)
  SELECT on_gold, f_type = 'R' AS rejected, count(*) AS n FROM c GROUP BY ALL""")
def filter_effect(spark, d):
    f, g = found_gold(spark, d)
    c = f.join(g, "item_id", "left").groupBy("item_id", "line", "f_type").agg(F.coalesce(F.bool_or((F.col("f_start") < F.col("g_end")) & (F.col("g_start") < F.col("f_end"))), F.lit(False)).alias("on_gold"))
    return c.groupBy("on_gold", (F.col("f_type") == "R").alias("rejected")).agg(F.count("*").alias("n"))


@query("J02_gold_records", f"WITH {FG} SELECT count(*) AS gold_rows, count(*) FILTER (WHERE f.item_id IS NULL) AS missing FROM (SELECT DISTINCT item_id FROM gold) AS g LEFT JOIN (SELECT DISTINCT item_id FROM found WHERE line > 2) AS f USING (item_id)")
def gold_records(spark, d):
    f, g = found_gold(spark, d)
    r = f.where("line > 2").select("item_id").distinct().withColumn("x", F.lit(1))
    return g.select("item_id").distinct().join(r, "item_id", "left").agg(F.count("*").alias("gold_rows"), F.count_if(F.col("x").isNull()).alias("missing"))


@query("J03_records_without_gold", f"WITH {FG} SELECT count(DISTINCT item_id) AS n FROM found WHERE item_id NOT IN (SELECT item_id FROM gold)")
def without_gold(spark, d):
    f, g = found_gold(spark, d)
    return f.join(g, "item_id", "left_anti").agg(F.countDistinct("item_id").alias("n"))


@query("J04_policy_hash", "SELECT count(DISTINCT md5(CAST(quality AS STRING))) AS n_hashes, count(*) FILTER (WHERE md5(CAST(quality AS STRING)) <> md5('1')) AS n_other FROM labels")
def policy_hash(spark, d):
    h = F.md5(F.col("quality").cast("string"))
    return read(spark, d, "labels").agg(F.countDistinct(h).alias("n_hashes"), F.count_if(h != F.md5(F.lit("1"))).alias("n_other"))


@query("J16_shadowed_distractors", f"SELECT a.item_id, count(*) AS n FROM ({SPAN_PAIRS}) AS a JOIN ({SPAN_PAIRS}) AS b ON a.item_id = b.item_id AND a.f_type = b.f_type AND a.line < b.line GROUP BY a.item_id")
def shadowed(spark, d):
    s = spans(spark, d)
    a, b = s.select("item_id", "f_type", "line"), s.select("item_id", "f_type", F.col("line").alias("other"))
    return a.join(b, ["item_id", "f_type"]).where("line < other").groupBy("item_id").agg(F.count("*").alias("n"))


@query("U03_contained_spans", f"SELECT item_id, count(*) AS n_kept FROM ({SPAN_PAIRS}) AS a WHERE NOT EXISTS (SELECT 1 FROM ({SPAN_PAIRS}) AS b WHERE b.item_id = a.item_id AND b.f_start <= a.f_start AND a.f_end <= b.f_end AND (b.f_start < a.f_start OR a.f_end < b.f_end)) GROUP BY item_id")
def contained(spark, d):
    s = spans(spark, d).select("item_id", "f_start", "f_end")
    o = s.select("item_id", F.col("f_start").alias("s"), F.col("f_end").alias("e"))
    inside = (F.col("s") <= F.col("f_start")) & (F.col("f_end") <= F.col("e")) & ((F.col("s") < F.col("f_start")) | (F.col("f_end") < F.col("e")))
    a, b = s.alias("a"), o.alias("b")
    return a.join(b, (F.col("a.item_id") == F.col("b.item_id")) & inside, "left_anti").groupBy("item_id").agg(F.count("*").alias("n_kept"))


@query("U02_dedupe_keep_first", f"SELECT item_id, line, f_start, f_end FROM (SELECT *, row_number() OVER (PARTITION BY item_id, f_end - f_start, f_type ORDER BY line) AS r FROM ({SPAN_PAIRS}) AS s) AS x WHERE r = 1")
def keep_first(spark, d):
    w = Window.partitionBy("item_id", F.col("f_end") - F.col("f_start"), "f_type").orderBy("line")
    return spans(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("item_id", "line", "f_start", "f_end")


PLACES = f"(SELECT item_id, f_start AS s, f_end AS e, 0 AS src FROM ({SPAN_PAIRS}) AS a UNION ALL SELECT item_id, g_start, g_end, 1 FROM ({SPAN_PAIRS}) AS b)"
ONE_A_PLACE = f"(SELECT item_id, s, e, min(src) AS src FROM {PLACES} AS u GROUP BY item_id, s, e)"


def places(spark, d):
    s = spans(spark, d)
    return s.select("item_id", F.col("f_start").alias("s"), F.col("f_end").alias("e"), F.lit(0).alias("src")).unionByName(s.select("item_id", F.col("g_start").alias("s"), F.col("g_end").alias("e"), F.lit(1).alias("src")))


@query("P20_candidate_spans", f"SELECT item_id, s, e, src FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s, e, src) AS place FROM {ONE_A_PLACE} AS x) AS y WHERE place <= 24")
def candidates(spark, d):
    from ..operators.candidates import candidate_spans

    return candidate_spans(places(spark, d))


@query("U04_candidate_dedupe", f"SELECT item_id, s, e, src FROM {ONE_A_PLACE} AS x")
def candidate_dedupe(spark, d):
    from ..operators.candidates import one_a_place

    return one_a_place(places(spark, d))


@query("O03_candidate_limit", f"SELECT item_id, s, e, src FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s, e, src) AS place FROM {PLACES} AS x) AS y WHERE place <= 24")
def candidate_limit(spark, d):
    from ..operators.candidates import first_of_item

    return first_of_item(places(spark, d))


@query("W08_top_n_per_item", f"SELECT item_id, line, f_start FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY f_start, line) AS r, count(*) FILTER (WHERE g_type = 'F') OVER (PARTITION BY item_id) AS n_gold FROM ({SPAN_PAIRS}) AS s) AS x WHERE r <= n_gold")
def top_n(spark, d):
    w = Window.partitionBy("item_id")
    return spans(spark, d).withColumn("r", F.row_number().over(w.orderBy("f_start", "line"))).withColumn("n_gold", F.count_if(F.col("g_type") == "F").over(w)).where("r <= n_gold").select("item_id", "line", "f_start")


@query("A35_position", f"SELECT count(*) AS n, count(*) FILTER (WHERE first_type = 'F') AS gold_first FROM (SELECT item_id, first(g_type ORDER BY f_start, g_type) AS first_type FROM ({SPAN_PAIRS}) AS s GROUP BY item_id) AS x")
def position(spark, d):
    return spans(spark, d).groupBy("item_id").agg(F.min_by("g_type", F.struct("f_start", "g_type")).alias("t")).agg(F.count("*").alias("n"), F.count_if(F.col("t") == "F").alias("gold_first"))


# ---------------------------------------------------------------- thresholds

POINT = "sum(CAST(p >= tau AND gold AS BIGINT))::BIGINT AS tp, sum(CAST(p >= tau AND NOT gold AS BIGINT))::BIGINT AS fp, sum(CAST(p < tau AND gold AS BIGINT))::BIGINT AS fn"
ZERO = "coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall"
F1Z = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)"
SWEEP = f"SELECT *, {F1Z} AS f1 FROM (SELECT *, {ZERO} FROM (SELECT tau, {POINT} FROM (SELECT DISTINCT p AS tau FROM ({SCORES}) AS a UNION SELECT CAST(0.5 AS DOUBLE)) AS t, ({SCORES}) AS s GROUP BY tau) AS c) AS z"


@query("A13_threshold_point", f"SELECT CAST(0.5 AS DOUBLE) AS tau, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round({F1Z}, 9) AS f1 FROM (SELECT *, {ZERO} FROM (SELECT {POINT.replace('tau', 'CAST(0.5 AS DOUBLE)')} FROM ({SCORES}) AS s) AS c) AS z")
def threshold_point(spark, d):
    return rounded(M.threshold_point(scores(spark, d), 0.5), "precision", "recall", "f1")


@query("A14_threshold_sweep", f"SELECT tau, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM ({SWEEP}) AS w")
def threshold_sweep(spark, d):
    return rounded(M.sweep(scores(spark, d)), "precision", "recall", "f1")


@query("A15_entity_sweep", f"SELECT step, {POINT.replace('tau', 'step / 20.0::DOUBLE')} FROM range(21) AS r(step), ({SCORES}) AS s GROUP BY step")
def entity_sweep(spark, d):
    s = scores(spark, d).select("p", "gold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))).alias("step"))
    tau = F.col("step") / F.lit(20.0)
    hit = F.col("p") >= tau
    return s.groupBy("step").agg(F.count_if(hit & F.col("gold")).alias("tp"), F.count_if(hit & ~F.col("gold")).alias("fp"), F.count_if(~hit & F.col("gold")).alias("fn"))


@query("A16_best_point", f"SELECT tau, round(f1, 9) AS f1 FROM ({SWEEP}) AS w ORDER BY w.f1 DESC, tau LIMIT 1")
def best_point(spark, d):
    return rounded(M.best_point(M.sweep(scores(spark, d))), "f1")


@query("A17_roc_auc", f"SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 9) AS auc FROM ({SCORES}) AS a, ({SCORES}) AS b WHERE a.gold AND NOT b.gold")
def roc_auc(spark, d):
    return rounded(M.roc_auc(scores(spark, d)), "auc")


@query("A18_average_precision", f"SELECT round(avg(tp / r::DOUBLE), 9) AS average_precision FROM (SELECT gold, row_number() OVER w AS r, sum(CAST(gold AS INT)) OVER w AS tp FROM ({SCORES}) AS s WINDOW w AS (ORDER BY p DESC, item_id)) AS x WHERE gold")
def average_precision(spark, d):
    return rounded(M.average_precision(scores(spark, d)), "average_precision")


@query("A19_calibration", f"SELECT bin, coalesce(n, 0) AS n, round(mean_p, 9) AS mean_p, round(observed, 9) AS observed FROM range(10) AS r(bin) LEFT JOIN (SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, avg(p) AS mean_p, avg(CAST(gold AS DOUBLE)) AS observed FROM ({SCORES}) AS s GROUP BY 1) AS x USING (bin)")
def calibration(spark, d):
    return rounded(M.calibration(scores(spark, d)), "mean_p", "observed")


@query("A21_mid_gap", f"SELECT low, high, round((low + high) / 2, 4) AS tau FROM (SELECT max(p) FILTER (WHERE p < 0.4) AS low, min(p) FILTER (WHERE p >= 0.4) AS high FROM ({SCORES}) AS s) AS x")
def mid_gap(spark, d):
    return M.mid_gap(scores(spark, d), 0.4)


@query("J20_probability_gold", f"SELECT count(*) AS n, count(*) FILTER (WHERE p IS NULL) AS unanswered FROM (SELECT l.doc_id, CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE 1 END AS p FROM labels l JOIN documents d ON d.doc_id = l.doc_id) AS x")
def probability_gold(spark, d):
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id"), "doc_id").withColumn("p", F.when(F.col("doc_id") % 9 != 0, 1))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("p").isNull()).alias("unanswered"))


@query("S08_predicate_gold", "SELECT count(*) AS n_scored, count(*) FILTER (WHERE toxic = 1) AS n_positive FROM labels WHERE quality = 1")
def predicate_gold(spark, d):
    return read(spark, d, "labels").where("quality = 1").agg(F.count("*").alias("n_scored"), F.count_if(F.col("toxic") == 1).alias("n_positive"))


@query("A07_gold_summary", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality = 1) AS scored, count(*) FILTER (WHERE quality = 0) AS disputed, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS positives FROM labels")
def gold_summary(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return read(spark, d, "labels").agg(F.count("*").alias("n_rows"), F.count_if(q).alias("scored"), F.count_if(~q).alias("disputed"), F.count_if(q & t).alias("positives"))


@query("A08_unanswered", "SELECT count(*) AS unanswered, count(*) FILTER (WHERE toxic = 1) AS positives FROM labels l WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = l.doc_id)")
def unanswered(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "events").select(F.col("user_id").alias("doc_id")), "doc_id", "left_anti").agg(F.count("*").alias("unanswered"), F.count_if(F.col("toxic") == 1).alias("positives"))


for _n, _sql in (("A54_message_level", "d.text LIKE '%!!%'"), ("A55_message_floor", "regexp_matches(d.text, '[A-Z][a-z]+ [A-Z][a-z]+')")):

    def _message(spark, d, name=_n):
        j = read(spark, d, "labels").where("quality = 1").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
        fires = F.col("text").contains("!!") if name.startswith("A54") else F.col("text").rlike("[A-Z][a-z]+ [A-Z][a-z]+")
        gold = F.col("toxic") == 1
        return j.agg(F.count_if(fires & gold).alias("tp"), F.count_if(fires & ~gold).alias("fp"), F.count_if(~fires & gold).alias("fn"))

    query(_n, f"SELECT count(*) FILTER (WHERE {_sql} AND toxic = 1) AS tp, count(*) FILTER (WHERE {_sql} AND toxic <> 1) AS fp, count(*) FILTER (WHERE NOT ({_sql}) AND toxic = 1) AS fn FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 1")(_message)


@query("A42_zero_event_bound", f"SELECT g_type, count(*) AS n, round(1 - pow(0.05::DOUBLE, 1.0::DOUBLE / count(*)), 9) AS bound FROM ({SPAN_PAIRS}) AS s GROUP BY g_type")
def zero_event(spark, d):
    return spans(spark, d).groupBy("g_type").agg(F.count("*").alias("n")).withColumn("bound", F.round(M.zero_event_bound(F.col("n")), R))


# ---------------------------------------------------------------- agreement


@query("A29_kappa_boolean", f"SELECT n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa FROM (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po, avg(CAST(a = 1 AS DOUBLE)) * avg(CAST(b = 1 AS DOUBLE)) + (1 - avg(CAST(a = 1 AS DOUBLE))) * (1 - avg(CAST(b = 1 AS DOUBLE))) AS pe FROM ({RATINGS}) AS r) AS x")
def kappa_boolean(spark, d):
    r = ratings(spark, d).select("item_id", (F.col("a") == 1).alias("a"), (F.col("b") == 1).alias("b"))
    return rounded(M.kappa_boolean(r), "po", "pe", "kappa")


MULTI = "SELECT l_orderkey AS item_id, l_returnflag AS a, CASE WHEN l_linenumber % 3 = 0 THEN 'N' ELSE l_returnflag END AS b FROM lineitem"


@query("A30_pairwise_agreement", f"WITH r AS ({MULTI}), n AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po FROM r), pe AS (SELECT sum(na * nb) / (SELECT n * n FROM n)::DOUBLE AS pe FROM (SELECT a AS c, count(*) AS na FROM r GROUP BY a) AS x JOIN (SELECT b AS c, count(*) AS nb FROM r GROUP BY b) AS y USING (c)) SELECT n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa FROM n, pe")
def agreement(spark, d):
    return rounded(M.kappa(view(spark, d, MULTI, "lineitem")), "po", "pe", "kappa")


@query("A31_override_rates", f"WITH r AS ({MULTI}) SELECT a, round(avg(CAST(a <> b AS DOUBLE)), 9) AS rate, coalesce(string_agg(DISTINCT b, ',' ORDER BY b) FILTER (WHERE a <> b), '') AS corrected FROM r GROUP BY a")
def overrides(spark, d):
    r = view(spark, d, MULTI, "lineitem")
    return r.groupBy("a").agg(F.round(F.avg((F.col("a") != F.col("b")).cast("double")), R).alias("rate"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("a") != F.col("b"), F.col("b")))), ",").alias("corrected"))


STATE = "CASE WHEN a IS NULL OR b IS NULL THEN 'uncovered' WHEN a <> b THEN 'disputed' ELSE 'labelled' END"
TWO = "SELECT coalesce(x.doc_id, y.doc_id) AS item_id, x.quality AS a, y.toxic AS b FROM (SELECT * FROM labels WHERE doc_id % 5 <> 0) AS x FULL OUTER JOIN (SELECT * FROM labels WHERE doc_id % 7 <> 0) AS y ON x.doc_id = y.doc_id"
for _n in ("A32_adjudication_tallies", "F35_predicate_verdict"):

    @query(_n, f"SELECT {STATE} AS state, count(*) AS n FROM ({TWO}) AS t GROUP BY 1")
    def tallies(spark, d):
        from ..operators.labelling import verdict

        lab = read(spark, d, "labels")
        a = lab.where("doc_id % 5 <> 0").select("doc_id", F.col("quality").alias("a"))
        b = lab.where("doc_id % 7 <> 0").select("doc_id", F.col("toxic").alias("b"))
        return a.join(b, "doc_id", "full_outer").groupBy(verdict(F.col("a"), F.col("b")).alias("state")).agg(F.count("*").alias("n"))


@query("J23_annotator_coverage", f"SELECT count(*) FILTER (WHERE a IS NULL) AS only_second, count(*) FILTER (WHERE b IS NULL) AS only_first, count(*) AS n FROM ({TWO}) AS t")
def coverage(spark, d):
    lab = read(spark, d, "labels")
    a = lab.where("doc_id % 5 <> 0").select("doc_id", F.col("quality").alias("a"))
    b = lab.where("doc_id % 7 <> 0").select("doc_id", F.col("toxic").alias("b"))
    return a.join(b, "doc_id", "full_outer").agg(F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count("*").alias("n"))


@query("F36_admission", "SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'admitted' WHEN quality = 0 THEN 'refused:first' ELSE 'refused:second' END AS verdict, count(*) AS n FROM labels GROUP BY 1")
def admission(spark, d):
    from ..operators.labelling import admission

    return read(spark, d, "labels").groupBy(admission(F.col("quality") == 1, F.col("toxic") == 0).alias("verdict")).agg(F.count("*").alias("n"))


@query("P31_admitted", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def admitted(spark, d):
    lab = read(spark, d, "labels")
    return lab.select("doc_id").join(lab.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("P32_scoring_scope", f"SELECT f_type, count(*) AS n FROM ({SPAN_PAIRS}) AS s WHERE f_type NOT IN ('R') GROUP BY f_type")
def scoring_scope(spark, d):
    out = spark.createDataFrame([("R",)], "f_type string")
    return spans(spark, d).join(F.broadcast(out), "f_type", "left_anti").groupBy("f_type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- calls: percentiles, gates, cost


@query("A25_nearest_rank", f"SELECT arm, quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95 FROM ({CALLS}) AS c GROUP BY arm")
def nearest_rank(spark, d):
    return M.nearest_rank_by(calls(spark, d), ["arm"], "latency", [50, 95])


FLOOR = lambda q: f"list_sort(list(latency))[least(count(*), CAST(floor({q} * count(*) / 100.0) AS BIGINT) + 1)]"
for _n in ("A26_floor_index", "A58_latency_pooling"):

    @query(_n, f"SELECT arm, {FLOOR(50)} AS p50, {FLOOR(95)} AS p95 FROM ({CALLS}) AS c GROUP BY arm")
    def floor_index(spark, d):
        return M.floor_index_by(calls(spark, d), ["arm"], "latency", [50, 95])


for _n in ("A27_size_statistics", "A28_segment_sizes"):

    @query(_n, "SELECT lang, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, quantile_disc(length(text), 0.5)::BIGINT AS p50, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
    def sizes(spark, d):
        s = read(spark, d, "documents").select("lang", F.length("text").cast("long").alias("n_chars"), F.octet_length("text").alias("bytes"))
        half = M.nearest_rank_by(s, ["lang"], "n_chars", [50])
        return s.groupBy("lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum("bytes").alias("bytes")).join(half, "lang")


for _n in ("A45_arm_gates", "A49_transport"):

    @query(_n, f"SELECT arm, count(*) AS n_calls, round(sum(tokens) / sum(tokens / (latency + 1)), 6) AS sustained, count(*) FILTER (WHERE status = 429) AS n_429, count(*) FILTER (WHERE finish = 'length') AS truncated, round(sum(tokens) * 0.002::DOUBLE, 6) AS cost FROM ({CALLS}) AS c GROUP BY arm")
    def arm_gates(spark, d):
        c = calls(spark, d)
        return c.groupBy("arm").agg(F.count("*").alias("n_calls"), F.round(F.sum("tokens") / F.sum(F.col("tokens") / (F.col("latency") + 1)), 6).alias("sustained"), F.count_if(F.col("status") == 429).alias("n_429"), F.count_if(F.col("finish") == "length").alias("truncated"), F.round(F.sum("tokens") * F.lit(0.002), 6).alias("cost"))


@query("A46_gate_verdicts", f"SELECT arm, CASE WHEN count(*) < 20 THEN 'not-measured' WHEN quantile_disc(latency, 0.95) <= 150 THEN 'pass' ELSE 'fail' END AS latency_gate, CASE WHEN avg(tokens) >= 25 THEN 'pass' ELSE 'fail' END AS decode_gate FROM ({CALLS}) AS c GROUP BY arm")
def gate_verdicts(spark, d):
    from ..operators.gates import at_least, at_most

    c = calls(spark, d)
    p = M.nearest_rank_by(c, ["arm"], "latency", [95])
    n = c.groupBy("arm").agg(F.count("*").alias("n"), F.avg("tokens").alias("rate"))
    return n.join(p, "arm").select("arm", at_most(F.col("p95"), 150, F.col("n"), 20).alias("latency_gate"), at_least(F.col("rate"), 25, F.col("n"), 0).alias("decode_gate"))


@query("W12_first_after_stop", f"SELECT arm, arg_min(call_id, call_id) AS call_id FROM (SELECT *, max(CAST(finish = 'stop' AS INT)) OVER (PARTITION BY arm ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM ({CALLS}) AS c) AS x WHERE stopped = 1 GROUP BY arm")
def after_stop(spark, d):
    w = Window.partitionBy("arm").orderBy("call_id").rowsBetween(Window.unboundedPreceding, -1)
    return calls(spark, d).withColumn("s", F.max((F.col("finish") == "stop").cast("int")).over(w)).where("s = 1").groupBy("arm").agg(F.min("call_id").alias("call_id"))


for _n in ("A24_cost_time", "A60_cost_per_1000"):

    @query(_n, f"SELECT arm, round(sum(tokens) * 0.002::DOUBLE, 6) AS cost, round(sum(tokens) * 0.002::DOUBLE / count(DISTINCT item_id) * 1000, 6) AS per_1000 FROM ({CALLS}) AS c GROUP BY arm")
    def cost_time(spark, d):
        cost = F.sum("tokens") * F.lit(0.002)
        return calls(spark, d).groupBy("arm").agg(F.round(cost, 6).alias("cost"), F.round(cost / F.countDistinct("item_id") * 1000, 6).alias("per_1000"))


@query("A50_spend_ledger", f"SELECT arm, min(call_id) FILTER (WHERE spent >= 40000) AS trip, max(spent)::BIGINT AS total FROM (SELECT arm, call_id, sum(tokens) OVER (PARTITION BY arm ORDER BY call_id ROWS UNBOUNDED PRECEDING) AS spent FROM ({CALLS}) AS c) AS x GROUP BY arm")
def ledger(spark, d):
    w = Window.partitionBy("arm").orderBy("call_id").rowsBetween(Window.unboundedPreceding, 0)
    return calls(spark, d).withColumn("spent", F.sum("tokens").over(w)).groupBy("arm").agg(F.min(F.when(F.col("spent") >= 40000, F.col("call_id"))).alias("trip"), F.max("spent").alias("total"))


@query("J18_ledger_segments", f"SELECT s.arm, s.budget, coalesce(sum(c.tokens), 0)::BIGINT AS spent, coalesce(bool_or(c.status = 429), FALSE) AS limited FROM (SELECT * FROM (VALUES ('view', 100), ('click', 200), ('none', 300)) AS v(arm, budget)) AS s LEFT JOIN ({CALLS}) AS c ON c.arm = s.arm GROUP BY ALL")
def ledger_segments(spark, d):
    spec = spark.createDataFrame([("view", 100), ("click", 200), ("none", 300)], "arm string, budget int")
    c = calls(spark, d).groupBy("arm").agg(F.sum("tokens").alias("spent"), F.bool_or(F.col("status") == 429).alias("limited"))
    return spec.join(c, "arm", "left").select("arm", "budget", F.coalesce("spent", F.lit(0)).alias("spent"), F.coalesce("limited", F.lit(False)).alias("limited"))


@query("A57_pass_spread", f"SELECT arm, round(max(f) - min(f), 9) AS spread FROM (SELECT arm, pass, avg(CAST(finish = 'done' AS DOUBLE)) AS f FROM ({CALLS}) AS c GROUP BY arm, pass) AS x GROUP BY arm HAVING count(*) = 3")
def spread(spark, d):
    f = calls(spark, d).groupBy("arm", "pass").agg(F.avg((F.col("finish") == "done").cast("double")).alias("f"))
    return f.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.max("f") - F.min("f"), R).alias("spread")).where("n = 3").drop("n")


@query("A59_output_tally", f"SELECT finish, count(*) AS n, count(*) FILTER (WHERE tokens >= 40) AS long FROM ({CALLS}) AS c GROUP BY finish")
def tally(spark, d):
    return calls(spark, d).groupBy("finish").agg(F.count("*").alias("n"), F.count_if(F.col("tokens") >= 40).alias("long"))


@query("A61_probe_summary", f"SELECT arm, count(*) FILTER (WHERE finish = 'done') AS parsed, count(*) AS attempted, bool_and(status = 200) AS pinned FROM ({CALLS}) AS c GROUP BY arm")
def probe(spark, d):
    return calls(spark, d).groupBy("arm").agg(F.count_if(F.col("finish") == "done").alias("parsed"), F.count("*").alias("attempted"), F.bool_and(F.col("status") == 200).alias("pinned"))


@query("A62_rollup_report", f"SELECT arm, pass, count(*) AS n FROM ({CALLS}) AS c GROUP BY ROLLUP (arm, pass)")
def rollup(spark, d):
    return calls(spark, d).rollup("arm", "pass").agg(F.count("*").alias("n"))


@query("A66_report_pivot", f"SELECT arm, count(*) FILTER (WHERE finish = 'done') AS done, count(*) FILTER (WHERE finish = 'length') AS length, count(*) FILTER (WHERE finish = 'stop') AS stop FROM ({CALLS}) AS c GROUP BY arm")
def pivot(spark, d):
    return calls(spark, d).groupBy("arm").pivot("finish", ["done", "length", "stop"]).count().na.fill(0)


@query("A68_median", f"SELECT arm, round(median(latency), 9) AS median FROM ({CALLS}) AS c GROUP BY arm")
def median(spark, d):
    return calls(spark, d).groupBy("arm").agg(F.round(F.percentile("latency", 0.5), R).alias("median"))


@query("A05_score_arm", f"SELECT arm, count(*) AS n, count(*) FILTER (WHERE finish = 'length') AS truncated, count(*) FILTER (WHERE finish = 'stop') AS stopped, count(DISTINCT item_id) AS items FROM ({CALLS}) AS c GROUP BY arm")
def score_arm(spark, d):
    return calls(spark, d).groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("finish") == "length").alias("truncated"), F.count_if(F.col("finish") == "stop").alias("stopped"), F.countDistinct("item_id").alias("items"))


query("A06_score_all_arms", f"SELECT arm, count(*) AS n, count(*) FILTER (WHERE finish = 'length') AS truncated, count(*) FILTER (WHERE finish = 'stop') AS stopped, count(DISTINCT item_id) AS items FROM ({CALLS}) AS c GROUP BY arm")(score_arm)


@query("A52_winners_by_rule", f"SELECT pass, string_agg(arm, ',' ORDER BY arm) AS winners FROM (SELECT *, rank() OVER (PARTITION BY pass ORDER BY n DESC) AS r FROM (SELECT arm, pass, count(*) AS n FROM ({CALLS}) AS c GROUP BY arm, pass) AS x) AS y WHERE r = 1 GROUP BY pass")
def winners(spark, d):
    n = calls(spark, d).groupBy("arm", "pass").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.rank().over(Window.partitionBy("pass").orderBy(F.desc("n")))).where("r = 1").groupBy("pass").agg(F.array_join(F.sort_array(F.collect_list("arm")), ",").alias("winners"))


@query("O07_arm_ranking", f"SELECT arm, row_number() OVER (ORDER BY f DESC NULLS LAST, arm) AS place FROM (SELECT arm, CASE WHEN arm = 'view' THEN NULL ELSE avg(CAST(finish = 'done' AS DOUBLE)) END AS f FROM ({CALLS}) AS c GROUP BY arm) AS x")
def ranking(spark, d):
    f = calls(spark, d).groupBy("arm").agg(F.avg((F.col("finish") == "done").cast("double")).alias("f")).withColumn("f", F.when(F.col("arm") != "view", F.col("f")))
    return f.select("arm", F.row_number().over(Window.orderBy(F.desc_nulls_last("f"), "arm")).cast("long").alias("place"))


@query("P29_attempted", f"SELECT item_id FROM ({CALLS}) AS c GROUP BY item_id HAVING count(*) FILTER (WHERE finish = 'stop') + count(*) FILTER (WHERE finish = 'length') > 0")
def attempted(spark, d):
    return calls(spark, d).groupBy("item_id").agg(F.count_if(F.col("finish").isin("stop", "length")).alias("n")).where("n > 0").select("item_id")


@query("P28_tier_assisted", f"SELECT arm, regexp_matches(arm, '^cl|ch') AS assisted FROM ({CALLS}) AS c GROUP BY arm")
def assisted(spark, d):
    return calls(spark, d).select("arm").distinct().select("arm", F.col("arm").rlike("^cl|ch").alias("assisted"))


@query("P25_later_pass_gate", f"SELECT pass, pass = 0 OR (SELECT sum(tokens) FROM ({CALLS}) AS a WHERE pass = 0) < 250000 AS runs FROM ({CALLS}) AS c GROUP BY pass")
def later_pass(spark, d):
    c = calls(spark, d)
    spent = c.where("pass = 0").agg(F.sum("tokens").alias("t"))
    return c.select("pass").distinct().crossJoin(spent).select("pass", ((F.col("pass") == 0) | (F.col("t") < 250000)).alias("runs"))


@query("P27_backend_trust", f"SELECT DISTINCT arm FROM ({CALLS}) AS c WHERE arm NOT IN ('click', 'purchase')")
def trust(spark, d):
    return calls(spark, d).select("arm").distinct().join(spark.createDataFrame([("click",), ("purchase",)], "arm string"), "arm", "left_anti")


@query("P24_not_predicate", "SELECT count(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN 'pred:x' ELSE 'EMAIL' END AS t FROM labels) AS x WHERE t NOT LIKE 'pred:%'")
def not_predicate(spark, d):
    t = F.when(F.col("quality") == 1, "pred:x").otherwise("EMAIL")
    return read(spark, d, "labels").where(~t.startswith("pred:")).agg(F.count("*").alias("n"))


@query("A48_deadline_bound", f"SELECT arm, round(least(1500 + 20, count(*) * (latency_mean + 20)) + 5, 6) AS deadline FROM (SELECT arm, avg(latency) OVER (PARTITION BY arm) AS latency_mean FROM ({CALLS}) AS c) AS x GROUP BY arm, latency_mean")
def deadline(spark, d):
    c = calls(spark, d).groupBy("arm").agg(F.count("*").alias("n"), F.avg("latency").alias("m"))
    from ..operators.gates import deadline_bound

    return c.select("arm", F.round(deadline_bound(F.lit(1500), F.col("n"), F.col("m"), F.lit(5)), 6).alias("deadline"))


@query("A47_minimum_sample", "SELECT p, ceil(100.0 / (100 - p))::BIGINT AS n FROM (VALUES (50), (90), (95)) AS v(p)")
def minimum_sample(spark, d):
    from ..operators.gates import minimum_sample

    return spark.createDataFrame([(p, minimum_sample(p)) for p in (50, 90, 95)], "p int, n long")


@query("M28_retry_policy", f"SELECT status, CASE WHEN status IN (429, 529) OR status >= 500 THEN TRUE ELSE FALSE END AS retryable, k, least(16000, 500 * pow(2, k - 1))::BIGINT AS delay FROM (SELECT DISTINCT status FROM ({CALLS}) AS c) AS s, range(1, 8) AS r(k)")
def retry(spark, d):
    from ..operators.gates import backoff_ms, retryable

    return calls(spark, d).select("status").distinct().withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long")))).select("status", retryable(F.col("status")).alias("retryable"), "k", backoff_ms(F.col("k")).alias("delay"))


@query("M30_stats_delta", f"SELECT arm, (max(tokens) - min(tokens))::BIGINT AS d_tokens, round(max(latency) - min(latency), 9) AS d_latency FROM ({CALLS}) AS c GROUP BY arm")
def stats_delta(spark, d):
    return calls(spark, d).groupBy("arm").agg((F.max("tokens") - F.min("tokens")).alias("d_tokens"), F.round(F.max("latency") - F.min("latency"), R).alias("d_latency"))


@query("M16_call_projection", f"SELECT call_id, round(latency * 1000, 6) AS ttft_ms, tokens FROM ({CALLS}) AS c")
def call_projection(spark, d):
    return calls(spark, d).select("call_id", F.round(F.col("latency") * 1000, 6).alias("ttft_ms"), "tokens")
