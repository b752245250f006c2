"""Sources and sinks, matching, vault, models with stand-ins, streams and whole pipelines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import injection as I
from ..operators import matching as G
from ..operators import metrics as M
from ..operators import tagging, vault
from ..plans import generation, tuning
from ..sources import jsonl, scratch
from ..sources.store import VaultStore
from ..sources.testdata_policy import POLICY
from ..streaming import windows
from .base import query, read, sql_spans
from .evaluation import found_gold, scores
from .functions import TITLE
from .inputs import SPAN_PAIRS, view

# ---------------------------------------------------------------- sources and sinks


def _items(spark, d):
    c = read(spark, d, "customer")
    gold = F.array(F.struct(F.lit(0).alias("start"), F.lit(8).alias("end"), F.substring("c_name", 1, 8).alias("text"), F.lit("NAME").alias("entityType"), F.lit("redact").alias("action")))
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text"), F.lit("p").alias("policy"), gold.alias("gold"), F.lit("{}").alias("meta"))


def _round_trip(rows, schema, name, *by):
    path = scratch.folder(rows.sparkSession, name)
    jsonl.write_once(rows, path, *by)
    return jsonl.scan(rows.sparkSession, path, schema)


for _n in ("S03_corpus_scan", "S13_record_sink", "S15_corpus_serialiser"):

    @query(_n, "SELECT CAST(c_custkey AS STRING) AS id, c_name AS text, 1::BIGINT AS n_gold, substring(c_name, 1, 8) AS gold_text FROM customer")
    def corpus_scan(spark, d):
        items = _round_trip(_items(spark, d), jsonl.CORPUS, "corpus")
        return items.select("id", "text", F.size("gold").cast("long").alias("n_gold"), F.col("gold")[0]["text"].alias("gold_text"))


@query("S04_gold_scan", "SELECT CAST(doc_id AS STRING) AS id, 'satisfied-without-spans' AS reason FROM labels WHERE toxic = 1")
def gold_scan(spark, d):
    lab = read(spark, d, "labels")
    h = F.sha2(F.lit("policy"), 256)
    rows = lab.select(F.col("doc_id").cast("string").alias("itemId"), h.alias("policyHash"), F.lit("scored").alias("status"), (F.col("toxic") == 1).alias("satisfies"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))
    return jsonl.gold_violations(_round_trip(rows, jsonl.GOLD, "gold"))


for _n in ("S05_run_record_scan", "S06_hosted_record_scan"):

    @query(_n, "SELECT event_type AS arm, count(*) AS n, sum(user_id % 50 + 1)::BIGINT AS tokens FROM events GROUP BY 1")
    def run_records(spark, d):
        e = read(spark, d, "events")
        call = F.struct(F.lit("stop").alias("finishReason"), (F.col("user_id") % 50 + 1).cast("int").alias("completionTokens"))
        rows = e.select(F.lit(1).alias("schemaVersion"), F.col("event_id").cast("string").alias("itemId"), F.col("event_type").alias("arm"), F.array(call).alias("calls"))
        back = _round_trip(rows, jsonl.RUN, "runs")
        return back.select("arm", F.explode("calls").alias("c")).groupBy("arm").agg(F.count("*").alias("n"), F.sum("c.completionTokens").alias("tokens"))


@query("S07_judgment_scan", "SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 5 = 0) AS without FROM embeddings")
def judgments(spark, d):
    e = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("itemId"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")[0].cast("double")).alias("predicateProbability"))
    return _round_trip(e, jsonl.JUDGMENT, "judgments").agg(F.count("*").alias("n"), F.count_if(F.col("predicateProbability").isNull()).alias("without"))


@query("S09_returns_scan", "SELECT substring(md5(CAST(doc_id AS STRING)), 1, 16) AS id, 'quote-rule' AS reason FROM labels WHERE toxic = 1 AND quality = 1")
def returns(spark, d):
    lab = read(spark, d, "labels").select(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 16).alias("rowId"), (F.col("toxic") == 1).alias("violates"), F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "q").alias("quote"))
    return jsonl.returns_violations(_round_trip(lab, jsonl.RETURNS, "returns"))


@query("S11_selftest_examples", "SELECT concat('case:', CAST(n_regionkey AS STRING)) AS source, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT 'f:positives', 2 UNION ALL SELECT 'f:negatives', 1")
def examples(spark, d):
    cases = read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("text"), F.col("n_regionkey").cast("string").alias("corpusTag"))).alias("cases"))
    fixtures = spark.createDataFrame([("f", ["a", "b"], ["c"])], "id string, positives array<string>, negatives array<string>")
    return jsonl.selftest_examples(cases, fixtures).groupBy("source").agg(F.count("*").alias("n"))


@query("S14_refuse_overwrite", "SELECT TRUE AS refused, 25::BIGINT AS n")
def refuse(spark, d):
    path, rows = scratch.folder(spark, "once"), read(spark, d, "nation").select("n_name")
    jsonl.write_once(rows, path)
    try:
        jsonl.write_once(rows, path)
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return jsonl.scan(spark, path, "n_name string").agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))


@query("S18_vault_store", "SELECT conv_id, count(DISTINCT role) AS n FROM conversations GROUP BY conv_id")
def vault_store(spark, d):
    store = VaultStore(spark, scratch.folder(spark, "vault"))
    c = read(spark, d, "conversations").select("conv_id", F.lit("ROLE").alias("entity_type"), F.col("role").alias("real"), F.concat(F.lit("x-"), "role").alias("surrogate")).distinct()
    store.put(c)
    store.put(c)
    return store.get().groupBy("conv_id").agg(F.count("*").alias("n"))


@query("S19_hashed_input")
def hashed_input(spark, d):
    path = scratch.folder(spark, "input")
    jsonl.write_sorted(read(spark, d, "region").select("r_name"), path, "r_name")
    return jsonl.hashed_files(spark, path).where("path like '%part-%'").select("sha256")


@query("S20_partitioned_sink", "SELECT CAST(event_id % 3 AS INT) AS pass, event_type AS arm, count(*) AS n FROM events GROUP BY ALL")
def partitioned_sink(spark, d):
    e = read(spark, d, "events").select((F.col("event_id") % 3).cast("int").alias("pass"), F.col("event_type").alias("arm"), "event_id")
    return _round_trip(e, "pass int, arm string, event_id long", "arms", "pass", "arm").groupBy("pass", "arm").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- matching

EXACT = f"""SELECT coalesce(f.item_id, g.item_id) AS item_id, sum(least(coalesce(nf, 0), coalesce(ng, 0)))::BIGINT AS tp, sum(coalesce(nf, 0) - least(coalesce(nf, 0), coalesce(ng, 0)))::BIGINT AS fp, sum(coalesce(ng, 0) - least(coalesce(nf, 0), coalesce(ng, 0)))::BIGINT AS fn
  FROM (SELECT item_id, f_start AS s, f_end AS e, count(*) AS nf FROM ({SPAN_PAIRS}) AS a GROUP BY ALL) AS f FULL OUTER JOIN (SELECT item_id, g_start AS s, g_end AS e, count(*) AS ng FROM ({SPAN_PAIRS}) AS a WHERE item_id % 4 <> 0 GROUP BY ALL) AS g ON f.item_id = g.item_id AND f.s = g.s AND f.e = g.e GROUP BY 1"""
for _n, _how in (("J07_maximum_matching", G.maximum_matching), ("J08_greedy_pairing", G.greedy_matching)):

    def _match(spark, d, how=_how):
        f, g = found_gold(spark, d)
        return G.match_counts(f.select("item_id", "f_start", "f_end"), g.select("item_id", "g_start", "g_end"), "exact", how)

    query(_n, EXACT)(_match)

for _n in ("A56_entity_overlap_score", "A63_span_level_score"):

    @query(_n)
    def entity_overlap(spark, d):
        f, g = found_gold(spark, d)
        c = G.match_counts(f.select("item_id", "f_start", "f_end"), g.select("item_id", "g_start", "g_end"), "overlap", G.greedy_matching)
        t = c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        return t.select("tp", "fp", "fn", *M.prf_strict(F.col("tp"), F.col("fp"), F.col("fn")))


@query("A22_per_type_tuning")
def per_type(spark, d):
    rows = scores(spark, d).withColumn("type", F.when(F.col("other"), "a").otherwise("b"))
    return spark.createDataFrame(sorted(tuning.tune_per_type(rows).items()), "type string, threshold double")


@query("A23_cross_validation")
def cross_validation(spark, d):
    rows = scores(spark, d).withColumn("type", F.when(F.col("other"), "a").otherwise("b"))
    return spark.createDataFrame([tuning.cross_validate(rows)], "tp long, fp long, fn long")


# ---------------------------------------------------------------- injection, vault, rehydration

PUTS = "SELECT c_custkey AS item_id, CAST(4 + c_custkey % 5 AS INT) AS off, concat('V', CAST(c_custkey * 31 AS STRING), 'x') AS value FROM customer"


def _injected(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("text"))
    p = view(spark, d, PUTS, "customer").select("item_id", F.col("off").alias("at"), F.lit(0).alias("k"), F.lit(" <").alias("prefix"), "value", F.lit("> ").alias("suffix"), F.lit("ID").alias("type"))
    return I.inject(c, p)


@query("R12_injection", f"SELECT item_id, concat(substring(c_name, 1, off), ' <', value, '> ', substring(c_name, off + 1, 100)) AS text, (off + 2)::BIGINT AS s_start, (off + 2 + length(value))::BIGINT AS s_end FROM ({PUTS}) AS p JOIN customer c ON c.c_custkey = p.item_id")
def injection(spark, d):
    return _injected(spark, d).select("item_id", "text", F.col("spans")[0]["start"].cast("long").alias("s_start"), F.col("spans")[0]["end"].cast("long").alias("s_end"))


@query("R13_injection_invariant", "SELECT 0::BIGINT AS violations")
def invariant(spark, d):
    return I.invariant_violations(_injected(spark, d)).agg(F.count("*").alias("violations"))


def _minted(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.lit(0).alias("start"), F.lit("NAME").alias("entity_type"), F.lit("person-name").alias("kind"), F.regexp_extract("text", r"([A-Za-z]{6,})", 1).alias("real")).where("real <> ''")
    return vault.mint_all(c, "salt")


@query("R03_vault_mint")
def vault_mint(spark, d):
    return _minted(spark, d)


for _n in ("R04_unique_ladder", "R05_surrogates"):

    @query(_n, "SELECT count(DISTINCT (conv_id, regexp_extract(text, '([A-Za-z]{6,})', 1))) AS n, 0::BIGINT AS repeated FROM conversations WHERE regexp_extract(text, '([A-Za-z]{6,})', 1) <> ''")
    def surrogates(spark, d):
        m = _minted(spark, d)
        return m.groupBy("conv_id", "surrogate").agg(F.count("*").alias("k")).agg(F.sum("k").alias("n"), F.count_if(F.col("k") > 1).alias("repeated"))


@query("R08_rehydration_map", "SELECT conv_id, count(DISTINCT regexp_extract(text, '([A-Za-z]{6,})', 1)) AS n FROM conversations WHERE regexp_extract(text, '([A-Za-z]{6,})', 1) <> '' GROUP BY conv_id")
def rehydration_map(spark, d):
    m = _minted(spark, d)
    return m.groupBy("conv_id").agg(F.size(F.map_from_entries(F.collect_list(F.struct("surrogate", "real")))).cast("long").alias("n"))


@query("R09_rehydrate", "SELECT conv_id, turn, text FROM conversations")
def rehydrate(spark, d):
    """Values are replaced by their surrogates and put back: what comes out is what went in."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    m = spark.createDataFrame([("the", "Alba Abel")], "real string, surrogate string")
    v = c.select("conv_id").distinct().crossJoin(F.broadcast(m))  # one row a conversation
    sent = c.withColumn("text", F.replace(F.col("text"), F.lit("the"), F.lit("Alba Abel")))
    return vault.rehydrate_rows(sent, v)


# ---------------------------------------------------------------- models


def _stand_in():
    pattern = re.compile(TITLE)
    return lambda texts: [[(m.start(), m.end(), "PHONE", 0.75) for m in pattern.finditer(t)] for t in texts]


for _n in ("M09_tagger", "X02_span_tagger"):

    @query(_n, f"SELECT doc_id, s_start, s_end, s_text FROM {sql_spans('documents', TITLE)} AS f")
    def tagger(spark, d):
        segs = read(spark, d, "documents").select("doc_id", F.lit(0).alias("start"), "text")
        return tagging.tag(segs, _stand_in, POLICY).select("doc_id", F.col("start").cast("long").alias("s_start"), F.col("end").cast("long").alias("s_end"), F.col("text").alias("s_text"))


def _engine():
    import json

    return lambda prompts: [(json.dumps({"findings": [{"predicate": "client-named", "quote": " ".join(p.split()[:6]), "mention": ""}]}), "stop") for p in prompts]


for _n in ("M20_judge", "X03_semantic_judge", "M21_policy_in_context"):

    @query(_n)
    def judge(spark, d):
        from ..operators.judging import judge as run

        b = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("start"), "text", F.col("text").alias("prompt"))
        found, _ = run(b, _engine, POLICY)
        return found.select("doc_id", "start", "end", "entity_type")


# ---------------------------------------------------------------- streams

for _n in ("T06_tumbling_windows",):

    @query(_n, "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
    def tumbling(spark, d):
        w = windows.tumbling(read(spark, d, "events"))
        return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("T06_sliding_windows", "SELECT (epoch(date_trunc('hour', ts)) - 3600 * k)::BIGINT AS start, count(*) AS n FROM events, range(2) AS r(k) GROUP BY ALL")
def sliding(spark, d):
    return windows.sliding(read(spark, d, "events")).select(F.unix_timestamp("start").alias("start"), "n")


@query("T06_session_windows", "SELECT min(epoch_us(ts))::BIGINT AS start, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) AS x) AS y GROUP BY user_id, s")
def sessions(spark, d):
    return windows.sessions(read(spark, d, "events")).select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "user_id", "n")


STREAMED = "SELECT conv_id, count(*) AS n, md5(regexp_replace(string_agg(text, '' ORDER BY turn), '(the|and)', '<\\1>', 'g')) AS digest FROM conversations GROUP BY conv_id"


def _streamed(spark, d, parts: int):
    """Conversations as a stream of files, a chunk a turn, the last one marked; what came out, put together again."""
    from ..streaming.rehydrate import rehydrated

    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    source = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), "text", last.alias("done"), F.lit('{"the": "<the>", "and": "<and>"}').alias("vault"))
    path, out, at = (scratch.folder(spark, x) for x in ("chunks", "out", "progress"))
    source.repartitionByRange(parts, "seq").write.parquet(path)
    s = spark.readStream.schema("conv_id long, seq long, text string, done boolean, vault string").option("maxFilesPerTrigger", 1000).parquet(path)
    q = rehydrated(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("conv_id long, seq long, text string").parquet(out)


for _n in ("T01_stream_rehydrate", "R10_streaming_rehydrate"):

    @query(_n, STREAMED)
    def stream(spark, d):
        """Replies with the real values back, held against the whole conversation at once."""
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
        return _streamed(spark, d, 1).groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(whole).alias("digest"))


@query("T03_serial_per_key", "SELECT conv_id, turn AS seq FROM conversations")
def serial(spark, d):
    """Every chunk of a conversation is answered once, under its own number."""
    return _streamed(spark, d, 1).select("conv_id", "seq")


@query("T04_bounded_concurrency", """SELECT o_orderkey, o_orderkey % 4 AS lane FROM orders o LEFT JOIN (SELECT o_orderkey % 4 AS l, min(o_orderkey) AS last FROM orders WHERE o_totalprice > 300000 GROUP BY 1) AS s ON l = o_orderkey % 4 WHERE last IS NULL OR o_orderkey <= last""")
def lanes(spark, d):
    """Four lanes, each of which stops at its first dear order."""
    import pandas as pd

    from ..operators.lanes import in_lanes

    call = lambda f: pd.DataFrame({"o_orderkey": f["o_orderkey"], "lane": f["o_orderkey"] % 4})
    return in_lanes(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", F.col("o_orderkey") % 4, 4, call, lambda f: f["o_totalprice"] > 300000, "o_orderkey long, lane long")


@query("X08_surrogate_kinds", "SELECT kind, c_custkey, kind <> 'org-name' AND kind <> 'person-name' AS same_shape FROM customer, (VALUES ('person-name'), ('org-name'), ('id-number'), ('opaque')) AS v(kind)")
def surrogate_kinds(spark, d):
    """Every kind on every customer's name: generated names have a shape of their own, the others keep the value's."""
    import re

    import pandas as pd

    from ..operators.vault import KINDS, Rng, seed_of, surrogate

    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))

    def run(frames):
        for f in frames:
            yield pd.DataFrame([(k, c, shape(surrogate(n, k, Rng(seed_of(f"{k}{c}")))) == shape(n)) for c, n in zip(f["c_custkey"], f["c_name"]) for k in KINDS], columns=["kind", "c_custkey", "same_shape"])

    return read(spark, d, "customer").select("c_custkey", "c_name").mapInPandas(run, "kind string, c_custkey long, same_shape boolean")


# ---------------------------------------------------------------- pipelines


@query("Z09_bakeoff_plan", "SELECT pass, arm, count(*) AS n FROM documents, (VALUES ('a'), ('b'), ('c')) AS v(arm), range(1, 3) AS r(pass) GROUP BY ALL")
def bakeoff(spark, d):
    return generation.run_plan(spark, ["a", "b", "c"], read(spark, d, "documents").select("doc_id"), 2).groupBy(F.col("pass").cast("long").alias("pass"), "arm").agg(F.count("*").alias("n"))


for _n in ("Z10_hosted_slate", "Z11_tier_matrix"):
    query(_n, "SELECT pass, arm, count(*) AS n FROM documents, (VALUES ('a'), ('b'), ('c')) AS v(arm), range(1, 3) AS r(pass) GROUP BY ALL")(bakeoff)


for _n in ("Z06_generate_corpus", "Z12_corpus_builders"):

    @query(_n)
    def generate(spark, d):
        from ..operators.corpus import format_spec_sweep

        c = read(spark, d, "documents").where("length(text) > 0").select(F.col("doc_id").alias("item_id"), "text")
        g = generation.generate(c, ["pan", "ticket", "cloud-key", "uuid"], sweep=format_spec_sweep, examples=read(spark, d, "benchmark").select(F.col("item_id").alias("example_id"), "text"))
        return g.select("item_id", "form", "part")


@query("F29_value_minting", "SELECT 128::BIGINT AS n")
def minting(spark, d):
    return I.minted(spark, ["pan", "uuid"], 64).agg(F.count("*").alias("n"))
