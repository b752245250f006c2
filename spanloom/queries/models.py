"""Model-side text handling with recorded or deterministic stand-ins, driver-side generators, and the policy compiler."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.offsets import find_spans
from ..operators import injection as I
from ..operators import judging as J
from ..operators import prompts, tagging, vault
from ..plans import compiler
from ..sources import jsonl, scratch
from ..streaming.rehydrate import frames_of
from .base import query, read, sql_spans
from .functions import TITLE


def mapped(df, f, schema):
    """Rows through a function of whole rows, a batch at a time."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([f(r) for r in frame.itertuples(index=False)], columns=columns)

    return df.mapInPandas(run, schema)


def messages(spark, d):
    return read(spark, d, "benchmark").select("item_id", "text")


HEAD = "substring(text, 1, 30)"
ONCE = "(length(lower(text)) - length(replace(lower(text), lower(substring(text, 1, 30)), ''))) = 30"


@query("M12_fold_map", "SELECT item_id, md5(lower(text)) AS digest FROM (SELECT item_id, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM benchmark) AS b")
def fold_map(spark, d):
    m = mapped(messages(spark, d), lambda r: (r.item_id, J.fold(r.text)[0]), "item_id long, folded string")
    return m.select("item_id", F.md5("folded").alias("digest"))


for _n in ("M13_resolve_quote", "M15_locate"):

    @query(_n, f"SELECT item_id, 0::BIGINT AS s_start, 30::BIGINT AS s_end FROM benchmark WHERE {ONCE} AND substring(text, 30, 1) <> ' '")
    def resolve_quote(spark, d):
        def one(r):
            q = J.resolve_quote(r.text, r.text[:30]) if r.text[29:30] != " " else None
            return (r.item_id, -1, -1) if q is None or q[2] != 1 else (r.item_id, q[0], q[1])

        return mapped(messages(spark, d), one, "item_id long, s_start long, s_end long").where("s_start >= 0")


@query("M14_resolve_mention")
def resolve_mention(spark, d):
    def one(r):
        words = r.text.split()
        m = J.resolve_mention(r.text, words[len(words) // 2])
        return (r.item_id, *(m or (-1, -1)))

    return mapped(messages(spark, d), one, "item_id long, s_start long, s_end long")


def _logits(e) -> np.ndarray:
    """A whole vector as (words, classes, 3); what is short of a last word is filled with no chance."""
    x = np.array(e, dtype=float)
    return np.concatenate([x, np.full(-len(x) % 6, -9.0)]).reshape(-1, 2, 3)


for _n in ("M06_decode_token_logits",):

    @query(_n)
    def decode_tokens(spark, d):
        def run(frames):
            for f in frames:
                rows = [(v, *x) for v, e in zip(f["vec_id"], f["embedding"]) for x in tagging.decode_token_logits(_logits(e), 0.52, 4)]
                yield pd.DataFrame(rows, columns=["vec_id", "first_word", "last_word", "class_index", "score"])

        return read(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, first_word long, last_word long, class_index long, score double")


@query("M08_span_from_tokens")
def token_spans(spark, d):
    """Every span of at most two words of the benchmark's texts."""

    def one(r):
        words = [(w["start"], w["end"]) for w in r.words]
        found = ((a, b, tagging.span_from_tokens(r.text, words, a, b)) for a in range(len(words)) for b in range(a, min(a + 2, len(words))))
        return [(r.item_id, a, b, s[0], s[1], r.text[s[0] : s[1]]) for a, b, s in found if s]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([x for r in f.itertuples(index=False) for x in one(r)], columns=["item_id", "first_word", "last_word", "s_start", "s_end", "s_text"])

    rows = read(spark, d, "benchmark").where("text is not null").select("item_id", "text", find_spans(F.col("text"), tagging.WORD).alias("words"))
    return rows.mapInPandas(run, "item_id long, first_word long, last_word long, s_start long, s_end long, s_text string")


@query("M03_encode_words")
def encode(spark, d):
    def one(r):
        ids, mask = tagging.encode_words([[len(w)] * (1 + len(w) // 4) for w in r.text.split()], [7, 8], 1, 2, 64)
        return r.item_id, len(ids), max(mask)

    return mapped(messages(spark, d), one, "item_id long, n_ids long, n_words long")


@query("M18_prompt_build", "SELECT item_id, concat('Conditions:', chr(10), 'p1: names a client', chr(10), chr(10), 'Passage:', chr(10), text) AS prompt FROM benchmark")
def prompt(spark, d):
    return messages(spark, d).select("item_id", prompts.compiled_prompt(F.array(F.lit("p1: names a client")), F.lit(""), F.col("text")).alias("prompt"))


for _n in ("M27_judgment_request", "M31_request_body"):

    @query(_n, "SELECT item_id, text FROM benchmark")
    def request(spark, d):
        body = prompts.request_body("m", "p", "system", F.col("text"), "{}", 64)
        return messages(spark, d).select("item_id", F.get_json_object(body, "$.messages[1].content").alias("text"))


ANSWER = "CASE item_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated' WHEN 2 THEN 'malformed' ELSE 'schema' END"


def answers(r):
    whole = json.dumps({"findings": [{"predicate": "p", "quote": r.text[:20], "mention": ""}]})
    return [whole, whole[:-9], "}" + whole, '{"other": 1}'][r.item_id % 4]


for _n in ("M22_parse_constrained_json", "M23_json_prefix_classifier"):

    @query(_n, f"SELECT item_id, {ANSWER} AS outcome FROM benchmark")
    def parse(spark, d):
        return mapped(messages(spark, d), lambda r: (r.item_id, J.parse_answer(answers(r), "stop", J.FIELDS)[0]), "item_id long, outcome string")


for _n in ("M24_deadline", "T05_late_results"):

    @query(_n, "SELECT item_id, 'tier2' AS tier, 'call-budget-exhausted' AS reason FROM benchmark")
    def late(spark, d):
        """A budget of nothing: no answer is merged, and every message says why."""
        from ..sources.testdata_policy import POLICY

        b = messages(spark, d).select(F.col("item_id").alias("doc_id"), F.lit(0).alias("start"), "text", F.col("text").alias("prompt"))
        _, notices = J.judge(b, lambda: (lambda ps: [("{}", "stop")] * len(ps)), POLICY, budget_s=-1.0)
        return notices.withColumnRenamed("doc_id", "item_id")


@query("T02_sse_frames", "SELECT item_id, text FROM benchmark")
def sse(spark, d):
    def one(r):
        wire = "".join(f"data: {json.dumps({'t': r.text[i : i + 7]})}\n\n" for i in range(0, len(r.text), 7)) + "data: [DONE]\n\n"
        rest, out, done = "", [], False
        for i in range(0, len(wire), 11):
            rest, more, done = frames_of(rest, wire[i : i + 11])
            out += [json.loads(x)["t"] for x in more]
        return r.item_id, "".join(out)

    return mapped(messages(spark, d), one, "item_id long, text string")


@query("X07_floor_reader", f"SELECT doc_id, count(*) AS n FROM {sql_spans('documents', TITLE)} AS f GROUP BY doc_id")
def floor_reader(spark, d):
    from ..functions.offsets import find_spans

    return read(spark, d, "documents").select("doc_id", F.size(find_spans(F.col("text"), TITLE)).cast("long").alias("n")).where("n > 0")


# ---------------------------------------------------------------- generators on the driver


@query("R07_seeded_numbers")
def seeded(spark, d):
    rows = [(s, k, x) for s in ("a", "é", "😀") for rng in [vault.Rng(vault.seed_of(s))] for k, x in enumerate(rng.next() for _ in range(8))]
    return spark.createDataFrame(rows, "seed string, k int, x double")


for _n, _how in (("O04_seeded_shuffle", lambda v: I.seeded_shuffle(v, "s")), ("O05_constrained_shuffle", lambda v: I.constrained_shuffle(v, lambda x: x % 4, "s"))):

    def _shuffled(spark, d, how=_how):
        return spark.createDataFrame(list(enumerate(how(list(range(60))))), "place long, value long")

    query(_n)(_shuffled)


@query("Z08_predicate_queue", "SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM documents")
def predicate_queue(spark, d):
    from ..functions.scalars import row_id

    q = read(spark, d, "documents").select(row_id("a salt of thirty-two characters!", F.col("doc_id").cast("string")).alias("row_id"), "text")
    return q.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_ids"))


@query("F30_distractor_choice", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS shape, (c_custkey % 3)::BIGINT AS k FROM customer")
def distractors(spark, d):
    pool = spark.createDataFrame([("even", k) for k in range(3)] + [("odd", k) for k in range(3)], "shape string, k long")
    c = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("shape"), (F.col("c_custkey") % 3).alias("k"))
    return c.join(F.broadcast(pool), ["shape", "k"]).select("c_custkey", "shape", "k")


PATTERNS = [("ok", r"\b[0-9]{8}\b"), ("empty", "x*"), ("broken", "("), ("slow", "(a+)+b")]
for _n in ("F27_adversarial_inputs", "F28_pattern_check"):

    @query(_n, "SELECT * FROM (VALUES ('ok', 'none'), ('empty', 'matches-empty'), ('broken', 'does-not-compile'), ('slow', 'too-slow')) AS v(id, problem)")
    def patterns(spark, d):
        return spark.createDataFrame([(i, compiler.pattern_problem(p, 0.5) or "none") for i, p in PATTERNS], "id string, problem string")


# ---------------------------------------------------------------- the compiler

DOC = "§1 Account numbers of eight digits must never leave the bank. §2 A message that names a client is confidential."
SAID = {
    "entityTypes": [{"id": "ACC", "tier": 0, "severity": "high", "quote": "Account numbers of eight digits must never leave the bank."}, {"id": "GHOST", "tier": 0, "severity": "low", "quote": "nothing of the kind is written here"}],
    "rules": [{"id": "acc", "entityType": "ACC", "regex": r"\b[0-9]{8}\b", "quote": "Account numbers of eight digits must never leave the bank."}],
    "semanticPredicates": [{"id": "named", "nlPredicate": "names a client", "scope": "message", "quote": "A message that names a client is confidential."}],
    "actions": [{"entityType": "ACC", "action": "block"}],
}


def compiled():
    return compiler.compile_policy(DOC, compiler.FixtureClient({("Extraction", compiler.FixtureClient.digest(DOC)): SAID}))


for _n in ("Z01_compile_policy", "S01_policy_scan", "X05_fixture_client"):

    @query(_n, "SELECT * FROM (VALUES ('ACC', 'block'), ('pred:named', 'redact')) AS v(entity_type, action)")
    def compile_policy(spark, d):
        return spark.createDataFrame(sorted(compiled().policy.actions.items()), "entity_type string, action string")


@query("Z02_extract", "SELECT * FROM (VALUES ('GHOST', 'not-found')) AS v(id, reason)")
def extract(spark, d):
    return spark.createDataFrame(compiled().rejected, "id string, reason string")


for _n in ("S16_artifact_emit", "S21_manifest_serialiser"):

    @query(_n, "SELECT 1::BIGINT AS n, '1' AS ir_version")
    def emit(spark, d):
        path = scratch.folder(spark, "artifact")
        jsonl.write_sorted(spark.createDataFrame([(compiled().ir,)], "ir string"), path, "ir")
        return jsonl.scan(spark, path, "ir string").agg(F.count("*").alias("n"), F.max(F.get_json_object("ir", "$.irVersion")).alias("ir_version"))


@query("Z07_labelled_corpus", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'adjudicated' WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE 'generated' END AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def labelled_corpus(spark, d):
    lab = read(spark, d, "labels").select("doc_id", "toxic")
    j = read(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("toxic") == 1, "adjudicated").when(F.col("toxic").isNotNull(), "labelled").otherwise("generated").alias("label"))
