"""Scalar functions over document tokens, keys and derived ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import strata as T
from ..functions.offsets import find_spans
from .base import query, quoted, read, sql_spans
from .inputs import KV_MESSAGES, SPAN_PAIRS, view

# ids of several shapes from customer keys, by integer arithmetic only
IDS = """SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 12345) % 100000 AS STRING), 5, '0') AS five, concat(CAST(c_custkey * 48271 + 1000000007 AS STRING), CAST(c_custkey % 10 AS STRING)) AS digits,
  concat(chr(65 + CAST(c_custkey % 26 AS INT)), chr(65 + CAST(c_custkey % 7 AS INT)), chr(65 + CAST(c_custkey % 11 AS INT)), chr(65 + CAST(c_custkey % 13 AS INT)), 'D', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), chr(65 + CAST(c_custkey % 5 AS INT))) AS holder FROM customer"""


def ids(spark, d):
    return view(spark, d, IDS, "customer")


LUHN = "(list_sum(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN (reverse({v})[i])::INT ELSE ((reverse({v})[i])::INT * 2) // 10 + ((reverse({v})[i])::INT * 2) % 10 END)) % 10 = 0 AND length({v}) >= 2)"


@query("F01_luhn", f"SELECT c_custkey, {LUHN.format(v='digits')} AS ok, {LUHN.format(v='substring(digits, 1, 1)')} AS one FROM ({IDS}) AS i")
def luhn(spark, d):
    return ids(spark, d).select("c_custkey", S.luhn(F.col("digits")).alias("ok"), S.luhn(F.substring("digits", 1, 1)).alias("one"))


_D = "[" + ", ".join(str(r) for r in S.D5) + "]"
_P = "[" + ", ".join(str(r) for r in S.TURN) + "]"


@query("F02_verhoeff", f"SELECT c_custkey, list_reduce(list_concat([0], list_transform(range(1, length(digits) + 1), lambda i: {_P}[((i - 1) % 8) + 1][(reverse(digits)[i])::INT + 1])), lambda a, b: {_D}[a + 1][b + 1]) = 0 AS ok FROM ({IDS}) AS i")
def verhoeff(spark, d):
    return ids(spark, d).select("c_custkey", S.verhoeff(F.col("digits")).alias("ok"))


@query("F03_pan_structure", f"SELECT c_custkey, regexp_matches(holder, '^[A-Z]{{3}}[ABCFGHJLPT][A-Z][0-9]{{4}}[A-Z]$') AS ok FROM ({IDS}) AS i")
def pan(spark, d):
    return ids(spark, d).select("c_custkey", S.pan_structure(F.col("holder")).alias("ok"))


JWT = "SELECT c_custkey, concat(CASE WHEN c_custkey % 3 = 0 THEN 'eyJhbGciOiJIUzI1NiJ9' WHEN c_custkey % 3 = 1 THEN 'eyJ0eXAiOiJKV1QifQ' ELSE 'plain' END, '.', c_name_part, '.', CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '!!' ELSE 'sig' END) AS token FROM (SELECT c_custkey, md5(c_name) AS c_name_part FROM customer)"


@query("F04_jwt_shape", f"SELECT c_custkey, c_custkey % 3 = 0 AND c_custkey % 5 <> 1 AS ok FROM ({JWT}) AS j")
def jwt(spark, d):
    return view(spark, d, JWT, "customer").select("c_custkey", S.jwt_shape(F.col("token")).alias("ok"))


@query("X01_validator_registry", f"SELECT 'luhn' AS name, count(*) FILTER (WHERE {LUHN.format(v='digits')}) AS n FROM ({IDS}) AS i UNION ALL SELECT 'pan-structure', count(*) FILTER (WHERE regexp_matches(holder, '^[A-Z]{{3}}[ABCFGHJLPT][A-Z][0-9]{{4}}[A-Z]$')) FROM ({IDS}) AS i")
def registry(spark, d):
    i = ids(spark, d)
    one = lambda name, c: i.agg(F.count_if(S.validator(name)(F.col(c))).alias("n")).select(F.lit(name).alias("name"), "n")
    return one("luhn", "digits").unionByName(one("pan-structure", "holder"))


@query("F07_occurrences", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents")
def occurrences(spark, d):
    return read(spark, d, "documents").select("doc_id", S.occurrences(F.col("text"), F.lit("the")).alias("n"))


@query("F08_whitespace", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def whitespace(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(S.collapsed(F.col("text"))).alias("digest"))


TOK = "list_filter(list_transform(string_split_regex(lower({t}), '[^a-z0-9@._+/:-]+'), lambda w: regexp_replace(w, '^[._:/-]+|[._:/-]+$', '', 'g')), lambda w: w <> '')"


@query("F09_contamination_tokens", f"SELECT doc_id, len({TOK.format(t='text')})::BIGINT AS n, md5(array_to_string({TOK.format(t='text')}, ' ')) AS digest FROM documents")
def tokens(spark, d):
    t = read(spark, d, "documents").select("doc_id", S.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("F10_id_hygiene", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_intersect(string_split(p_name, ' '), string_split(lower(p_type), ' ')), lambda w: length(w) >= 4))), ',') AS shared FROM part")
def hygiene(spark, d):
    words = lambda c: F.split(c, " ")
    shared = F.filter(F.array_intersect(words(F.col("p_name")), words(F.lower("p_type"))), lambda w: F.length(w) >= 4)
    return read(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(F.array_distinct(shared)), ",").alias("shared"))


GRAMS = "list_distinct(list_transform(range(1, len(t) - 7 + 1), lambda i: array_to_string(t[i:i+7], ' ')))"
for _n in ("F11_ngrams", "U06_ngram_sets"):

    @query(_n, f"SELECT item_id, len({GRAMS})::BIGINT AS n, md5(array_to_string(list_sort({GRAMS}), '|')) AS digest FROM (SELECT item_id, {TOK.format(t='text')} AS t FROM benchmark) AS b")
    def ngrams(spark, d):
        g = read(spark, d, "benchmark").select("item_id", S.ngrams(S.tokens(F.col("text")), 8).alias("g"))
        return g.select("item_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join(F.sort_array("g"), "|")).alias("digest"))


@query("F12_containment", f"WITH g AS (SELECT item_id, list_distinct({TOK.format(t='text')}) AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / len(a.t)::DOUBLE, 9) AS one_way, round(greatest(len(list_intersect(a.t, b.t)) / len(a.t)::DOUBLE, len(list_intersect(a.t, b.t)) / len(b.t)::DOUBLE), 9) AS both_ways FROM g a, g b WHERE b.item_id = a.item_id + 1")
def containment(spark, d):
    g = read(spark, d, "benchmark").select("item_id", F.array_distinct(S.tokens(F.col("text"))).alias("t"))
    b = g.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("t").alias("u"))
    return g.join(b, "item_id").select(F.col("item_id").alias("a"), "b", F.round(S.containment(F.col("t"), F.col("u")), 9).alias("one_way"), F.round(S.overlap_both_ways(F.col("t"), F.col("u")), 9).alias("both_ways"))


TITLE = "[A-Z][a-z]+(?: [A-Z][a-z]+)+"
for _n, _w, _f in (("F13_term_boundary", 70, "boundary"), ("F14_term_window", 40, "window")):
    _sql = (
        f"SELECT doc_id, s_start, regexp_matches(lower(substring(message, greatest(s_start - 70, 0) + 1, least(s_start, 70))), '(^|[^a-z0-9])the([^a-z0-9]|$)') OR regexp_matches(lower(substring(message, s_end + 1, 70)), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS near"
        if _f == "boundary"
        else "SELECT doc_id, s_start, contains(lower(substring(message, greatest(s_start - 40, 0) + 1, s_end + 40 - greatest(s_start - 40, 0))), 'the') AS near"
    )

    def _term(spark, d, kind=_f):
        s = read(spark, d, "documents").select("doc_id", "text", F.explode(find_spans(F.col("text"), TITLE)).alias("s"))
        near = S.term_near(F.col("text"), F.col("s.start"), F.col("s.end"), "the") if kind == "boundary" else S.words_near(F.col("text"), F.col("s.start"), F.col("s.end"), ["the"])
        return s.select("doc_id", F.col("s.start").cast("long").alias("s_start"), near.alias("near"))

    query(_n, f"{_sql} FROM {sql_spans('documents', TITLE)} AS f")(_term)


ODD = "(regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]')) OR length(regexp_replace(w, '[^0-9]', '', 'g')) >= 9 OR regexp_matches(w, '[^@\\s]@[^@\\s]') OR contains(w, '://') OR regexp_matches(w, '\\b[A-Z]{4,}\\b') OR regexp_matches(w, '[A-Za-z0-9+/=_-]{16,}')"
for _n in ("F15_odd_tokens", "F16_orthographic_oracle"):

    @query(_n, f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) AS x WHERE {ODD} GROUP BY doc_id")
    def odd(spark, d):
        w = read(spark, d, "documents").select("doc_id", F.explode(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
        return w.where(S.odd_token(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n"))


# The SQL twin of F16 counts odd words; the spans of the oracle have none.
@query("F16_orthographic_spans")
def oracle_spans(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.explode(S.orthographic_oracle(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.start").cast("long").alias("s_start"), F.col("s.end").cast("long").alias("s_end"), F.col("s.text").alias("s_text"))


@query("F17_title_multiword", f"SELECT doc_id, s_start, s_end, s_text FROM {sql_spans('documents', chr(92) + 'b' + TITLE + chr(92) + 'b')} AS f")
def title(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.explode(find_spans(F.col("text"), rf"\b{TITLE}\b")).alias("s"))
    return s.select("doc_id", F.col("s.start").cast("long").alias("s_start"), F.col("s.end").cast("long").alias("s_end"), F.col("s.text").alias("s_text"))


@query("F18_floor_readers", f"SELECT 'runs' AS reader, count(*) AS n FROM {sql_spans('documents', TITLE)} AS f UNION ALL SELECT 'first', count(DISTINCT doc_id) FROM {sql_spans('documents', TITLE)} AS f UNION ALL SELECT 'message', count(*) FROM documents WHERE length(text) > 0")
def floors(spark, d):
    doc = read(spark, d, "documents")
    s = doc.select("doc_id", F.explode(find_spans(F.col("text"), TITLE)).alias("s"))
    row = lambda df, name, n: df.agg(n.alias("n")).select(F.lit(name).alias("reader"), "n")
    return row(s, "runs", F.count("*")).unionByName(row(s, "first", F.countDistinct("doc_id"))).unionByName(row(doc.where(F.length("text") > 0), "message", F.count("*")))


@query("W09_first_hit", f"SELECT doc_id, min(s_start)::BIGINT AS s_start, first(s_text ORDER BY s_start) AS s_text FROM {sql_spans('documents', TITLE)} AS f GROUP BY doc_id")
def first_hit(spark, d):
    s = read(spark, d, "documents").select("doc_id", F.try_element_at(find_spans(F.col("text"), TITLE), F.lit(1)).alias("s"))
    return s.where("s is not null").select("doc_id", F.col("s.start").cast("long").alias("s_start"), F.col("s.text").alias("s_text"))


SWEEP = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "digits": r"\b[0-9]{12,19}\b", "hex": r"\b[0-9a-f]{32,64}\b", "cloud-key": r"\bAKIA[A-Z0-9]{16}\b", "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "url": r"https?://[^\s]+", "assignment": r"(?:password|api_key|token) ?= ?[^\s]+"}
SWEEP_SQL = " UNION ALL ".join(f"SELECT {quoted(k)} AS label, doc_id, s_start, s_end FROM {sql_spans('documents', p)} AS f" for k, p in SWEEP.items())
for _n in ("F19_format_sweep", "X06_sweep_function"):

    @query(_n, f"SELECT label, doc_id, s_start, s_end FROM ({SWEEP_SQL}) AS s")
    def format_sweep(spark, d):
        from ..operators.corpus import format_sweep

        return format_sweep(read(spark, d, "documents").select("doc_id", "text"), SWEEP).select("label", "doc_id", F.col("start").cast("long").alias("s_start"), F.col("end").cast("long").alias("s_end"))


# The SQL twins above hold eight patterns only; the sweep of the survey, with its entropy rule, has none.
for _n in ("F19_format_spec_sweep", "X06_format_spec_sweep"):

    @query(_n)
    def format_spec_sweep(spark, d):
        from ..operators.corpus import format_spec_sweep

        return format_spec_sweep(read(spark, d, "documents").select("doc_id", "text")).select("label", "doc_id", F.col("start").cast("long").alias("s_start"), F.col("end").cast("long").alias("s_end"))


@query("F20_widened_policy", "SELECT 'r-card' AS rule_id, CAST(NULL AS STRING) AS validator, CAST(NULL AS DOUBLE) AS entropy_threshold, CAST(NULL AS INT) AS min_length UNION ALL SELECT 'r-entropy', NULL, 2.5, 12")
def widened(spark, d):
    from ..operators.corpus import widened
    from ..sources.testdata_policy import POLICY

    return widened(POLICY.dims(spark)["rules"]).where("rule_id in ('r-card', 'r-entropy')").select("rule_id", "validator", "entropy_threshold", "min_length")


@query("F22_sigmoid", "SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 9) AS s FROM embeddings")
def sigmoid(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(S.sigmoid(F.col("embedding")[0].cast("double")), 9).alias("s"))


CHARS = "list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)"


@query("F23_half_hash", f"SELECT c_custkey, (list_reduce(list_concat([5381::BIGINT], {CHARS}), lambda h, c: (h * 33 + c) & 4294967295) & 1)::INT AS half FROM (SELECT c_custkey, c_name AS k FROM customer) AS x")
def half(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.half_hash(F.col("c_name")).alias("half"))


@query("F24_fold_hash", f"SELECT c_custkey, (list_reduce(list_concat([2166136261::BIGINT], {CHARS}), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 5)::INT AS fold FROM (SELECT c_custkey, c_name AS k FROM customer) AS x")
def fold(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.fold_hash(F.col("c_name"), 5).alias("fold"))


_SALT = "a salt of thirty-two characters!"
_PAD = lambda x: "".join(f"\\x{b ^ x:02X}" for b in _SALT.encode().ljust(64, b"\0"))


@query("F25_hmac_row_id", f"SELECT c_custkey, substring(sha256('{_PAD(0x5C)}'::BLOB || unhex(sha256('{_PAD(0x36)}'::BLOB || encode(c_name)))), 1, 16) AS row_id FROM customer")
def row_ids(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.row_id(_SALT, F.col("c_name")).alias("row_id"))


@query("F26_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("F31_run_ids", "SELECT n_nationkey, concat('run-', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS run_id FROM nation")
def run_ids(spark, d):
    return read(spark, d, "nation").select("n_nationkey", F.concat(F.lit("run-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("run_id"))


@query("F32_slot_position", f"SELECT item_id, line, CASE WHEN r = 1 THEN 'head' WHEN r = n THEN 'tail' ELSE 'middle' END AS slot FROM (SELECT item_id, line, row_number() OVER (PARTITION BY item_id ORDER BY line, f_start, f_end, f_type) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM ({SPAN_PAIRS}) AS s) AS x")
def slots(spark, d):
    from pyspark.sql.window import Window

    from ..operators.corpus import slot_position

    w = Window.partitionBy("item_id")
    s = view(spark, d, SPAN_PAIRS, "lineitem")
    return s.withColumn("r", F.row_number().over(w.orderBy("line", "f_start", "f_end", "f_type"))).withColumn("n", F.count("*").over(w)).select("item_id", "line", slot_position(F.col("r"), F.col("n")).alias("slot"))


for _n in ("F33_policy_label", "P30_ir_backed_label"):

    @query(_n, f"SELECT label, CASE WHEN label LIKE 'neg:%' THEN 'none' ELSE 'redact' END AS action, NOT label LIKE 'neg:%' AS ir_backed, count(*) AS n FROM (SELECT CASE WHEN f_type = 'N' THEN 'neg:N' ELSE f_type END AS label FROM ({SPAN_PAIRS}) AS s) AS x GROUP BY ALL")
    def labels(spark, d):
        from ..operators.corpus import policy_label

        s = view(spark, d, SPAN_PAIRS, "lineitem").select(F.when(F.col("f_type") == "N", "neg:N").otherwise(F.col("f_type")).alias("label"))
        defaults = spark.createDataFrame([("R", "redact"), ("A", "redact")], "label string, action string")
        return policy_label(s, defaults).groupBy("label", "action", "ir_backed").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- generated items, made from customers and their orders

ROLE = "CASE o_orderkey % 11 WHEN 0 THEN 'client' WHEN 1 THEN 'prospect' WHEN 2 THEN 'counterparty' WHEN 3 THEN 'nda-party' WHEN 4 THEN 'none' WHEN 5 THEN NULL WHEN 6 THEN 'landlord' WHEN 7 THEN 'competitor' WHEN 8 THEN 'listed-company' ELSE 'vendor' END"
# a few injections an item, so that many items have none on the client's side
ROLES_SQL = f"(SELECT o_custkey, list({ROLE} ORDER BY o_orderkey) AS roles FROM orders WHERE o_orderdate < DATE '1993-06-01' GROUP BY o_custkey)"
SIDE = "('client', 'prospect', 'counterparty', 'nda-party')"
ITEMS_SQL = f"""(SELECT concat(CASE WHEN c_custkey % 7 = 0 THEN 'neg-' ELSE 'item-' END, c_custkey, '-w', c_nationkey % 3) AS item_id, concat('c', c_nationkey) AS carrier, CASE WHEN c_nationkey > 12 THEN lower(c_mktsegment) END AS said, CASE WHEN c_acctbal < 3000 THEN 'sparse' ELSE 'dense' END AS density, lower(c_mktsegment) AS register,
  list_sort(list_filter(coalesce(roles, []), lambda r: r IS NOT NULL AND r <> 'none')) AS made_from FROM customer LEFT JOIN {ROLES_SQL} AS r ON o_custkey = c_custkey)"""
MADE = f"len(list_filter(made_from, lambda r: r IN {SIDE})) > 0"


def generated_items(spark, d):
    """(item_id, meta, roles)."""
    roles = read(spark, d, "orders").where("o_orderdate < date '1993-06-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.expr(ROLE).alias("role")))), lambda x: x["role"]).alias("roles"))
    c = read(spark, d, "customer").join(roles, "c_custkey", "left")
    meta = F.map_from_arrays(F.array(*[F.lit(k) for k in ("carrierId", "carrierStratum", "density", "carrierRegister")]), F.array(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")), F.when(F.col("c_nationkey") > 12, F.lower("c_mktsegment")), F.when(F.col("c_acctbal") < 3000, "sparse").otherwise("dense"), F.lower("c_mktsegment")))
    item_id = F.concat(F.when(F.col("c_custkey") % 7 == 0, "neg-").otherwise("item-"), F.col("c_custkey").cast("string"), F.lit("-w"), (F.col("c_nationkey") % 3).cast("string"))
    return c.select(item_id.alias("item_id"), meta.alias("meta"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


@query("F34_strata", f"SELECT item_id, carrier, coalesce(said, 'ordinary') AS carrier_stratum, CASE WHEN item_id LIKE 'neg-%' THEN 'pristine' ELSE string_split(item_id, '-')[-1] END AS wave, density, register, CAST({MADE} AS STRING) AS constructed_prediction FROM {ITEMS_SQL} AS i")
def strata(spark, d):
    return generated_items(spark, d).select("item_id", *T.strata(F.col("item_id"), F.col("meta"), F.col("roles")))


@query("F37_role_class", f"SELECT role, CASE WHEN role IN {SIDE} THEN 'client-side' ELSE 'non-client' END AS role_class, count(*) AS n FROM (SELECT {ROLE} AS role FROM orders) AS o WHERE role IS NOT NULL GROUP BY ALL")
def role_classes(spark, d):
    roles = read(spark, d, "orders").select(F.expr(ROLE).alias("role")).where("role is not null")
    return roles.groupBy("role", T.role_class(F.col("role")).alias("role_class")).agg(F.count("*").alias("n"))


@query("A64_construction_flag", f"SELECT item_id, {MADE} AS constructed, array_to_string(made_from, ',') AS constructed_from FROM {ITEMS_SQL} AS i")
def construction(spark, d):
    return generated_items(spark, d).select("item_id", T.constructed(F.col("roles")).alias("constructed"), F.array_join(T.constructed_from(F.col("roles")), ",").alias("constructed_from"))


# adapters made from suppliers: some report a limit too low, some do not report it
LIMITS = {"maxComputeWorkgroupStorageSize": "16384 * (1 + s_suppkey % 4)", "maxStorageBuffersPerShaderStage": "8 + s_suppkey % 5", "maxBufferSize": "CASE WHEN s_nationkey <> 4 THEN 268435456 * (1 + s_suppkey % 2) END", "maxStorageBufferBindingSize": "67108864 * (1 + s_suppkey % 3)"}
FLOORS_SQL = " AND ".join(f"coalesce(CAST({LIMITS[k]} AS BIGINT) >= {v}, FALSE)" for k, v in T.ADAPTER_FLOOR.items())


@query("P26_adapter_floor", f"SELECT s_suppkey, {FLOORS_SQL} AS ok FROM supplier")
def adapter_floor(spark, d):
    limits = F.map_filter(F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.expr(v).cast("long"))]), lambda k, v: v.isNotNull())
    return read(spark, d, "supplier").select("s_suppkey", T.meets_floor(limits).alias("ok"))


@query("M02_word_split", "SELECT item_id, length(text) AS n_chars, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[-_][\\p{L}\\p{N}_]+)*|[^\\s]'))::BIGINT AS n_words FROM benchmark")
def word_split(spark, d):
    from ..operators.tagging import WORD

    return read(spark, d, "benchmark").select("item_id", F.length("text").cast("long").alias("n_chars"), F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("n_words"))


@query("R06_leak_test", "SELECT c_custkey, lower(c_name) = lower(c_mktsegment) OR len(list_filter(list_intersect(string_split_regex(lower(c_name), '[^a-z0-9]+'), string_split_regex(lower(concat('customer ', c_custkey)), '[^a-z0-9]+')), lambda w: length(w) > 1)) > 0 AS leaks FROM customer")
def leak_test(spark, d):
    from ..operators.vault import leaks

    return read(spark, d, "customer").select("c_custkey", (F.lower("c_name") == F.lower("c_mktsegment")) | leaks(F.col("c_name"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")))).toDF("c_custkey", "leaks")


@query("R11_aes_envelope", "SELECT c_custkey, c_name AS opened, 12 + strlen(c_name) + 16 AS n_bytes FROM customer")
def aes(spark, d):
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    sealed = F.base64(F.aes_encrypt("c_name", key, F.lit("GCM")))
    c = read(spark, d, "customer").select("c_custkey", sealed.alias("sealed"))
    return c.select("c_custkey", F.aes_decrypt(F.unbase64("sealed"), key, F.lit("GCM")).cast("string").alias("opened"), F.octet_length(F.unbase64("sealed")).cast("long").alias("n_bytes"))


@query("M34_probe_filler", "SELECT n_nationkey, array_to_string(list_transform(range(0, n_nationkey), lambda i: concat('token', i % 97)), ' ') AS filler FROM nation WHERE n_nationkey > 0")
def filler(spark, d):
    from ..operators.prompts import filler

    return read(spark, d, "nation").where("n_nationkey > 0").select("n_nationkey", filler(F.col("n_nationkey")).alias("filler"))


@query("M29_stub_answers", "SELECT doc_id, substring(sha256(concat(CAST(doc_id AS STRING), ':q0')), 1, 8) AS answer FROM documents")
def stub(spark, d):
    from ..operators.prompts import stub_digest

    return read(spark, d, "documents").select("doc_id", F.substring(stub_digest(F.col("doc_id").cast("string"), F.lit("q0")), 1, 8).alias("answer"))


@query("M19_prompt_fit", "SELECT doc_id, ceil(length(text) / 2.0)::BIGINT AS est, ceil(length(text) / 2.0) <= 4096 - 512 AS fits FROM documents")
def fit(spark, d):
    from ..operators.prompts import estimated_tokens, fits

    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", estimated_tokens(t).alias("est"), fits(t, 4096, 512).alias("fits"))


@query("M01_label_build", "SELECT entity_type, row_number() OVER (ORDER BY o) - 1 AS class_index FROM (VALUES ('PHONE', 0), ('EMAIL', 1), ('CARD', 2), ('IP', 3), ('TOKEN', 4), ('LICENCE', 5), ('SECRET', 6)) AS v(entity_type, o)")
def label_build(spark, d):
    from ..operators.tagging import labels
    from ..sources.testdata_policy import POLICY

    return spark.createDataFrame([(e.id, i) for i, e in enumerate(labels(POLICY, tier=0))], "entity_type string, class_index long")


@query("M04_enumerate_spans", "SELECT n_nationkey, a AS first_word, a + w AS last_word FROM nation, range(0, 10) AS r(a), range(0, 3) AS s(w) WHERE a + w < 10")
def enumerate_spans(spark, d):
    from ..operators.tagging import span_grid

    return span_grid(read(spark, d, "nation").select("n_nationkey", F.lit(10).alias("n_words")), 3).select("n_nationkey", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))


@query("M05_decode_span_logits", "SELECT vec_id, ((i - 1) // 8)::BIGINT AS word, (((i - 1) // 2) % 4)::BIGINT AS width, ((i - 1) % 2)::BIGINT AS class_index, round(1 / (1 + exp(-CAST(embedding[i] AS DOUBLE))), 9) AS score FROM embeddings, range(1, 65) AS r(i) WHERE 1 / (1 + exp(-CAST(embedding[i] AS DOUBLE))) >= 0.6")
def decode_spans(spark, d):
    from ..operators.tagging import decode_span_logits

    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    return decode_span_logits(e, "vec_id", n_words=8, max_width=4, n_classes=2, threshold=0.6).withColumn("score", F.round("score", 9)).drop("logit")


for _n in ("O02_decode_sort",):

    @query(_n, "SELECT vec_id, word, width, class_index, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, word, width, class_index) AS place FROM (SELECT vec_id, ((i - 1) // 8)::BIGINT AS word, (((i - 1) // 2) % 4)::BIGINT AS width, ((i - 1) % 2)::BIGINT AS class_index, CAST(embedding[i] AS DOUBLE) AS score FROM embeddings, range(1, 65) AS r(i) WHERE CAST(embedding[i] AS DOUBLE) >= 0.5) AS x")
    def decode_sort(spark, d):
        from pyspark.sql.window import Window

        from ..operators.tagging import decode_span_logits

        e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
        s = decode_span_logits(e, "vec_id", n_words=8, max_width=4, n_classes=2, threshold=None, least_logit=0.5)
        return s.select("vec_id", "word", "width", "class_index", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("logit"), "word", "width", "class_index")).cast("long").alias("place"))


@query("M07_logit_shape", "SELECT count(*) FILTER (WHERE len(embedding) = 8 * 4 * 2) AS ok, count(*) FILTER (WHERE len(embedding) <> 64) AS bad FROM embeddings")
def logit_shape(spark, d):
    ok = F.size("embedding") == 8 * 4 * 2
    return read(spark, d, "embeddings").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"))
