"""Corpus analytics: format sweeps, certification, contamination, labels, splits and injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..functions.offsets import SPAN, find_spans
from . import ranking

# Gram length, share at which an item is dropped, least tokens, longest run looked for.
GRAM, DROP_ABOVE, LEAST_TOKENS, LONGEST = 8, 0.7, 3, 24

# Published layouts of identifiers and secrets, without checksums: a certification sweep is for recall.
_GAP = r"\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
FORMAT_SPEC = {
    "pan-shaped": r"\b[A-Za-z]{5}[0-9]{4}[A-Za-z]\b",
    "tan-shaped": r"\b[A-Za-z]{4}[0-9]{5}[A-Za-z]\b",
    "twelve-digit-run": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "long-digit-run": r"\b[0-9]{9,}\b",
    "ifsc-shaped": r"\b[A-Za-z]{4}0[A-Za-z0-9]{6}\b",
    "at-handle": r"\b[A-Za-z0-9][A-Za-z0-9._-]{2,}@[A-Za-z][A-Za-z0-9]{2,}\b",
    "prefixed-customer-id": r"(?i)\b(?:CIF|CRN|KYC)[ /:#-]?[0-9]{5,12}\b",
    "credential-prefix": r"\b(?:AKIA|ASIA)[0-9A-Za-z]{10,}|\bghp_[A-Za-z0-9]{20,}|\bxox[abprs]-[A-Za-z0-9-]{8,}|\bsk-[A-Za-z0-9-]{10,}",
    "pem-encapsulation": r"-----BEGIN [A-Z0-9 ]+-----",
    "driver-url": rf"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|mssql|redis|amqp|sftp|ftps?|jdbc:[a-z]+)://[^{_GAP}\"']+",
    "masked-tail": r"\bX{4,}[ -]?(?:X{4}[ -]?)*[0-9]{4}\b",
}
# What a text must hold for a pattern to match in it: looked for first, at a fraction of the cost.
NEEDED = {
    "pan-shaped": "[A-Za-z][0-9]{4}[A-Za-z]",
    "tan-shaped": "[A-Za-z][0-9]{5}[A-Za-z]",
    "twelve-digit-run": "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "long-digit-run": "[0-9]{9}",
    "ifsc-shaped": "[A-Za-z]{4}0",
    "at-handle": "@",
    "prefixed-customer-id": "[0-9]{5}",
    "credential-prefix": "AKIA|ASIA|ghp_|xox|sk-",
    "pem-encapsulation": "-----BEGIN ",
    "driver-url": "://",
    "masked-tail": "XXXX",
    "high-entropy-token": "(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{16}",
}
# Tokens of at least 16 characters with at least so many bits a character.
ENTROPY_TOKEN, ENTROPY_BITS = r"[A-Za-z0-9+/=_-]{16,}", 3.0


def format_spec_sweep(docs: DataFrame) -> DataFrame:
    """The whole sweep of published layouts, with the tokens of high entropy: columns as of ``format_sweep``."""
    return format_sweep(docs, FORMAT_SPEC, ENTROPY_BITS, NEEDED)


def format_sweep(docs: DataFrame, patterns: dict[str, str], bits: float | None = None, needed: dict[str, str] | None = None) -> DataFrame:
    """(label, doc_id, start, end, text) of all labelled patterns, in one pass over the texts; with ``bits`` also of the
    long tokens whose entropy reaches it. ``needed`` has patterns without which a label cannot occur."""

    def spans(k: str, p: str) -> Column:
        every = find_spans(F.col("text"), p)
        return F.when(F.col("text").rlike(needed[k]), every).otherwise(F.array().cast(f"array<{SPAN}>")) if needed and k in needed else every

    found = [_labelled(k, spans(k, p)) for k, p in patterns.items()]
    if bits is not None:
        found.append(_labelled("high-entropy-token", F.filter(spans("high-entropy-token", ENTROPY_TOKEN), lambda s: scalars.entropy(s["text"]) >= bits)))
    every = F.concat(*found)
    return docs.select("doc_id", F.explode(every).alias("x")).select("x.label", "doc_id", "x.start", "x.end", "x.text")


def _labelled(label: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


def widened(rules: DataFrame) -> DataFrame:
    """The rules for greatest recall: no validators, low entropy thresholds, short minimum lengths."""
    return rules.withColumn("validator", F.lit(None).cast("string")).withColumn("entropy_threshold", F.when(F.col("entropy_threshold").isNotNull(), F.least("entropy_threshold", F.lit(2.5)))).withColumn("min_length", F.when(F.col("entropy_threshold").isNotNull(), F.least(F.coalesce("min_length", F.lit(20)), F.lit(12))))


def slot_position(place: Column, n: Column) -> Column:
    return F.when(place == 1, "head").when(place == n, "tail").otherwise("middle")


def policy_label(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """Adds the default action of each label (``none`` for negatives) and whether the policy knows it."""
    j = rows.join(F.broadcast(defaults), "label", "left")
    negative = F.col("label").startswith("neg:")
    return j.withColumn("action", F.when(negative, "none").otherwise(F.col("action"))).withColumn("ir_backed", ~negative)


def certify(sweeps: DataFrame, items: DataFrame) -> DataFrame:
    """Items with sweep hits (item_id, sweep, stage): quarantined if any stage hit, provisional if only supplementary
    sweeps did, else certified clear."""
    hit = sweeps.groupBy("item_id").agg(F.bool_or(F.col("stage") == "main").alias("main"), F.bool_or(F.col("stage") != "main").alias("extra"))
    status = F.when(F.col("main"), "quarantined").when(F.col("extra"), "provisional-clear").otherwise("certified-clear")
    return items.join(hit, "item_id", "left").select("item_id", status.alias("status"))


#: Grams of examples that are sent to every task at most; more are met by a shuffle on the gram.
MOST_GRAMS = 2_000_000


def gram_at(words: Column, at: Column, n: Column | int) -> Column:
    """A run of n tokens as 96 bits of digest: its text is as long as eight words and never needed."""
    run = F.slice(words, at, F.lit(n) if isinstance(n, int) else n)
    return F.struct(F.xxhash64(run).alias("h"), F.hash(run).alias("g"))


def gram_length(words: Column, n: int = GRAM) -> Column:
    """The length at which an example is matched: ``n``, its own if it is shorter, null under LEAST_TOKENS."""
    return F.when(F.size(words) >= LEAST_TOKENS, F.least(F.lit(n), F.size(words)))


def _few(examples: DataFrame) -> DataFrame:
    """Marks the grams of the examples for broadcast if their number allows."""
    return F.broadcast(examples) if examples.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS else examples


def contamination(items: DataFrame, examples: DataFrame, n: int = GRAM) -> DataFrame:
    """(item_id, example_id, shared, share): distinct grams shared, and their share of the smaller set. An example of
    fewer than n tokens is matched at its own length, one of fewer than LEAST_TOKENS not at all.

    Items' grams meet those of the examples at once, repeats included, as an array of structs is made distinct in the
    square of its length; matches are made distinct and shuffled. Lengths other than n are looked at only where an
    example has them."""
    all_of = lambda t, k: F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: gram_at(t, i, k))
    e = examples.select("example_id", scalars.tokens(F.col("text")).alias("t")).withColumn("n", gram_length(F.col("t"), n)).where("n is not null").select("example_id", "n", all_of(F.col("t"), F.col("n")).alias("grams"))
    b = e.select("example_id", "n", F.size(F.array_distinct("grams.h")).alias("nb"), F.explode("grams").alias("x")).select("example_id", "n", "nb", "x.*").distinct()
    lengths = sorted(r[0] for r in b.select("n").distinct().collect())  # n at most
    t = F.col("t")
    cut = [F.when(F.size(t) >= k, F.struct(F.lit(k).alias("n"), all_of(t, k).alias("grams"))) for k in lengths]
    none = F.array().cast("array<struct<n:int,grams:array<struct<h:bigint,g:int>>>>")
    words = items.select("item_id", scalars.tokens(F.col("text")).alias("t"))
    a = words.select("item_id", F.explode(F.filter(F.concat(none, F.array(*cut)) if cut else none, lambda x: x.isNotNull())).alias("x"))
    a = a.select("item_id", "x.n", F.size(F.array_distinct("x.grams.h")).alias("na"), F.explode("x.grams").alias("y")).select("item_id", "n", "na", "y.*")
    gram = ["n", "h", "g"]
    own = a.join(_few(b.select(*gram).distinct()), gram, "left_semi").distinct()
    met = own.join(_few(b), gram).groupBy("item_id", "example_id").agg(F.count("*").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return met.select("item_id", "example_id", "shared", (F.col("shared") / F.least("na", "nb")).alias("share"))


def longest_runs(items: DataFrame, examples: DataFrame, most: int = LONGEST) -> DataFrame:
    """(item_id, run, pos, example_id): the longest token run, of at most ``most``, that an item shares with an example;
    the first place, then the first example, on ties. Positions of equal tokens on one diagonal are islands."""

    # seeds of three tokens keep frequent words from meeting everything
    def seeds_of(rows: DataFrame, key: str, at: str) -> DataFrame:
        t = rows.select(key, scalars.tokens(F.col("text")).alias("t")).where(F.size("t") >= LEAST_TOKENS)
        return t.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("t") - LEAST_TOKENS + 1), lambda i: gram_at(F.col("t"), i, LEAST_TOKENS))).alias(at, "gram"))

    seeds = seeds_of(items, "item_id", "pos").join(_few(seeds_of(examples, "example_id", "epos")), "gram").select("item_id", "example_id", "pos", (F.col("pos") - F.col("epos")).alias("diagonal"))
    w = Window.partitionBy("item_id", "example_id", "diagonal").orderBy("pos")
    runs = seeds.withColumn("island", F.col("pos") - F.row_number().over(w)).groupBy("item_id", "example_id", "diagonal", "island").agg(F.min("pos").alias("pos"), (F.count("*") + LEAST_TOKENS - 1).alias("run"))
    run = F.least("run", F.lit(most))
    best = runs.select("item_id", F.struct(-run, F.col("pos"), F.col("example_id")).alias("x")).groupBy("item_id").agg(F.min("x").alias("x"))
    return best.select("item_id", (-F.col("x")["col1"]).cast("long").alias("run"), F.col("x")["pos"].cast("long").alias("pos"), F.col("x")["example_id"].alias("example_id"))


def stratified_split(items: DataFrame, stratum: str, key: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``part``: the first ceil(fraction n) of each stratum, in a seeded hash order, are ``dev``."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    # digests are even, so their first digits cut a stratum into even stretches
    cut = items.withColumn("__order", order).withColumn("stretch", F.conv(F.substring("__order", 1, 2), 16, 10).cast("int"))
    r = ranking.ranked(cut, [stratum], [F.col("__order"), F.col(key)])
    return r.withColumn("part", F.when(F.col("rank") <= F.ceil(F.lit(fraction) * F.col("n")), "dev").otherwise("test")).select(*items.columns, "part")


def adjacency(rows: DataFrame, order: str, stratum: str) -> DataFrame:
    """Rate of neighbours in one stratum, and the rate that chance would give. Neighbours within a stretch of the order
    are found in it, those across its end from the first and last row of every stretch."""
    cut = ranking.cut_by(rows.select(F.col(order).alias("__at"), F.col(stratum).alias("__s")), [], "__at")
    w = Window.partitionBy("stretch").orderBy("__at")
    told = cut.withColumn("same", (F.lag("__s").over(w) == F.col("__s")).cast("long"))
    ends = told.groupBy("stretch").agg(F.sum("same").alias("same"), F.count("same").alias("pairs"), F.min_by("__s", "__at").alias("first"), F.max_by("__s", "__at").alias("last"))
    across = (F.lag("last").over(Window.orderBy("stretch")) == F.col("first")).cast("long")  # a row a stretch
    rate = ends.withColumn("across", across).agg(((F.sum(F.coalesce("same", F.lit(0))) + F.sum(F.coalesce("across", F.lit(0)))) / (F.sum("pairs") + F.count("across"))).alias("rate"))
    n = rows.groupBy(stratum).agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("x"))
    return rate.crossJoin(n).select("rate", (F.col("x") / (F.col("n") * (F.col("n") - 1))).alias("chance"))  # one row each
