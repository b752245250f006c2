"""Whole jobs where queries once did less."""

import re

from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.functions import scalars as S
from spanloom.llm import minhash
from spanloom.operators import compiling as C
from spanloom.operators import corpus as K
from spanloom.operators import tagging

SF = "/root/testdata/sf0.001"
HELD = {
    "pan-shaped": ("id abcde1234f.", "abcde1234f"),
    "tan-shaped": ("id ABCD12345E.", "ABCD12345E"),
    "twelve-digit-run": ("id 1234 5678-9012.", "1234 5678-9012"),
    "long-digit-run": ("id 123456789.", "123456789"),
    "ifsc-shaped": ("id HDFC0AB12CD.", "HDFC0AB12CD"),
    "at-handle": ("to abc@okbank now", "abc@okbank"),
    "prefixed-customer-id": ("see crn/12345.", "crn/12345"),
    "credential-prefix": ("key sk-abc-def-ghi.", "sk-abc-def-ghi"),
    "pem-encapsulation": ("é😀 -----BEGIN A KEY-----", "-----BEGIN A KEY-----"),
    "driver-url": ("at jdbc:pg://h:1/x y", "jdbc:pg://h:1/x"),
    "masked-tail": ("card XXXX-XXXX-1234.", "XXXX-XXXX-1234"),
    "high-entropy-token": ("see aabbccddeeffgghh.", "aabbccddeeffgghh"),
}


def test_format_spec_sweep(spark):
    texts = [t for t, _ in HELD.values()] + ["plain words here", "aaaaaaaabbbbbbbb", "aabbccddeeffgggg"]
    rows = K.format_spec_sweep(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, (label, (text, value)) in enumerate(HELD.items()):
        at = re.search(re.escape(value), text)
        assert (label, at.start(), at.end(), value) in {(r["label"], r["start"], r["end"], r["text"]) for r in rows if r["doc_id"] == i}
    assert not [r for r in rows if r["doc_id"] >= len(HELD)]


def test_format_spec_sweep_skips_nothing(spark):
    texts = [(i, t) for i, (t, _) in enumerate(HELD.values(), 1_000_000)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    quick, plain = K.format_spec_sweep(docs), K.format_sweep(docs, K.FORMAT_SPEC, K.ENTROPY_BITS)
    assert quick.count() == plain.count() > 0 and quick.exceptAll(plain).count() == 0


def test_generated_carriers_are_certified(spark):
    hit = K.format_spec_sweep(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).select(F.col("doc_id").alias("item_id"))
    made = catalog.queries()["Z06_generate_corpus"](spark, SF)
    assert made.count() > 0 and made.join(hit, "item_id", "left_semi").count() == 0


def plain_oracle(text):
    """The oracle as the reference words it."""
    spans = [m.span() for m in re.finditer(S.PEM_BLOCK, text)]
    for m in re.finditer("[A-Za-z0-9@._/:+=~-]{3,}", text):
        t = m.group()
        odd = (re.search("[0-9]", t) and re.search("[A-Za-z]", t)) or re.fullmatch("[0-9]{9,}", t) or re.search("[A-Za-z0-9]@[A-Za-z0-9]", t) or "://" in t or re.fullmatch("[A-Z]{4,}", t) or re.fullmatch("[A-Za-z0-9+/=]{16,}", t)
        if odd and not any(a <= m.start() and m.end() <= b for a, b in spans):
            spans.append(m.span())
    spans += [m.span() for m in re.finditer(S.TITLES, text, re.ASCII)]
    return sorted(s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans))


def test_orthographic_oracle(spark):
    texts = ["-----BEGIN KEY-----\nab12 ABCD\nAcme Corp\n-----END KEY----- x9 tail", "é😀 we met Acme Corp today", "Internationalisation Of Things", "abc-----BEGIN-----x1-----END-----", "", "a1b, ABCD; x@y 123456789 12345678 http://q"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(60).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.orthographic_oracle(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [(s["start"], s["end"]) for s in r["s"]] == plain_oracle(texts[r["i"]])
        assert all(s["text"] == texts[r["i"]][s["start"] : s["end"]] for s in r["s"])
    assert catalog.queries()["F16_orthographic_spans"](spark, SF).columns == ["doc_id", "s_start", "s_end", "s_text"]


def test_span_from_tokens(spark):
    t = "call Andre\u0301 Corp \u200b x"
    words = [(0, 4), (5, 10), (10, 11), (12, 16), (17, 18), (19, 20)]
    assert tagging.span_from_tokens(t, words, 1, 1) == (5, 11)
    assert tagging.span_from_tokens(t, words, 3, 4) == (12, 16)
    assert [tagging.span_from_tokens(t, words, *x) for x in ((4, 4), (-1, 0), (1, 0), (5, 6), (0.5, 1))] == [None] * 5
    assert tagging.span_from_tokens(t, [(5, 9), (0, 4), (10, 14)], 0, 2) is None
    assert "s_text" in catalog.queries()["M08_span_from_tokens"](spark, SF).columns


def test_quotes_count_the_same_at_every_size(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a short text with some words"), (None, "short"), (None, "short"), (2, "a short text with some words"), (2, "é short quote that is longer"), (3, None), (4, "")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "short"), (2, "text with some words"), (3, "absent"), (4, ""), (5, None), (6, "é"), (7, "short quote that"), (8, "a short text with words")], "item_id long, quote string")
    want = {1: 5, 2: 2, 3: 0, 4: 6, 5: 0, 6: 1, 7: 1, 8: 0}
    for most in (100, 3):
        monkeypatch.setattr(C, "MOST_QUOTES", most, raising=False)
        assert {r["item_id"]: r["n_docs"] for r in C.grounded_counts(quotes, docs).collect()} == want


def test_near_copies_without_an_id_or_with_one_of_two_texts(spark):
    base = [f"word{i}" for i in range(60)]
    a, b, c, d = " ".join(base), " ".join([*base, "tail"]), " ".join([*base, "end"]), " ".join(f"other{i}" for i in range(60))
    docs = spark.createDataFrame([(None, a), (None, a), (5, b), (9, c), (9, d), (None, d + " x"), (3, None)], "doc_id long, text string")
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.near_duplicates(docs, 2).collect()}
    assert found[None, 59] == 5
    assert {(r["doc_id"], r["text"]) for r in minhash.one_of_each(docs, 2).collect()} == {(5, b), (9, d), (3, None)}
