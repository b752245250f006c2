import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.functions.offsets import find_spans
from spanloom.functions.regexes import java
from spanloom.operators import detect, judging, matching, resolve, tagging, vault
from spanloom.operators import injection as I
from spanloom.sources import jsonl


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, ok", [("79927398713", True), ("79927398714", False), ("0", False), ("4539 5787 6362 1486", True), ("", False)])
def test_luhn(spark, value, ok):
    assert one(spark, S.luhn, value) is ok


@pytest.mark.parametrize("value, ok", [("2363", True), ("2364", False), ("6", False)])
def test_verhoeff(spark, value, ok):
    assert one(spark, S.verhoeff, value) is ok


@pytest.mark.parametrize("value, ok", [("ABCPD1234E", True), ("ABCXD1234E", False), ("ABCPD1234E\n", False)])
def test_pan(spark, value, ok):
    assert one(spark, S.pan_structure, value) is ok


def test_unicode_edges(spark):
    assert [s["text"] for s in one(spark, lambda c: find_spans(c, r"\b[A-Z]{4}\b"), "éABCD xABCD ABCD")] == ["ABCD", "ABCD"]
    assert java("a$[$]") == r"a\z[$]"


def test_offsets_agree_with_re(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab 1é😀\n", k=rng.randint(0, 40))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", find_spans(F.col("t"), "[a1]+").alias("s")).collect()
    for r in rows:
        assert [(s["start"], s["end"], s["text"]) for s in r["s"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("[a1]+", texts[r["i"]])]


def test_segments_tile_every_text(spark):
    rng = random.Random(2)
    shapes = ["key = value", "- a: b", "plain words", "", "```", "x=1", "  ", "a:", "note: yes", "tail```"]
    texts = ["\n".join(rng.choices(shapes, k=rng.randint(0, 9))) + rng.choice(["", "\n"]) for _ in range(150)]
    segs: dict = {}
    for r in detect.segments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        segs.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        own = sorted(segs.get(i, []), key=lambda r: r["start"])
        assert "".join(r["text"] for r in own) == t
        assert all(a["end"] == b["start"] for a, b in zip(own, own[1:]))


def test_hashes(spark):
    def half(s):
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        return h & 1

    def fold(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h % 5

    for s in ("a", "item-17", "Größe"):
        assert one(spark, S.half_hash, s) == half(s) and one(spark, lambda c: S.fold_hash(c, 5), s) == fold(s)


def test_hmac(spark):
    import hashlib
    import hmac

    salt = "s" * 40
    assert one(spark, lambda c: S.row_id(salt, c), "héllo") == hmac.new(salt.encode(), "héllo".encode(), hashlib.sha256).hexdigest()[:16]
    with pytest.raises(ValueError):
        S.row_id("short", F.lit("x"))


def test_clusters_do_not_join_touching_spans(spark):
    rows = [(1, 0, 5, "a", "T", "low", 0, "r", 0.9), (1, 5, 9, "b", "T", "low", 0, "r", 0.9), (1, 8, 12, "c", "T", "high", 0, "r", 0.9)]
    f = spark.createDataFrame(rows, "doc_id long, start int, end int, text string, entity_type string, severity string, tier int, source string, confidence double")
    got = {r["text"]: r["cluster"] for r in resolve.clusters(f).collect()}
    assert got["a"] != got["b"] and got["b"] == got["c"]


def test_matching_is_maximum():
    rng = random.Random(3)
    for _ in range(200):
        spans = lambda n: sorted((s := rng.randint(0, 20), s + rng.randint(1, 8)) for _ in range(n))
        f, g = spans(rng.randint(0, 5)), spans(rng.randint(0, 5))
        near = [[a[0] < b[1] and b[0] < a[1] for b in g] for a in f]

        def best(i, used, near=near, f=f, g=g):
            return 0 if i == len(f) else max([best(i + 1, used), *(1 + best(i + 1, used | {j}) for j in range(len(g)) if near[i][j] and j not in used)])

        got = matching.maximum_matching(f, g, "overlap")
        assert len(got) == best(0, frozenset()) and len(set(got.values())) == len(got)
        assert len(matching.greedy_matching(f, g)) <= len(got)


def test_streamed_rehydration_equals_batch():
    rng = random.Random(4)
    names = ["Alba Abel", "Alba", "X12", "X1", "Corp 2", "Corp"]
    for _ in range(800):
        back = {n: f"<{n[::-1]}>" for n in rng.sample(names, rng.randint(0, 4))}
        text = "".join(rng.choices([*names, " ", "1", "a", "X", "Al", "."], k=rng.randint(0, 14)))
        h, out, at = vault.Rehydrator(back), [], 0
        while at < len(text):
            n = rng.randint(1, 5)
            out.append(h.push(text[at : at + n]))
            at += n
        assert "".join(out) + h.finish() == vault.rehydrate(text, back)


def test_vault():
    got = vault.mint("c", [("NAME", "person-name", "John Doe"), ("NAME", "person-name", "John Doe"), ("PAN", "id-number", "ABCPD1234E")])
    assert len(got) == 2 and got["PAN", "ABCPD1234E"][3] == "P" and "Doe" not in got["NAME", "John Doe"]
    assert got == vault.mint("c", [("NAME", "person-name", "John Doe"), ("PAN", "id-number", "ABCPD1234E")])
    many = vault.mint("c", [("NAME", "person-name", f"q{i} z{i}") for i in range(400)])
    assert len(set(many.values())) == 400
    for bad in ([("N", "opaque", " ")],):
        with pytest.raises(vault.VaultError):
            vault.mint("c", bad)
    with pytest.raises(vault.VaultError):
        vault.mint("c", [("N", "opaque", "x1")], never=frozenset({"N"}))


def test_quotes():
    text = "The client “Acme – West” signed.\nThe client paid twice. The client paid late."
    assert judging.resolve_quote(text, 'client "acme - west" SIGNED')[2] == 1
    assert judging.resolve_quote(text, "The client paid") is None
    s, e, rung = judging.resolve_quote(text, "The client paid twice on Monday")
    assert rung == 2 and text[s:e] == "The client paid twice"
    assert judging.resolve_quote(text, "never said this at all") is None
    verdict, _, span = judging.locate(text, "The client paid twice", "client")
    assert verdict == "located" and text[span[0] : span[1]] == "client"
    assert judging.locate(text, "The client paid twice", "banana")[0] == "mention"


@pytest.mark.parametrize("text, kind", [('{"a": 1}', "complete"), ('{"a": [1, 2', "truncated"), ('{"a": "x', "truncated"), ('{"a": tr', "truncated"), ("", "truncated"), ('{"a" 1}', "malformed"), ("]", "malformed"), ('{"a": 1} x', "malformed")])
def test_json_heads(text, kind):
    assert judging.classify_prefix(text) == kind


def test_token_decoding():
    import numpy as np

    logits = np.full((4, 1, 3), -9.0)
    logits[1, 0] = [9, -9, 9]
    logits[2, 0] = [-9, 9, 9]
    assert [x[:3] for x in tagging.decode_token_logits(logits, 0.5, 4)] == [(1, 2, 0)]
    logits[2, 0, 2] = -9
    assert tagging.decode_token_logits(logits, 0.5, 4) == []


def test_injection_and_shuffles(spark):
    assert I.mint_value("masked-aadhaar", vault.Rng(1)).startswith("XXXX XXXX ")
    assert re.fullmatch(r"[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]", I.mint_value("pan", vault.Rng(2)))
    values = [(i, i % 3) for i in range(30)]
    got = I.constrained_shuffle(values, lambda x: x[1], "s")
    assert sorted(got) == values and all(a[1] != b[1] for a, b in zip(got, got[1:]))
    bad = spark.createDataFrame([(1, "abab", [(0, 2, "ab", "T")])], "item_id long, text string, spans array<struct<start:int,end:int,text:string,type:string>>")
    assert [r["reason"] for r in I.invariant_violations(bad).collect()] == ["occurs-otherwise"]


def test_sources(spark, tmp_path):
    assert jsonl.utf16_to_points("😀😀ab", 5) == 3
    with pytest.raises(jsonl.SourceError):
        jsonl.utf16_to_points("😀", 1)
    rows = spark.createDataFrame([("a b c",)], "t string")
    jsonl.write_once(rows, f"{tmp_path}/x")
    assert " " not in spark.read.text(f"{tmp_path}/x").first()[0]
    assert jsonl.scan(spark, f"{tmp_path}/x", "t string").first()[0] == "a b c"
    items = spark.createDataFrame([("1", "hello", [(0, 5, "hello", "T", "redact")]), ("1", "x", [(0, 9, "x", "T", "redact")])], "id string, text string, gold array<struct<start:int,end:int,text:string,entityType:string,action:string>>")
    assert {r["reason"] for r in jsonl.corpus_violations(items).collect()} == {"duplicate-id", "out-of-range"}


def test_sse_frames():
    from spanloom.streaming.rehydrate import frames_of

    rest, out, done = frames_of("", "data: a\n\ndata: b\n\nda")
    assert (rest, out, done) == ("da", ["a", "b"], False)
    assert frames_of(rest, "ta: [DONE]\n\n") == ("", [], True)
