"""Operators against plain versions, on small tables."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.functions.offsets import STRETCH, find_spans, running
from spanloom.operators import candidates, corpus, detect, judging, lanes, resolve, selftest, strata, vault


def test_spans_of_very_many_matches(spark):
    """One text of more matches than a stretch holds, one of two megabytes, and one without any."""
    rng = random.Random(3)
    texts = ["".join(rng.choices(["ab", "é", " ", "x1", "漢"], k=9000)), "ab " * 700_000, "nothing", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", find_spans(F.col("text"), "[a-z]+[0-9]?").alias("s")).collect()
    for r in rows:
        want = [(m.start(), m.end(), m.group()) for m in re.finditer("[a-z]+[0-9]?", texts[r.k] or "")]
        assert [(s.start, s.end, s.text) for s in r.s] == want if texts[r.k] is not None else not r.s
    assert any(len(r.s) > 2 * STRETCH for r in rows)


@pytest.mark.parametrize("n", [0, 1, STRETCH, STRETCH + 1, 3 * STRETCH + 7])
def test_running_sums(spark, n):
    values = [random.Random(n).randrange(9) for _ in range(n)]
    got = spark.createDataFrame([(values,)], "x array<int>").select(running(F.col("x"))).first()[0]
    assert got == [sum(values[:i]) for i in range(n)]


def test_segments_tile_long_texts(spark):
    text = "".join(f"key_{i} = value\n" if i % 5 else "plain words here\n" for i in range(2000)) + "```\ncode\n```\nend"
    segs = detect.segments(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).orderBy("start").collect()
    assert "".join(s.text for s in segs) == text and [s.start for s in segs[1:]] == [s.end for s in segs[:-1]]


def test_key_value_lines(spark):
    lines = {"key = value": True, "- a.b-c : x": True, "\u00a0key\u2003=\ufeff1": True, "\x0bkey\x0c=x": True, "key = \u3000": False, "- just a list item": False, "two words = x": False, "k=": False, "": False}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r[0]: r[1] for r in df.select("line", detect.kv_line(F.col("line"))).collect()} == lines


def plain_contamination(items, examples, n=8):
    tokens = lambda t: [w for x in re.split(r"[^a-z0-9@._+/:-]+", t.lower()) if (w := re.sub(r"^[._:/-]+|[._:/-]+$", "", x))]
    grams = lambda t, k: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    out = {}
    for e, text in examples.items():
        t = tokens(text)
        if len(t) < 3:
            continue
        b = grams(t, min(n, len(t)))
        for i, other in items.items():
            a = grams(tokens(other), min(n, len(t)))
            if a & b:
                out[i, e] = (len(a & b), len(a & b) / min(len(a), len(b)))
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_contamination_of_short_examples(spark, monkeypatch, most):
    """A copied example of five tokens is found, one of two is not looked for; the same by broadcast and by shuffle."""
    monkeypatch.setattr(corpus, "MOST_GRAMS", most)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    items = {i: " ".join(rng.choices(words, k=rng.randint(0, 60))) for i in range(40)} | {100: "so alpha beta gamma delta epsilon it goes", 101: "pan number", 102: ""}
    examples = {0: "Alpha, beta gamma delta epsilon!", 1: "pan number", 2: items[3] + " and more", 3: "", 4: " ".join(items[7].split()[:4])}
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string")
    got = {(r.item_id, r.example_id): (r.shared, r.share) for r in corpus.contamination(frame(items, "item_id"), frame(examples, "example_id")).collect()}
    want = plain_contamination(items, examples)
    assert got == want and (100, 0) in got and not any(e == 1 for _, e in got)
    assert corpus.contamination(frame({1: "a b c"}, "item_id").limit(0), frame(examples, "example_id")).count() == 0
    assert corpus.contamination(frame(items, "item_id"), frame({1: "a"}, "example_id")).count() == 0


def test_longest_runs(spark):
    items = {1: "a b c d e f g h", 2: "x y z", 3: "q w a b c", 4: "d e"}
    examples = {10: "z b c d e y", 11: "a b c", 12: "c d e f"}
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string")
    got = {r.item_id: (r.run, r.pos, r.example_id) for r in corpus.longest_runs(frame(items, "item_id"), frame(examples, "example_id")).collect()}
    assert got == {1: (4, 1, 10), 3: (3, 2, 11)}


def test_candidates(spark):
    rows = [(1, s, s + 2, src) for s in range(40) for src in (1, 0)]
    df = spark.createDataFrame(rows, "item_id long, s int, e int, src int")
    assert candidates.one_a_place(df).count() == 40
    assert sorted((r.s, r.src) for r in candidates.candidate_spans(df).collect()) == [(s, 0) for s in range(24)]


def test_rewriting_many_spans(spark):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdé ", k=4000))
    cuts = sorted(rng.sample(range(4001), 400))
    spans = [(1, a, b, "redact" if i % 3 else "allow", f"<{i}>" if i % 3 else None) for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
    got = resolve.rewritten(spark.createDataFrame([(1, text), (2, "kept"), (3, None)], "doc_id long, text string"), spark.createDataFrame(spans, "doc_id long, start int, end int, action string, replacement string"))
    rows = {r.doc_id: r for r in got.collect()}
    out, at = "", 0
    for _, a, b, _, new in spans:
        if new is not None:
            out, at = out + text[at:a] + new, b
    assert rows[1].text == out + text[at:] and rows[2].text == "kept" and rows[3].text is None
    assert rows[1].n_applied + rows[1].n_skipped == 200


def test_minting_betrays_nothing():
    rng = random.Random(1)
    entries = [("T", rng.choice(vault.KINDS), f"value{rng.randrange(400)}") for _ in range(900)] + [("P", "person-name", f"Person {k}") for k in range(300)]
    got = vault.mint("c", entries)
    assert len(set(got.values())) == len(got) == len({(t, r) for t, _, r in entries})
    assert not {r.lower() for _, r in got} & {s.lower() for s in got.values()}
    assert vault.mint("c", entries[:5], known=got) == got
    with pytest.raises(vault.VaultError):
        vault.mint("c", [("T", "opaque", " ")])


def test_selftest_scores(spark):
    cases = spark.createDataFrame([(1, "A", "positive"), (2, "A", "positive"), (3, "A", "positive"), (4, "A", "negative"), (5, "A", "negative"), (1, "B", "negative")], "doc_id long, entity_type string, kind string")
    resolved = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B"), (4, "A"), (5, "B")], "doc_id long, entity_type string")
    rows = {r.entity_type: r.asDict() for r in selftest.score(cases, resolved).collect()}
    assert rows["A"] == {"entity_type": "A", "positives": 3, "negatives": 2, "caught": 1, "shadowed": 1, "false_positives": 1, "recall": round(2 / 3, 9), "label_recall": round(1 / 3, 9), "fp_rate": 0.5}
    assert rows["B"]["recall"] is None and rows["B"]["fp_rate"] == 0


def test_units_and_floors(spark):
    unit = lambda family, scopes: spark.createDataFrame([(family, scopes)], "f string, s array<string>").select(judging.judged_unit(F.col("f"), F.col("s"))).first()[0]
    assert [unit("pic", []), unit("compiled", ["segment"]), unit("compiled", ["message", "segment"]), unit("compiled", ["message"])] == ["message", "segment", "segment+message", "message"]
    with pytest.raises(Exception, match="without scopes"):
        unit("compiled", [])
    floor = dict(strata.ADAPTER_FLOOR)
    limits = [floor, {k: v + 1 for k, v in floor.items()}, {**floor, "maxBufferSize": 1}, {k: v for k, v in floor.items() if k != "maxBufferSize"}, {}]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in limits], "x map<string,long>").select(strata.meets_floor(F.col("x"))).collect()]
    assert got == [True, True, False, False, False]


def test_lanes_stop(spark):
    rows = spark.range(1000).withColumn("bad", F.col("id").isin(402, 405, 803))
    call = lambda f: pd.DataFrame({"id": f["id"]})
    got = sorted(r.id for r in lanes.in_lanes(rows, "id", F.col("id") % 4, 4, call, lambda f: f["bad"], "id long").collect())
    last = {2: 402, 1: 405, 3: 803, 0: 10**9}
    assert got == [k for k in range(1000) if k <= last[k % 4]]
    assert lanes.in_lanes(rows, "id", F.col("id") % 4, 4, call, lambda f: f["bad"], "id long").rdd.getNumPartitions() == 4


def test_contamination_of_a_long_text(spark):
    """the distinct grams of one long text are found in linear time, repeats count once."""
    import time

    from pyspark.sql import functions as F

    from spanloom.operators import corpus as K

    words = [f"w{i}" for i in range(60_000)]
    run = " ".join(words[100:120])
    items = spark.createDataFrame([(1, " ".join(words) + " " + run), (2, f"{run} x {run}"), (3, "a b")], "item_id long, text string")
    examples = spark.createDataFrame([(7, run), (8, "other words that are nowhere else in any of the items")], "example_id long, text string")
    began = time.time()
    got = sorted(tuple(r) for r in K.contamination(items, examples).collect())
    assert got == [(1, 7, 13, 1.0), (2, 7, 13, 1.0)]
    assert time.time() - began < 20


def test_corpus_is_swept_once(spark, tmp_path):
    """the sweep, the dearest pass over the texts, is not repeated by what reads its result."""
    from pyspark.sql import functions as F

    from spanloom.plans import generation

    seen = spark.sparkContext.accumulator(0)

    def sweep(docs):
        def look(frames):
            for f in frames:
                seen.add(len(f))
                yield f[["doc_id"]][f["doc_id"] < 3]

        return docs.repartition(2).mapInPandas(look, "doc_id long")

    carriers = spark.range(40).select(F.col("id").alias("item_id"), F.concat(F.lit("some plain text "), F.col("id").cast("string")).alias("text"))
    assert generation.generate(carriers, ["pan", "uuid"], sweep=sweep).count() == 37
    assert seen.value == 40
