"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, embedding_graph, minhash, packing, pii_crf, quality_knn, ring_sharding, sentencepieces, spotsigs, token_counts, toxicity_zstd, wordtokens

SF = os.environ.get("TEST_SF_DIR_LLM", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, shard int, component_id long, spans string, node long, fingerprint string"
WORDS = "alpha beta gamma delta river stone cloud window garden the of and to with from".split()


def odd_rows(n=0, seed=0):
    """Nulls, empty and long texts, repeated rows, ties, and columns with clashing names."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    texts = [(1, None), (2, ""), (3, "  \n"), (4, "word"), (5, text(30)), (5, None), (6, text(4000)), (7, text(40)), (7, "same"), (7, "same"), (None, text(12)), (None, None)]
    texts += [(100 + i, text(rng.randint(1, 60))) for i in range(n)]
    return [(i, t, None, None, None, 0.5, 1, 1, 1, "s", 1, "f") for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(20), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return dict((r[0], r[1] or "") for r in common.table(spark, SF, "documents").select("doc_id", "text").collect())


# ---------------------------------------------------------------- tokens, counts, packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(wordtokens.vocabulary_path())


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


TRICKY = ["", " ", "Don't STOP, it's we'll I'd they've I'm you're", "a b c\x85d\x1ce", "<|endoftext|> x <|ENDOFTEXT|> <|startoftext|>", "İstanbul ŞÇ ΣΑΣ ǅ", "é café ﬁ Å", "漢字 かな 한글 😀👍🏽 ‍", "12345 3.14 x² ½", "..,,!!??--__", "a" * 3000, "  ﻿­͸", "ſs ŉ ĳ ß ẞ", "x\ty\r\nz\x0bw\x0cq"]


def test_word_tokens_are_the_library_s(library):
    tok = wordtokens.WordTokens(wordtokens.vocabulary_path())
    rng = random.Random(7)
    pool = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x180), 0x2013, 0x2019, 0x20AC, 0x1F600, 0x4E2D, 0x301, 0x85]]
    for t in [*TRICKY, *("".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(1500))]:
        assert np.frombuffer(tok.ids(t), "<u4").tolist() == ids_of(library, t), t


@needs_tables
def test_token_counts(spark, texts, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.query(spark, SF).collect()}
    assert got == {i: (len(t.encode()), n := len(ids_of(library, t)), n > 2048) for i, t in texts.items()}


def test_counts_come_from_the_cache(spark, odd, empty, tmp_path, library):
    cache = f"file://{tmp_path}/cache"
    first = sorted(map(tuple, token_counts.count_tokens(odd, cache).collect()), key=repr)
    assert first == sorted(((i, len((t or "").encode()), len(ids_of(library, t or ""))) for i, t, *_ in odd_rows(20)), key=repr)
    stored = spark.read.parquet(cache).count()
    assert stored == len({re.sub(r"\s+", " ", t or "") for _, t, *_ in odd_rows(20)})
    assert sorted(map(tuple, token_counts.count_tokens(odd, cache).collect()), key=repr) == first
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded twice
    assert token_counts.count_tokens(empty, cache).count() == 0


def check_packing(rows, docs, library, capacity=4096):
    seqs, by_doc = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    for i, t in docs.items():
        ids, at = [*ids_of(library, t), 1], 0
        own = sorted(by_doc.pop(i), key=lambda r: r["piece"])
        for k, r in enumerate(own):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == capacity or k == len(own) - 1
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    return len(seqs)


@needs_tables
def test_packing(spark, texts, library):
    rows = packing.query(spark, SF).collect()
    n = check_packing(rows, texts, library)
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packing_cells_and_sequences(spark, library):
    docs = {i: " ".join(random.Random(i).choices(WORDS, k=i % 37 + 1)) for i in range(300)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    placed = packing.pack_documents(df, 64, cell_rows=50)
    placed = common.cut(placed)
    check_packing(placed.collect(), docs, library, 64)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(df, placed, 64).collect()}
    for r in placed.where("piece = 0").collect():
        want = [*ids_of(library, docs[r["doc_id"]]), 1][: r["length"]]
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == want


def test_genetic_steps_keep_every_item():
    rng = random.Random(1)
    lengths = [rng.randint(1, 60) for _ in range(400)]
    population = packing.evolve(lengths, [], 1, capacity=100, offspring=6)
    for bins in population:
        assert sorted(i for b in bins for i in b) == list(range(400)) and max(packing.fills(bins, lengths)) <= 100
    assert len(population[0]) <= len(packing.best_fit(sorted(range(400), key=lambda i: -lengths[i]), lengths, 100))


def test_packing_odd_tables(spark, odd, empty):
    assert packing.pack_documents(odd).agg(F.sum(F.lit(1))).first()[0] >= 32
    assert packing.pack_documents(empty).count() == 0


# ---------------------------------------------------------------- pieces


def test_pieces_are_the_library_s():
    p = sentencepieces.Pieces(sentencepieces.model_path())
    rng = random.Random(8)
    pool = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x180), 0x2581, 0x1F600, 0x4E2D, 0x301, 10, 9]]
    probe = [*TRICKY, *("".join(rng.choices(pool, k=rng.randint(0, 50))) for _ in range(400))]
    want = p.library.encode(probe)
    for t, got, ids in zip(probe, p.encode_all(probe), want):
        assert got == ids, t
        assert p.decode(ids) == p.library.decode(ids), t


@needs_tables
def test_piece_query(spark, texts):
    p = sentencepieces.Pieces(sentencepieces.model_path()).library
    rows = {r["doc_id"]: r for r in sentencepieces.query(spark, SF).collect()}
    for i, t in texts.items():
        ids = p.encode(t)
        assert (rows[i]["n_pieces"], rows[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert rows[i]["decoded_sha256"] == hashlib.sha256(p.decode(ids).encode()).hexdigest()


def test_pieces_of_long_words():
    p = sentencepieces.Pieces(sentencepieces.model_path())
    rng = random.Random(9)
    long = ["".join(rng.choices("abcdefgh", k=60_000)), "é漢x" * 5000, "7" * 30_000, "a" * 65, "b" * 64 + "\0" + "c" * 70]
    for t, got in zip(long, p.encode_all(long)):
        assert got == p.library.encode(t)
    assert p.encode_all(long)[0] == p.library.encode(long[0])  # what was forgotten is learnt again
    whole = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(300_000))
    assert p.encode_all([whole])[0] == p.library.encode(whole)


def test_pieces_forget(monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE_WORDS", 5)
    monkeypatch.setattr(sentencepieces, "BATCH_CHARS", 40)
    p = sentencepieces.Pieces(sentencepieces.model_path())
    rng = random.Random(2)
    for _ in range(60):
        probe = [" ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for _ in range(3)]
        assert p.encode_all(probe) == p.library.encode(probe)


def test_pieces_round_trip(spark, odd, empty):
    coded = sentencepieces.encode(odd)
    back = Counter((r["doc_id"], r["text"]) for r in sentencepieces.decode(coded).collect())
    assert back == Counter((i, (t or "")) for i, t, *_ in odd_rows(20))
    assert sentencepieces.encode(empty).count() == 0


# ---------------------------------------------------------------- sharding


def walk_plainly(places, shards):
    """One row at a time: nearest shards first, in rounds, in ring order."""
    points = ring_sharding.ring(shards)
    total = len(places)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = {}
    for step in range(shards):
        for k, p in sorted(places, key=lambda x: x[1]):
            if k in out:
                continue
            s = ring_sharding.clockwise(points, p, shards)[step]
            if room[s]:
                room[s] -= 1
                out[k] = s
    return out


@needs_tables
def test_sharding(spark, texts):
    rows = ring_sharding.query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_walk_is_the_plain_walk():
    rng = random.Random(5)
    bits = 12
    cells = Counter(rng.randrange(1 << bits) for _ in range(2000))
    listed = [(c, c << (63 - bits), n) for c, n in sorted(cells.items())]
    for shards in (3, 8):
        plan = ring_sharding.walk(listed, shards)
        plain = walk_plainly([((c, k), c << (63 - bits)) for c, n in cells.items() for k in range(n)], shards)
        assert Counter(s for _, s, a, b, _ in plan for _ in range(b - a)) == Counter(plain.values())
        want = Counter((c, s) for (c, _), s in plain.items())
        got = Counter()
        for c, s, a, b, _ in plan:
            got[c, s] += b - a
        assert got == want


def test_growth_moves_little(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    a = {r["doc_id"]: r["shard"] for r in ring_sharding.shard_rows(rows, "doc_id", 8).collect()}
    b = {r["doc_id"]: r["shard"] for r in ring_sharding.shard_rows(rows, "doc_id", 9).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.45 * len(a)  # hashing modulo the number of shards would move 8 of 9


def test_sharding_odd_tables(spark, odd, empty):
    df = odd.select("doc_id", F.length("text").alias("size"))
    rows = ring_sharding.shard_rows(df, "doc_id", 3).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, None if t is None else len(t)) for i, t, *_ in odd_rows(20))
    assert ring_sharding.shard_rows(df.limit(0), "doc_id", 3).count() == 0
    assert ring_sharding.query.__doc__ and ring_sharding.shard_rows(empty.select("doc_id", "text"), "doc_id").count() == 0


def test_sharding_hot_keys(spark, monkeypatch):
    """One key with many texts, one row many times, and small parts: the same counts and shards as row by row."""
    values = [(1, k) for k in range(700)] + [(2, 0)] * 900 + [(None, k % 3) for k in range(200)] + [(k, k) for k in range(10, 210)]
    df = spark.createDataFrame(values, "doc_id long, size long")

    def shards_of(frame):
        return Counter(tuple(r) for r in ring_sharding.shard_rows(frame, "doc_id", 5).select("doc_id", "shard").collect())

    wide = shards_of(df)
    monkeypatch.setattr(ring_sharding, "PART_ROWS", 40)
    monkeypatch.setattr(ring_sharding, "COPIES", 70)
    rows = ring_sharding.shard_rows(df, "doc_id", 5).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter(values)
    for s in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(400))
    assert shards_of(df) == wide and shards_of(df.repartition(7)) == wide
    whole = {(r["doc_id"], r["size"], r["shard"]) for r in rows}
    assert {(r["doc_id"], r["size"], r["shard"]) for r in ring_sharding.shard_rows(df.repartition(3), "doc_id", 5).collect()} == whole


def test_hot_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    left = [(1, k) for k in range(50)] + [(k, k) for k in range(2, 40)] + [(None, 1)]
    right = {k: k * 10 for k in range(1, 30)}
    got = common.hot_join(spark.createDataFrame(left, "k long, v long"), spark.createDataFrame(list(right.items()), "k long, w long"), "k").collect()
    assert Counter(map(tuple, got)) == Counter((k, v, right.get(k)) for k, v in left)


# ---------------------------------------------------------------- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if pii_crf.passes(k, m.group())]
    return sorted(found, key=lambda x: (x[1], pii_crf.KINDS.index(x[0])))


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    bits = ["a@b.c", "@", "x.y@", "1.2.3.4", ".", "256.1.1.1", "4111111111111111", "4111 1111 1111 1111", "+1 (743) 555-3824", "+", " ", "-", "ab", "é", "7", "\n", "%+@a-b.c.d"]
    for _ in range(4000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert pii_crf.base_spans(t) == plain_spans(t), t


@needs_tables
def test_pii_query(spark, texts):
    for r in pii_crf.query(spark, SF).collect():
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii_crf.written(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii_crf.KINDS] == [sum(x[0] == k for x in base) for k in pii_crf.KINDS]
        assert set(filter(None, pii_crf.written(base).split(","))) <= set(r["spans"].split(","))


def test_crf_holds_out():
    model = pii_crf.default_model()
    held = pii_crf.read_labelled(pii_crf.labelled_table(120, seed=77))
    paths = model.viterbi([pii_crf.shape_numbers(s) for s, _ in held])
    pairs = [(pii_crf.LABELS[a], b) for p, (_, labels) in zip(paths, held) for a, b in zip(p, labels)]
    assert np.mean([a == b for a, b in pairs]) > 0.98


def test_viterbi_is_the_best_path():
    import itertools

    model = pii_crf.default_model()
    seq = pii_crf.shape_numbers(["a4", "+@", "9v4"])
    score, _ = model.scores([seq])
    best = max(itertools.product(range(len(pii_crf.LABELS)), repeat=3), key=lambda p: model.move[-1, p[0]] + sum(score[0, t, p[t]] for t in range(3)) + sum(model.move[p[t - 1], p[t]] for t in (1, 2)))
    assert model.viterbi([seq])[0].tolist() == list(best)


def test_scores_are_sums_of_features(monkeypatch):
    model = pii_crf.default_model()
    rng = random.Random(5)
    known = [s for s, _ in pii_crf.read_labelled(pii_crf.labelled_table(40, seed=5))]
    known += [rng.choices([*known[0], *known[1], "unheard", "|", "+|", "-"], k=k) for k in (1, 2, 3, 30, 700)]
    numbers = [pii_crf.shape_numbers(s) for s in known]
    score, lengths = model.scores(numbers)
    for k, shapes in enumerate(known):
        for t, names in enumerate(pii_crf.features(shapes)):
            assert np.allclose(score[k, t], sum((model.emit[model.index[x]] for x in names if x in model.index), np.zeros(len(pii_crf.LABELS))))
    together = model.viterbi(numbers)
    monkeypatch.setattr(pii_crf, "LONG", 0)
    alone = model.viterbi(numbers)
    assert all(a.tolist() == b.tolist() for a, b in zip(together, alone))
    assert model._viterbi_long(numbers[-1], stretch=7).tolist() == together[-1].tolist()


def test_pii_in_long_texts():
    """Half a million marked tokens, one unbroken run, and a span at the far end."""
    tail = " mail a.b@example.com"
    for body in ("7 " * 400_000, "7" * 800_000, "a@" * 300_000, "x " * 400_000):
        text = body + tail
        base = pii_crf.base_spans(text)
        assert ("email", len(text) - 15, len(text)) in base
        assert pii_crf.added_spans([text], [base], pii_crf.default_model())[0] is not None


def test_redaction(spark, odd, empty):
    df = spark.createDataFrame([(1, "mail a.b@example.com or +1 (743) 555-3824 now", 44), (2, "clean words only", 16), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in pii_crf.redact(df).collect()}
    assert got[1]["text"] == "mail [EMAIL] or [PHONE] now" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean words only" and got[3]["text"] is None
    assert pii_crf.find_pii(odd).count() == 32 and pii_crf.find_pii(empty).count() == 0 and pii_crf.redact(empty).columns == empty.columns


# ---------------------------------------------------------------- classifiers


def auc(y, s):
    y, s = np.array(y), np.array(s)
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


@needs_tables
def test_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    rows = quality_knn.query(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(*zip(*held)) > 0.95


def test_votes_are_exact_neighbours():
    """Votes again, text by text: latent vectors from the terms, cosines one by one, the nearest by sorting."""
    import math

    rng = random.Random(1)
    rows = [(" ".join(rng.choices(WORDS, k=rng.randint(10, 60))), 1) for _ in range(60)] + [("!!" + "x " * rng.randint(5, 40) + str(i), 0) for i in range(60)]
    space = quality_knn.fit(rows)
    compared = 0
    for text in [t for t, _ in rows[::7]] + ["", "new words here", "A" * 9000, "one\n" * 300, None or "x"]:
        v = (quality_knn.terms([text])[0] * space.rarity).astype(float) @ space.axes
        size = math.sqrt(float(v @ v))
        cos = [sum(float(x) * float(y) for x, y in zip(v, other)) / max(size, 1e-9) for other in space.vectors]
        order = sorted(range(len(cos)), key=lambda k: -cos[k])
        n = quality_knn.NEIGHBOURS
        got = float(space.vote(["other text", text, "third"], block=2)[1])
        assert 0 <= got <= 1
        if cos[order[n - 1]] - cos[order[n]] < 1e-9:
            continue  # a tie at the last place
        compared += 1
        top, least = cos[order[0]], cos[order[n - 1]]
        weight = [math.exp(quality_knn.SHARPNESS * (cos[k] - top) / max(1 - least, 1e-6) / 2) / 0.5 for k in order[:n]]
        assert got == pytest.approx(sum(w for w, k in zip(weight, order) if space.labels[k]) / sum(weight), abs=1e-6)
    assert compared >= 15


def test_quality_of_blank_and_long_texts(spark):
    space = quality_knn.fit([("good words in a row", 1)] * 20 + [("!!!! ????", 0)] * 20)
    assert np.isfinite(quality_knn.terms(["", "\n", "7" * 3_000_000])).all() and quality_knn.terms([""]).any()
    df = spark.createDataFrame([(1, ""), (2, None), (3, "w " * 400_000), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_knn.score_documents(df, space).collect()}
    assert got[1] == got[2] == got[4] and all(0 <= x <= 1 for x in got.values())


@needs_tables
def test_toxicity(spark):
    rows = toxicity_zstd.query(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


@pytest.fixture(scope="module")
def insulting():
    """Labelled texts of a made-up language; toxic ones hold a few words of their own."""
    rng = random.Random(11)
    syllables = ["ba", "ne", "ti", "or", "sta", "lu", "mi", "en", "gra", "do"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    bad = ["krudge", "zwelp", "vexhole", "plinker", "quofj", "hyxx"]
    rows = []
    for i in range(900):
        w = [word() for _ in range(rng.randint(60, 200))]
        if i % 3 == 0:
            for _ in range(rng.randint(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((" ".join(w), int(i % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(insulting):
    return toxicity_zstd.fit(insulting[:600])


def test_toxicity_holds_out(insulting, toxic_model):
    held = [(y, toxic_model.score(t)) for t, y in insulting[600:]]
    assert auc(*zip(*held)) > 0.95
    assert np.mean([s >= 0.7 for y, s in held if y == 0]) < 0.02 and np.mean([s >= 0.7 for y, s in held if y == 1]) > 0.8


def test_toxicity_score_is_plain(spark, insulting, toxic_model):
    """Scores again, window by window, with compressors of their own."""
    import math

    import zstandard

    def cut(text):
        data, out = re.sub(r"[\t-\r]", " ", text.lower()).encode(), []
        while data:
            end = len(data)
            if end > toxicity_zstd.WINDOW:
                end = toxicity_zstd.WINDOW
                space = data.rfind(b" ", end // 2, end)
                end = space if space > 0 else end
            out.append(data[:end] + b" ")
            data = data[end:]
        return out

    def length(dictionary, window):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(toxicity_zstd.LEVEL, source_size=toxicity_zstd.WINDOW, dict_size=len(dictionary), write_content_size=0, write_dict_id=0, min_match=3, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    n = len(toxic_model.pairs)
    assert n and all(t[: toxicity_zstd.BASE_BYTES] == o[: toxicity_zstd.BASE_BYTES] and t != o for t, o in toxic_model.pairs)
    probe = [(1, insulting[600][0]), (2, insulting[601][0]), (3, ""), (4, "Krudge\tzwelp"), (5, "x" * 700), (6, None), (7, insulting[600][0])]
    got = {r["doc_id"]: r["score"] for r in toxicity_zstd.score_documents(spark.createDataFrame(probe, "doc_id long, text string"), toxic_model).collect()}
    for i, t in probe:
        total = 0.0
        for w in cut(t or ""):
            saved = sum(length(ordinary, w) - length(toxic, w) for toxic, ordinary in toxic_model.pairs)
            total += toxic_model.ratios[min(max(saved, toxicity_zstd.LEAST * n), toxicity_zstd.GREATEST * n) - toxicity_zstd.LEAST * n]
        a, b = toxic_model.curve
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(a * total + b))), abs=1e-9)
    assert got[1] == got[7] and got[3] == got[6]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="no tables here")
def test_toxicity_of_many_labels(spark):
    d = "/root/testdata/check_s"
    model = toxicity_zstd.fitted(spark, d)
    labels = common.table(spark, d, "labels").select("doc_id", "toxic").where("crc32(cast(doc_id as string)) % 3 = 1 and doc_id % 4 = 0")
    held = [(y, model.score(t or "")) for t, y in common.table(spark, d, "documents").join(labels, "doc_id").select("text", "toxic").collect()]
    assert auc(*zip(*held)) > 0.97
    assert np.mean([s >= 0.7 for y, s in held if y == 0]) < 0.02


def test_training_rows_are_bounded(spark):
    from spanloom.llm import labelled

    docs = spark.createDataFrame([(i, "t" * (i % 50 + 1)) for i in range(300)] + [(5, "again"), (6, "t" * 7), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(250)] + [(9, 0), (10, None)], "doc_id long, toxic int")
    rows = labelled.training_rows(docs, labels, "toxic", 40, F.lit(True))
    assert Counter(y for _, y in rows) == {0: 40, 1: 40}
    rows = labelled.training_rows(docs, labels, "toxic", 1000, F.lit(True), most_bytes=600)
    assert all(400 < sum(len(t) for t, y in rows if y == k) <= 600 for k in (0, 1))
    every = labelled.training_rows(docs, labels, "toxic", 1000, F.lit(True))
    assert ("again", 1) in every and len(every) == 250  # id 9 has both labels, id 5 two texts
    assert labelled.training_rows(docs.limit(0), labels, "toxic", 10, F.lit(True)) == []


def test_windows_are_the_text():
    for t in ("", "a", "word " * 100, "x" * 500, "é" * 90 + " tail\nline"):
        assert b"".join(w[:-1] for w in toxicity_zstd.windows(t)) == re.sub(r"[\t-\r]", " ", t.lower()).encode()


def test_classifiers_without_labels(spark, odd, empty):
    space, model = quality_knn.fit([]), toxicity_zstd.fit([])
    assert {r["score"] for r in quality_knn.score_documents(odd, space).collect()} == {0.5}
    assert {r["score"] for r in toxicity_zstd.score_documents(odd, model).collect()} == {0.0}
    assert quality_knn.keep_good(odd, space).count() == 32 and toxicity_zstd.keep_civil(odd, model).count() == 32
    assert quality_knn.keep_good(empty, space).count() == 0 and toxicity_zstd.keep_civil(empty, model).count() == 0


# ---------------------------------------------------------------- near-duplicates


def plain_sets(docs, width):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def plain_components(sets, percent=80):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            A, B = sets[a], sets[b]
            if 100 * min(len(A), len(B)) >= percent * max(len(A), len(B)) and (k := len(A & B)) * 100 >= percent * (len(A) + len(B) - k) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


@needs_tables
@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, texts, width):
    sets = plain_sets(texts, width)
    got = minhash.near_duplicates(common.table(spark, SF, "documents"), width).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(sets)


def family(n, edits, seed=0, words=120):
    """Near copies of one text, each with some words exchanged."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = f"e{i}x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_hot_family_in_blocks(spark, monkeypatch):
    docs = dict(enumerate(family(90, 9) + family(60, 14, 5) + ["shared " * 3 + t for t in family(20, 2, 9)]))
    want = plain_components(plain_sets(docs, 2))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2).collect()}
    assert got == want and len(set(want.values())) > 3


def test_hot_groups_in_small_blocks(spark, monkeypatch):
    """Families and postings of many blocks, with several components each, against brute force."""
    base = family(1, 0, 31)[0].split()
    drift = []
    rng = random.Random(4)
    for i in range(150):  # a chain: neighbours are alike, ends are not
        drift.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(len(base))] = f"d{i}x{rng.randrange(10**6)}"
    docs = dict(enumerate(drift + family(120, 12, 21) + [t for k in range(6) for t in family(25, 16, 21 + 100 * k)] + ["one two three"] * 40))
    want = plain_components(plain_sets(docs, 2))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for block in (8, 30):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2).collect()}
        assert got == want
    assert 3 < len(set(want.values())) < len(want)


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 5000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(12)]
    got = minhash.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12))


def test_one_of_each(spark, odd, empty):
    kept = minhash.one_of_each(odd)
    rows = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert rows[7, "same"] == 1 and rows[1, None] == 1 and rows[2, ""] == 1 and kept.columns == odd.columns
    assert minhash.one_of_each(empty).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    # in two steps, the second over the components of the first
    frame = lambda rows: common.cut(spark.createDataFrame(rows, "a long, b long"))
    first = common.cut(common.components(frame(edges[::2])))
    assert {r["node"]: r["component"] for r in common.merged(first, frame([x for x in edges[1::2] if x[0] != x[1]])).collect()} == got


# ---------------------------------------------------------------- fingerprints


def plain_hash(word):
    """The polynomial word hash, digit by digit."""
    u = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & u
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & u
        return x ^ x >> 31

    data = word.encode()
    return mixed(sum((c + 1) * pow(common.BASE, i, 1 << 64) for i, c in enumerate(data)) & u ^ len(data) << 48), mixed


def plain_signatures(text):
    """Chains of content words after anchors, word by word."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.translate(low))]
    u, mixed = (1 << 64) - 1, plain_hash("")[1]
    named = [plain_hash(w.decode("utf-8", "surrogatepass"))[0] for w in words]
    common_words = {plain_hash(w)[0] for w in spotsigs.ANTECEDENTS}

    def chain(name, after):
        sig = mixed(name + 0x51ED270B & u)
        follow = [h for h in named[after:] if h not in common_words][: spotsigs.CHAIN]
        for h in follow + [0] * (spotsigs.CHAIN - len(follow)):
            sig = mixed((sig * 0x9FB21C651E98DF25 & u) + h & u)
        return sig

    out = {chain(h, i + 1) for i, h in enumerate(named) if h in common_words or h % spotsigs.ANCHOR_ONE_IN == 0}
    if named:
        out.add(chain(0, 0))
    if len(named) < spotsigs.SHORT:
        out |= {mixed(h + 0x2545F491 & u) for h in named}
    return {x >> 32 for x in out}


def test_signatures_are_the_chains():
    rng = random.Random(6)
    probe = [" ".join(rng.choices([*WORDS, "Été", "x1", "--", "The"], k=rng.randint(0, 60))) for _ in range(150)] + ["", "...", "one", "the", "w" * 5000]
    for t, got in zip(probe, spotsigs.signature_sets(probe)):
        assert set(got.tolist()) == plain_signatures(t), t


def test_pruned_likeness_is_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(600):
        pool = rng.integers(0, 1 << 32, rng.integers(1, 900), dtype=np.uint32)
        a, b = (np.unique(rng.choice(pool, rng.integers(0, len(pool) + 1))) for _ in range(2))
        x, y = set(a.tolist()), set(b.tolist())
        like = len(x & y) / len(x | y) if x | y else 1.0
        for least in (0.05, 0.5, 0.8):
            assert spotsigs.likeness(a, b, least) == (like if like >= least else 0.0)


def test_next_texts(spark):
    docs = {i * 3: " ".join(random.Random(i).choices(WORDS, k=i % 40)) for i in range(200)}
    rows = spotsigs.against_next(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)).collect()
    order = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for i, j in zip(order, order[1:] + order[:1]):
        k = len(docs[i]) // 3
        e = docs[i][: len(docs[i]) - k] + docs[j][:k]
        a, b, c = (plain_signatures(t) for t in (docs[i], e, docs[j]))
        like = lambda x, y: v if (v := len(x & y) / len(x | y) if x | y else 1.0) >= spotsigs.LEAST else 0.0
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(docs[i])
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(a, b), like(a, c)))
        assert set(spotsigs.read(r["fingerprint"]).tolist()) == a and set(spotsigs.read(r["edited_fingerprint"]).tolist()) == b


def test_similar_pairs(spark):
    docs = dict(enumerate(family(40, 6, 3) + family(20, 20, 4) + ["the one", ""]))
    prints = spotsigs.fingerprints(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    got = {(r["a"], r["b"]) for r in spotsigs.similar_pairs(prints).collect()}
    first = {}
    for i in sorted(docs):
        first.setdefault(spotsigs.signature_sets([docs[i]])[0].tobytes(), i)
    ids = sorted(first.values())
    sets = {i: spotsigs.signature_sets([docs[i]])[0] for i in ids}
    assert got == {(a, b) for a in ids for b in ids if a < b and len(sets[a]) and len(sets[b]) and spotsigs.likeness(sets[a], sets[b]) >= 0.8} and got


def test_fingerprints_odd_tables(spark, odd, empty):
    assert spotsigs.against_next(odd).count() == 32 and spotsigs.against_next(empty).count() == 0
    assert spotsigs.fingerprints(odd).where("doc_id = 2").first()["fingerprint"] == ""


# ---------------------------------------------------------------- embeddings


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    vectors = [c + rng.normal(size=16) * s for c in centres for s in rng.choice([0.05, 0.2, 0.4], 12)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000, rows[0][1]), (1001, None), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [1.0, 2.0]), (1006, [2.0, 4.0])]
    out, recall = embedding_graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit(9)))
    got = {r["vec_id"]: r for r in out.collect()}
    v32 = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in v32.items()}
    links = {i: sum(i != j and len(a) == len(b) and a @ b >= 0.9 for j, b in unit.items()) for i, a in unit.items()}
    n = sum(links.values())
    assert n
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * n and all(got[i]["n_links"] <= links.get(i, 0) for i in got) and recall >= 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (1001, 1002, 1003, 1004)) and got[1006]["component_id"] == 1005


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, width))
    return [[float(x) for x in c + rng.normal(size=width) * s] for c in centres for s in rng.choice([0.05, 0.15, 0.3], 10)]


def test_embedding_shards_are_cut_again(spark, monkeypatch):
    vectors = clustered(900, 12, 8) + [[1.0 + 1e-3 * k] + [1.0] * 11 for k in range(120)]  # a crowded place
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name, value in (("BLOCK", 40), ("PER_CENTROID", 30), ("LARGE", 90), ("CENTROIDS", 4), ("SAMPLE", 400)):
        monkeypatch.setattr(embedding_graph, name, value)
    out, recall = embedding_graph.near_duplicates(df)
    v = np.array(vectors)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = (v @ v.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in out.collect()}
    found = np.array([got[i] for i in range(len(rows))])
    assert recall >= embedding_graph.LEAST_RECALL and (found <= true).all() and found.sum() >= 0.95 * true.sum()
    assert (found / np.maximum(true, 1))[true > 0].mean() >= 0.95


def test_embedding_recall_is_enforced(spark, monkeypatch):
    """A search that finds nothing ends in the exact comparison."""
    vectors = clustered(300, 8, 5)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    plain = embedding_graph.search
    monkeypatch.setattr(embedding_graph, "PER_CENTROID", 40)
    monkeypatch.setattr(embedding_graph, "_audit", lambda classes, found, threshold, seen=[]: seen.append(1) or (1.0 if len(seen) > 3 else 0.0))
    assert plain is embedding_graph.search
    out, _ = embedding_graph.near_duplicates(df, overlap=2)
    v = np.array(vectors)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    true = (v @ v.T >= 0.9).sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in out.collect()} == dict(enumerate(true.tolist()))


def test_embeddings_empty(spark):
    out, recall = embedding_graph.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.count() == 0 and recall == 1.0


# ---------------------------------------------------------------- the pipeline


@needs_tables
def test_pipeline_stages_are_the_operators(spark, texts, library):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "personal_data", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    good = common.cut(stage["quality"](spark, docs, SF))
    scores = {r["doc_id"]: r["predicted"] for r in quality_knn.query(spark, SF).collect()}
    assert {r[0] for r in good.select("doc_id").collect()} == {i for i, p in scores.items() if p}
    civil = common.cut(stage["toxicity"](spark, good, SF))
    toxic = {r["doc_id"]: r["predicted"] for r in toxicity_zstd.query(spark, SF).collect()}
    left = {i: t for i, t in texts.items() if scores[i] and not toxic[i]}
    assert {r[0] for r in civil.select("doc_id").collect()} == set(left)
    single = common.cut(stage["near_duplicates"](spark, civil, SF))
    comps = plain_components(plain_sets(left, 5))
    kept = {i for i, c in comps.items() if i == c}
    assert {r[0] for r in single.select("doc_id").collect()} == kept and single.columns == docs.columns
    clean = common.cut(stage["personal_data"](spark, single, SF))
    assert clean.columns == docs.columns and clean.where(F.col("text").rlike(r"@mail[0-9]\.example\.com")).count() == 0
    after = {r["doc_id"]: r["text"] or "" for r in clean.collect()}
    check_packing(stage["packing"](spark, clean, SF).collect(), after, library)


ODD_TABLE = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, h long, shard int, fingerprint string"


@needs_tables
def test_pipeline_of_odd_tables(spark):
    """Nulls, blanks, repeats, one long text and columns with clashing names pass every stage; so does an empty table."""
    import corpus_pipeline

    base = [r["text"] for r in common.table(spark, SF, "documents").where("n_chars > 400").orderBy("doc_id").limit(30).collect()]
    texts = [(k, t) for k, t in enumerate(base)] + [(100, None), (101, ""), (102, " \n"), (None, base[0]), (None, None), (3, base[3]), (3, base[4] + " and more words than before"), (103, " ".join(base) * 12), (104, "word " * 90_000)]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 0.1, 1, 2, 3, "f") for i, t in texts], ODD_TABLE)
    for rows, least in ((docs, 1), (docs.limit(0), 0)):
        at = rows
        for name, stage in corpus_pipeline.STAGES:
            before = at
            at = common.cut(stage(spark, at, SF), "odd")
            if name != "packing":
                assert at.columns == docs.columns
                assert at.select("doc_id").subtract(before.select("doc_id")).count() == 0
        assert (at.count() > 0) == bool(least)
    single = minhash.one_of_each(docs)
    left = Counter((r["doc_id"], r["text"]) for r in single.collect())
    assert max(left.values()) == 1 and all(left[k] for k in ((100, None), (101, ""), (102, " \n"), (None, None))) and not left[None, base[0]]


# ---------------------------------------------------------------- round 2 findings


def test_apart_in_bounded_memory():
    """the same texts as by sets of word triples, in a few bytes a word."""
    import tracemalloc

    def plain(texts, most=0.3):
        seen, out = set(), []
        for t in texts:
            w = t.lower().split()
            own = set(zip(w, w[1:], w[2:], strict=False)) or {tuple(w)}
            if len(own & seen) <= most * len(own):
                out.append(t)
            seen |= own
        return out

    rng = random.Random(3)
    texts = ["", "", " \n", "one", "One", "two words", "words two", "Two WORDS", "Ä Ö Ü x", "ä ö ü X"] + [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert toxicity_zstd.apart(texts) == plain(texts) and len(plain(texts)) < len(texts)
    long = [" ".join(str(rng.randrange(10**6)) for _ in range(2000)) for _ in range(100)]
    tracemalloc.start()
    assert toxicity_zstd.apart(long) == long
    assert tracemalloc.get_traced_memory()[1] < 12e6  # 200,000 triples; sets of tuples took 31 MB
    tracemalloc.stop()


def test_packing_search_is_not_switched_off(spark):
    """without an epoch all pieces had no bin, without offspring there was no search, and nothing said so."""
    pieces = spark.createDataFrame([(k, 0, 0, 100, 0) for k in range(9)], packing.PIECES)
    for kw in ({"epochs": 0}, {"islands": 0}):
        with pytest.raises(ValueError, match="at least"):
            packing.pack_pieces(pieces, 300, **kw)
    for kw in ({"offspring": 0}, {"keep": 1}):
        with pytest.raises(ValueError, match="at least"):
            packing.evolve([100] * 9, [], 1, 300, **kw)
    assert packing.pack_pieces(pieces, 300, epochs=1, islands=1).select("sequence_id").distinct().count() == 3
