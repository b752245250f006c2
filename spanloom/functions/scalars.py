"""Checksums, entropy, hashes, n-grams and other text measures as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .offsets import SPAN, find_spans
from .regexes import java


def _d5() -> tuple[list[list[int]], list[list[int]]]:
    """Multiplication of the dihedral group of the pentagon, and powers of the digit permutation."""
    times = lambda a, b: ((a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5) if a < 5 else (5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5)
    first = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed values: the base permutation
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([first[x] for x in rows[-1]])
    return [[times(a, b) for b in range(10)] for a in range(10)], rows


D5, TURN = _d5()


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, "[ -]", "")


def luhn(value: Column) -> Column:
    """Modulus-10 check over the digits; spaces and dashes are ignored; two digits at least."""
    v = stripped(value)
    return F.when(v.rlike(r"\A[0-9]{2,}\z"), F.call_function("luhn_check", v)).otherwise(F.lit(False))


def verhoeff(value: Column) -> Column:
    v = stripped(value)
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in D5])
    turns = F.array(*[F.array(*[F.lit(x) for x in row]) for row in TURN])
    digits = F.transform(F.filter(F.split(F.reverse(v), ""), lambda c: c != ""), lambda c, i: F.element_at(F.element_at(turns, (i % 8) + 1), c.cast("int") + 1))
    total = F.aggregate(digits, F.lit(0), lambda a, d: F.element_at(F.element_at(table, a + 1), d + 1))
    return F.when(v.rlike(r"\A[0-9]{2,}\z"), total == 0).otherwise(F.lit(False))


def pan_structure(value: Column) -> Column:
    """Five capitals (the fourth a holder type), four digits, a capital."""
    return value.rlike(r"\A[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]\z")


def jwt_shape(value: Column) -> Column:
    """Three dotted parts in the URL alphabet, the first a JSON object with a text ``alg``."""
    parts = F.split(value, r"\.", -1)
    shape = value.rlike(r"\A[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\z")
    plain = F.translate(parts[0], "-_", "+/")
    padded = F.rpad(plain, F.length(plain) + (F.lit(4) - F.length(plain) % 4) % 4, "=")
    header = F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8") if hasattr(F, "try_to_binary") else F.decode(F.unbase64(padded), "utf-8")
    kind = F.get_json_object(header, "$.alg")
    return F.coalesce(shape & kind.isNotNull() & header.rlike(r'"alg"\s*:\s*"'), F.lit(False))


VALIDATORS = {"luhn": luhn, "verhoeff": verhoeff, "pan-structure": pan_structure, "jwt-shape": jwt_shape}


def validator(name: str):
    if name not in VALIDATORS:
        raise ValueError(f"unknown validator {name!r}")
    return VALIDATORS[name]


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character, over code points; 0 for the empty text."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.length(value).cast("double")
    count = lambda c: (n - F.length(F.replace(value, c)))
    bits = F.aggregate(F.sort_array(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - count(c) / n * F.log2(count(c) / n))
    return F.when(F.length(value) > 0, bits).otherwise(F.lit(0.0))


def collapsed(value: Column) -> Column:
    """White space runs to one space, ends trimmed (Unicode spaces included)."""
    return F.trim(F.regexp_replace(value, r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def tokens(value: Column) -> Column:
    """Lower-case tokens for overlap tests: runs of letters, digits and ``@._+/:-``, without edge ``._:/-``."""
    cleaned = F.transform(F.split(F.lower(value), r"[^a-z0-9@._+/:-]+", -1), lambda t: F.btrim(t, F.lit("._:/-")))
    return F.filter(cleaned, lambda t: t != "")


def ngrams(words: Column, n: int | Column) -> Column:
    """Distinct runs of n words, joined by a space; none if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    every = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def containment(a: Column, b: Column) -> Column:
    """|A and B| / |A| of distinct arrays; null for an empty A."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def overlap_both_ways(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.greatest(containment(a, b), containment(b, a)))


def half_hash(value: Column) -> Column:
    """h = 33 h + code unit modulo 2**32 from 5381, lowest bit: splits ids into halves."""
    return F.aggregate(_codes(value), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(1)).cast("int")


def fold_hash(value: Column, folds: int) -> Column:
    """32-bit FNV-1a over code units, modulo the number of folds."""
    # 16777619 = 2**24 + 403: the product is taken in two parts so that it stays within 64 bits
    step = lambda h, c: _fnv(F.lit(0xFFFFFFFF), h, c)
    return (F.aggregate(_codes(value), F.lit(2166136261).cast("long"), step) % folds).cast("int")


def _fnv(mask, h, c):
    x = h.bitwiseXOR(c)
    return (x * 403 + F.shiftleft(x, 24)).bitwiseAND(mask)


def _codes(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def term_near(text: Column, start: Column, end: Column, term: str, window: int = 70) -> Column:
    """Whether a term stands, as a word of its own, within ``window`` characters before or after a span."""
    before = F.lower(F.substring(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window))))
    after = F.lower(F.substring(text, end + 1, F.lit(window)))
    p = rf"(^|[^a-z0-9]){term.lower()}([^a-z0-9]|$)"
    return before.rlike(p) | after.rlike(p)


def words_near(text: Column, start: Column, end: Column, terms: list[str], window: int = 40) -> Column:
    """Whether any of the terms occurs in the text around a span, the span itself included."""
    around = F.lower(F.substring(text, F.greatest(start - window, F.lit(0)) + 1, end + window - F.greatest(start - window, F.lit(0))))
    return reduce(lambda a, b: a | b, [around.contains(t.lower()) for t in terms], F.lit(False))


def odd_token(token: Column) -> Column:
    """Whether a token looks minted rather than written."""
    rules = [
        token.rlike("[A-Za-z]") & token.rlike("[0-9]"),
        F.length(F.regexp_replace(token, "[^0-9]", "")) >= 9,
        token.rlike(r"[^@\s]@[^@\s]"),
        token.contains("://"),
        token.rlike(java(r"\b[A-Z]{4,}\b")),
        token.rlike("[A-Za-z0-9+/=_-]{16,}"),
    ]
    return reduce(lambda a, b: a | b, rules)


#: Dashed blocks, whole runs of token characters that look minted, and runs of capitalised words. The rules stand before
#: the run, so that the many plain runs of a long text are never made into spans.
PEM_BLOCK, TITLES, _RUN = r"-----BEGIN[^\n]*-----[\s\S]*?-----END[^\n]*-----", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", "[A-Za-z0-9@._/:+=~-]"
_RULES = [f"(?={_RUN}*[0-9])(?={_RUN}*[A-Za-z])", f"(?=[0-9]{{9,}}(?!{_RUN}))", f"(?={_RUN}*[A-Za-z0-9]@[A-Za-z0-9])", f"(?={_RUN}*://)", f"(?=[A-Z]{{4,}}(?!{_RUN}))", f"(?=[A-Za-z0-9+/=]{{16,}}(?!{_RUN}))"]
ODD_RUN = f"(?<!{_RUN})(?:{'|'.join(_RULES)}){_RUN}{{3,}}"


def orthographic_oracle(text: Column) -> Column:
    """array<struct<start,end,text>>: PEM blocks, odd runs and title bigrams in order, without what lies in another."""
    pem = F.when(text.contains("-----BEGIN"), find_spans(text, PEM_BLOCK)).otherwise(F.array().cast(f"array<{SPAN}>"))
    every = F.concat(pem, find_spans(text, ODD_RUN), find_spans(text, TITLES))
    # by start, and the longest first: a span lies in an earlier one if none of it is new
    order = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["text"].alias("text"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc, x):
        own = F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["text"].alias("text"))
        return F.struct(F.greatest(acc["at"], own["end"]).alias("at"), F.when(own["end"] > acc["at"], F.array_append(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(order, start, step, lambda acc: acc["spans"])


def intersection(s1, e1, s2, e2) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1, e1, s2, e2) -> Column:
    both = intersection(s1, e1, s2, e2)
    return both / ((e1 - s1) + (e2 - s2) - both)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 with a key known to the driver."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def row_id(salt: str, message: Column) -> Column:
    if len(salt) < 32:
        raise ValueError("a salt has at least 32 characters")
    return F.substring(hmac_sha256(salt, message), 1, 16)
