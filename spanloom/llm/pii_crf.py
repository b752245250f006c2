"""Personal data by a linear-chain conditional random field over word shapes, beside base patterns.

Base spans come from fixed patterns for e-mail addresses, IPv4 addresses, payment cards and telephone numbers. The CRF
reads the neighbourhoods of tokens that hold a digit or an at sign (every modelled kind has one), a few tokens to each
side; it is trained by gradient ascent on a small labelled table and decoded by Viterbi over whole batches in numpy.
It adds spans that the patterns cannot: kinds without a pattern (access keys and hex tokens, ``secret``) and data whose
pattern match was spoilt by a neighbour (a card right after a telephone number). Added spans of a base kind must pass
that kind's own test, and none overlaps a base span.

Null text counts as empty (no spans); repeated rows stay; an empty table gives an empty result; texts are read whole,
whatever their length: every scan below is linear in the text, and a token takes some forty bytes. Ties between label
paths go to the label listed first. Further columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, table, text_frame

KINDS = ("email", "ip", "card", "phone")
ADDED = "secret"

# ---------------------------------------------------------------- base patterns

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: it would have started, or failed for the same reason, at the run's head.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from their at signs: a local part is the run before the sign."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at)  # a later local part cannot reach over this sign
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            if kind == "phone" and "+" not in text:
                continue
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if passes(kind, m.group())]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# ---------------------------------------------------------------- tokens and shapes

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_MARK = re.compile(r"[0-9@]")
#: Tokens to each side of a marked one that belong to its sequence.
SIDE = 4
#: Characters in which a neighbourhood's tokens are looked for on each side; longer words end it there.
REACH = 240

LABELS = ["O"] + [f"{p}-{k}" for k in (*KINDS, ADDED) for p in "BI"]


def shape(token: str, glued: bool) -> str:
    """Letter case, digits and length class of a token, and whether it touches the one before."""
    n = len(token)
    size = str(n) if n <= 4 else "8" if n <= 8 else "16" if n <= 16 else "24" if n <= 24 else "40" if n <= 40 else "41"
    if not token[0].isalnum():
        kind = token
    elif token.isdigit():
        kind = "9" + size + ("v" if n <= 3 and int(token) <= 255 else "")
    elif token.isalpha():
        kind = ("A" if token.isupper() and n > 1 else "Aa" if token[0].isupper() else "a") + ("4" if n <= 4 else "8" if n <= 12 else "16")
    else:
        hexa = all(c in "0123456789abcdefABCDEF" for c in token)
        kind = ("h" if hexa else "m") + ("A" if token.upper() == token else "a" if token.lower() == token else "x") + size
    return ("+" if glued else "") + kind


def neighbourhoods(text: str) -> list[np.ndarray]:
    """Token spans (tokens, 2) of every sequence: stretches in which no marked token is more than 2 * SIDE tokens from
    the next."""
    out: list[np.ndarray] = []
    n, at = len(text), 0
    m = _MARK.search(text)
    while m:
        # grow the stretch of characters while further marks lie within reach
        first, last = m.start(), m.end()
        nxt = _MARK.search(text, last)
        while nxt and nxt.start() - last <= REACH:
            last = nxt.end()
            nxt = _MARK.search(text, last)
        left, right = max(at, first - REACH), min(n, last + REACH)
        while right < n and text[right - 1].isalnum() and text[right].isalnum():
            right += 1
        while left > at and text[left - 1].isalnum() and text[left].isalnum():
            left -= 1
        spans = np.fromiter((x for t in _TOKEN.finditer(text, left, right) for x in t.span()), dtype=np.int64).reshape(-1, 2)
        if len(spans):
            marked = np.fromiter((_MARK.search(text, x, y) is not None for x, y in spans), dtype=bool, count=len(spans))
            upto = np.concatenate(([0], np.cumsum(marked)))
            place = np.arange(len(spans))
            near = upto[np.minimum(place + SIDE + 1, len(spans))] > upto[np.maximum(place - SIDE, 0)]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).view(np.int8)))
            out += [spans[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]
        at, m = right, nxt if nxt is None or nxt.start() >= right else _MARK.search(text, right)
    return out


def features(shapes: list[str]) -> list[list[str]]:
    s = ["<<", "<", *shapes, ">", ">>"]
    return [[f"0{s[i]}", f"-{s[i - 1]}", f"+{s[i + 1]}", f"--{s[i - 2]}", f"++{s[i + 2]}", f"-0{s[i - 1]}|{s[i]}", f"0+{s[i]}|{s[i + 1]}"] for i in range(2, len(s) - 2)]


_SHAPES = {"<<": 0, "<": 1, ">": 2, ">>": 3}
_SHAPE_NAMES = list(_SHAPES)


def shape_numbers(shapes) -> np.ndarray:
    """Shapes as numbers; a worker numbers those that it meets, which are some thousand at most."""

    def number(name: str) -> int:
        k = _SHAPES.get(name)
        if k is None:
            k = _SHAPES[name] = len(_SHAPE_NAMES)
            _SHAPE_NAMES.append(name)
        return k

    return np.fromiter((number(x) for x in shapes), dtype=np.int32)


def shapes_of(text: str, spans: np.ndarray):
    """The shapes of a sequence, one after the other."""
    last = -1
    for s, e in spans:
        yield shape(text[s:e], s == last)
        last = e


# ---------------------------------------------------------------- the model


#: Sequences of more tokens than this are decoded alone.
LONG = 5000


class Crf:
    """Weights of a linear chain; features unknown to it count nothing."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def emissions(self, padded: np.ndarray) -> np.ndarray:
        """Scores (tokens, labels) of a sequence of shape numbers with two more on each side: a weight row for each of
        the features of ``features``, looked up once for every shape and pair of shapes that occurs."""
        n = len(padded) - 4
        zero = self.emit[-1]  # the row of what is not known
        out = np.zeros((n, len(LABELS)))

        def rows_of(names: list[str]) -> np.ndarray:
            return np.stack([self.emit[self.index[x]] if x in self.index else zero for x in names])

        used, at = np.unique(padded, return_inverse=True)
        said = [_SHAPE_NAMES[k] for k in used]
        for prefix, shift in (("0", 2), ("-", 1), ("+", 3), ("--", 0), ("++", 4)):
            out += rows_of([prefix + x for x in said])[at[shift : shift + n]]
        pairs, pair = np.unique(at[:-1].astype(np.int64) * len(used) + at[1:], return_inverse=True)
        both = [(said[k // len(used)], said[k % len(used)]) for k in pairs.tolist()]
        for prefix, shift in (("-0", 1), ("0+", 2)):
            out += rows_of([f"{prefix}{x}|{y}" for x, y in both])[pair[shift : shift + n]]
        return out

    def scores(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(sequences, positions, labels) padded with 0, and lengths. Sequences are arrays of shape numbers."""
        lengths = np.array([len(s) for s in sequences])
        out = np.zeros((len(sequences), int(lengths.max()), len(LABELS)))
        flat = self.emissions(np.concatenate([np.concatenate(([0, 1], s, [2, 3])) for s in sequences])) if len(sequences) else out
        at = 0
        for k, n in enumerate(lengths):
            out[k, :n] = flat[at : at + n]
            at += n + 4
        return out, lengths

    def _viterbi_long(self, sequence: np.ndarray, stretch: int = 20_000) -> np.ndarray:
        """Best labels of one long sequence: scores are made a stretch at a time, only the way back is kept whole."""
        padded, n = np.concatenate(([0, 1], sequence, [2, 3])), len(sequence)
        back, best = np.zeros((n, len(LABELS)), dtype=np.int8), None
        for at in range(0, n, stretch):
            for t, score in enumerate(self.emissions(padded[at : min(n, at + stretch) + 4]), at):
                if best is None:
                    best = score + self.move[-1]
                    continue
                paths = best[:, None] + self.move[:-1]
                back[t] = paths.argmax(0)
                best = paths.max(0) + score
        path = np.zeros(n, dtype=np.int8)
        path[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best label numbers of every sequence of shape numbers; sequences of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            if len(sequences[order[at]]) > LONG:
                out[order[at]] = self._viterbi_long(sequences[order[at]])
                at += 1
                continue
            group = [order[at]]
            cells = len(sequences[order[at]])
            while at + len(group) < len(order) and len(group) < 512 and (len(group) + 1) * len(sequences[order[at + len(group)]]) <= max(20_000, cells):
                group.append(order[at + len(group)])
            at += len(group)
            score, lengths = self.scores([sequences[i] for i in group])
            n, steps, _ = score.shape
            back = np.zeros((n, steps, len(LABELS)), dtype=np.int8)
            best = score[:, 0] + self.move[-1]
            ends = np.zeros((n, len(LABELS)))
            ends[lengths == 1] = best[lengths == 1]
            for t in range(1, steps):
                paths = best[:, :, None] + self.move[None, :-1]
                back[:, t] = paths.argmax(1)
                best = paths.max(1) + score[:, t]
                ends[lengths == t + 1] = best[lengths == t + 1]
            for k, i in enumerate(group):
                label = int(ends[k].argmax())
                path = [label]
                for t in range(lengths[k] - 1, 0, -1):
                    label = int(back[k, t, label])
                    path.append(label)
                out[i] = np.array(path[::-1])
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def train(labelled: list[tuple[list[str], list[str]]], steps: int = 70, rate: float = 0.15, ridge: float = 1e-4) -> Crf:
    """Conditional likelihood by Adam on all sequences at once; labelled: (shapes, labels) pairs."""
    sequences = [features(s) for s, _ in labelled]
    index: dict[str, int] = {}
    for seq in sequences:
        for names in seq:
            for x in names:
                index.setdefault(x, len(index))
    lengths = np.array([len(s) for s in sequences])
    n, steps_t, k, per = len(sequences), int(lengths.max()), len(LABELS), len(sequences[0][0])
    ids = np.full((n, steps_t, per), len(index))
    gold = np.zeros((n, steps_t), dtype=int)
    for i, (_, labels) in enumerate(labelled):
        for t, names in enumerate(sequences[i]):
            ids[i, t] = [index[x] for x in names]
        gold[i, : len(labels)] = [LABELS.index(x) for x in labels]
    live = np.arange(steps_t)[None] < lengths[:, None]
    emit, move = np.zeros((len(index) + 1, k)), np.zeros((k + 1, k))  # the last row of move: starts
    state = [np.zeros_like(x) for x in (emit, emit, move, move)]
    for step in range(1, steps + 1):
        score = emit[ids].sum(2)
        fore, back = np.zeros((n, steps_t, k)), np.zeros((n, steps_t, k))
        fore[:, 0] = score[:, 0] + move[-1]
        for t in range(1, steps_t):
            new = _logsum(fore[:, t - 1][:, :, None] + move[None, :-1], 1) + score[:, t]
            fore[:, t] = np.where(live[:, t, None], new, fore[:, t - 1])
        for t in range(steps_t - 2, -1, -1):
            new = _logsum(move[None, :-1] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(live[:, t + 1, None], new, 0)
        total = _logsum(fore[np.arange(n), lengths - 1], 1)
        diff = -np.exp(fore + back - total[:, None, None])  # expected counts, to be taken from those seen
        diff[np.arange(n)[:, None], np.arange(steps_t)[None], gold] += 1
        diff *= live[:, :, None]
        g_emit, g_move = np.zeros_like(emit), np.zeros_like(move)
        np.add.at(g_emit, ids.reshape(-1, per), diff.reshape(-1, 1, k))
        g_move[-1] = diff[:, 0].sum(0)
        for t in range(1, steps_t):
            on = live[:, t]
            p = np.exp(fore[on, t - 1][:, :, None] + move[None, :-1] + (score[on, t] + back[on, t])[:, None, :] - total[on][:, None, None])
            g_move[:-1] -= p.sum(0)
            np.add.at(g_move, (gold[on, t - 1], gold[on, t]), 1)
        for x, g, m, v in ((emit, g_emit, state[0], state[1]), (move, g_move, state[2], state[3])):
            g = g / n - ridge * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    emit[-1] = 0
    # an inside label may only follow its own kind
    for b, name in enumerate(LABELS):
        if name[0] == "I":
            for a in range(k + 1):
                if a == k or LABELS[a][1:] != name[1:]:
                    move[a, b] = -1e4
    return Crf(index, emit, move)


# ---------------------------------------------------------------- the labelled table


def labelled_table(sentences: int = 400, seed: int = 3) -> pd.DataFrame:
    """A small labelled table (text, spans "kind:start:end,..."), drawn from sentence forms."""
    rng = random.Random(seed)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(alphabet + "éèäöüñó", k=rng.randint(2, 11)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))

    def email():
        name = "".join(rng.choices(alphabet, k=rng.randint(2, 9)))
        return name + rng.choice(["", "." + digits(2), "_" + digits(1), "." + word()[:1] + "x"]) + "@" + rng.choice(["mail" + digits(1) + ".example.com", "example.org", "post.example.net", "a-b.example.co"])

    def card():
        body = digits(15)
        last = next(d for d in "0123456789" if luhn(body + d))
        c = body + last
        return rng.choice([c, c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}"])

    made = {
        "email": email,
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+{rng.randint(1, 99)}-{digits(3)}-{digits(7)}"]),
        ADDED: lambda: rng.choice(["AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=15)) + digits(1), "".join(rng.choices("0123456789abcdef", k=rng.choice([16, 18, 20, 24, 32, 40, 40])))]),
        # look-alikes that carry no label
        "O": lambda: rng.choice([digits(rng.randint(1, 4)), f"{digits(1)}.{digits(1)}", f"CC BY-NC {digits(1)}.0", "@" + word(), f"{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", "v" + digits(1) + "." + digits(2), digits(6), word() + digits(2)]),
    }
    rows = []
    for _ in range(sentences):
        parts, spans, at = [], [], 0
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 5)):
                w = word()
                w = w.title() if rng.random() < 0.15 else w
                w += rng.choice(["", "", "", "", ",", ".", " |", "###", "$$$", "!!"])
                parts.append(w)
                at += len(w) + 1
            kind = rng.choice([*KINDS, ADDED, "O"])
            value = made[kind]()
            before, after = rng.choice([("", ""), ("", ""), ("", ""), ("(", ")"), ("", "."), ("", ","), ("", "###"), ("token = \"", '"') if kind == ADDED else ("", ""), (rng.choice(["api_key=", "password="]), "") if kind == ADDED else ("", "")])
            if kind != "O":
                spans.append(f"{kind}:{at + len(before)}:{at + len(before) + len(value)}")
            parts.append(before + value + after)
            at += len(before) + len(value) + len(after) + 1
        rows.append((" ".join(parts), ",".join(spans)))
    return pd.DataFrame(rows, columns=["text", "spans"])


def read_labelled(labelled: pd.DataFrame) -> list[tuple[list[str], list[str]]]:
    out = []
    for text, said in zip(labelled["text"], labelled["spans"], strict=True):
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in said.split(",") if x)]
        for tokens in neighbourhoods(text):
            labels = []
            for s, e in tokens:
                own = next(((k, a) for k, a, b in spans if a <= s and e <= b), None)
                labels.append("O" if own is None else ("B-" if own[1] == s else "I-") + own[0])
            out.append((list(shapes_of(text, tokens)), labels))
    return out


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(read_labelled(labelled_table()))


# ---------------------------------------------------------------- spans of texts


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Crf) -> list[list[tuple[str, int, int]]]:
    """What the CRF adds to each text's base spans."""
    owners, tokens = [], []
    for i, text in enumerate(texts):
        if _MARK.search(text):
            for t in neighbourhoods(text):
                owners.append(i)
                tokens.append(t)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not tokens:
        return out
    paths = model.viterbi([shape_numbers(shapes_of(texts[i], t)) for i, t in zip(owners, tokens, strict=True)])
    for i, spans, path in zip(owners, tokens, paths, strict=True):
        text, (starts, reach) = texts[i], _reach(base[i])
        for k in _heads(path):
            name = LABELS[path[k]]
            end = k + 1
            while end < len(path) and LABELS[path[end]] == "I-" + name[2:]:
                end += 1
            kind, s, e = name[2:], int(spans[k, 0]), int(spans[end - 1, 1])
            if kind == "phone" or kind == "card":  # a span of these ends at its last digit
                while e > s and not text[e - 1].isdigit():
                    e -= 1
            if valid(kind, text[s:e]) and ((upto := bisect.bisect_left(starts, e)) == 0 or reach[upto - 1] <= s):
                out[i].append((kind, s, e))
    return out


def _reach(base: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts of base spans, ascending, and the farthest end of all up to each."""
    return [x for _, x, _ in base], list(itertools.accumulate((y for _, _, y in base), max))


def _heads(path: np.ndarray) -> list[int]:
    """Where a label other than O begins a span: an inside label only ever follows its own kind."""
    return np.flatnonzero(_BEGINS[path]).tolist()


_BEGINS = np.array([x[0] == "B" for x in LABELS])


_FULL = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"), "card": _CARD, "phone": _PHONE, ADDED: re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9/+=_-]{16,}")}


def valid(kind: str, found: str) -> bool:
    return bool(_FULL[kind].fullmatch(found)) and passes(kind, found)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """(doc_id, spans, redacted): spans in code points, end exclusive, by start; ``redacted`` is the text with every
    span replaced by its kind in brackets (overlapping spans as one, by the first kind)."""
    model = model or default_model()
    order = [*KINDS, ADDED]

    def work(batch):
        texts = batch.column("text").to_pylist()
        base = [base_spans(t) for t in texts]
        more = added_spans(texts, base, model)
        spans, redacted = [], []
        for text, b, m in zip(texts, base, more, strict=True):
            both = sorted([(k, s, e, True) for k, s, e in b] + [(k, s, e, False) for k, s, e in m], key=lambda x: (x[1], order.index(x[0])))
            spans.append([{"kind": k, "start": s, "end": e, "base": o} for k, s, e, o in both])
            parts, at, last = [], 0, -1
            for k, s, e, _ in both:
                if s >= last:
                    parts += [text[at:s], f"[{k.upper()}]"]
                at = last = max(last, e)
            redacted.append("".join(parts) + text[at:] if parts else text)
        return {"doc_id": batch.column("doc_id"), "spans": spans, "redacted": redacted}

    return map_batches(text_frame(docs), work, f"doc_id long, spans {SPANS}, redacted string")


def redact(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` counted anew; other columns pass through."""
    model = model or default_model()
    inner = docs.columns

    def work(batches):
        import pyarrow as pa

        from .common import chunks

        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text").to_pylist()
                clean = []
                known = [t or "" for t in texts]
                base = [base_spans(t) for t in known]
                more = added_spans(known, base, model)
                for raw, text, b, m in zip(texts, known, base, more, strict=True):
                    parts, at = [], 0
                    for k, s, e in sorted(b + m, key=lambda x: (x[1], order.index(x[0]))):
                        if s >= at:
                            parts += [text[at:s], f"[{k.upper()}]"]
                        at = max(at, e)
                    clean.append("".join(parts) + text[at:] if parts else raw)
                cols = [pa.array(clean, type=part.schema.field("text").type) if n == "text" else pa.array([None if c is None else len(c) for c in clean], type=part.schema.field(n).type) if n == "n_chars" else part.column(n) for n in inner]
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    order = [*KINDS, ADDED]
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: spans of all documents; counts and digest are those of the base spans, ``spans`` holds all."""
    found = find_pii(table(spark, sf_dir, "documents")).drop("redacted")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
