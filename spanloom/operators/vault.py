"""Pseudonyms: seeded surrogates, minting by conversation, and putting the real values back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def leaks(real: Column, surrogate: Column) -> Column:
    """Equal but for case, or sharing a word of two or more characters."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    return (F.lower(real) == F.lower(surrogate)) | F.arrays_overlap(words(real), words(surrogate))


# ---------------------------------------------------------------- seeded numbers


def seed_of(text: str) -> int:
    """64-bit FNV-1a over UTF-16 code units, folded to 32 bits."""
    h, units = 0xCBF29CE484222325, text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (h >> 32) ^ (h & 0xFFFFFFFF)


class Rng:
    """A 32-bit counter generator with a multiplicative mixer; numbers in [0, 1)."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def next(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    def pick(self, values):
        return values[int(self.next() * len(values))]


_FIRST = "Alba Bruno Carla Dario Elena Fabio Greta Hugo Irma Jonas Karla Lukas Marta Nils Olga Pavel".split()
_LAST = "Abel Brandt Costa Duarte Egger Falk Grau Hoff Iversen Jansen Koller Lorenz Moser Novak Ortega Prins".split()
_ORG = "Amber Birch Cedar Delta Ember Fjord Grove Harbor Indigo Juniper".split()
_ORG_KIND = "Holdings Partners Systems Trading Works".split()


def _scramble(value: str, rng: Rng) -> str:
    """Every letter and digit replaced by another of its class; the rest stays."""
    out = []
    for c in value:
        pool = "0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isalpha() and c.isupper() else "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else c
        out.append(rng.pick(pool))
    return "".join(out)


#: Kinds of surrogates: a name of a person, of an organisation, a number with the holder's type kept, any other text.
KINDS = ("person-name", "org-name", "id-number", "opaque")


def surrogate(real: str, kind: str, rng: Rng) -> str:
    if kind == "person-name":
        return f"{rng.pick(_FIRST)} {rng.pick(_LAST)}"
    if kind == "org-name":
        return f"{rng.pick(_ORG)} {rng.pick(_ORG_KIND)}"
    made = _scramble(real, rng)
    if kind == "id-number" and re.fullmatch(r"[A-Z]{5}[0-9]{4}[A-Z]", real):
        made = made[:3] + real[3] + made[4:]  # the holder type stays
    return made


def _words(text: str) -> set[str]:
    """What would betray a value: its words of more than one letter or digit."""
    return {w for w in re.split(r"[^a-z0-9]+", text.lower()) if len(w) > 1}


class VaultError(ValueError):
    pass


def mint(conversation: str, entries: list[tuple[str, str, str]], salt: str = "", known: dict[tuple[str, str], str] | None = None, never: frozenset[str] = frozenset()) -> dict[tuple[str, str], str]:
    """(entity type, real) to surrogate, in order of appearance. entries: (entity type, kind, real).

    A surrogate differs from all others and betrays no real value of the conversation; after SALTS tries a number is
    put behind the last one."""
    out = dict(known or {})
    reals = {r.lower() for _, _, r in entries} | {r.lower() for _, r in out}
    words = {w for r in reals for w in _words(r)}
    used = set(out.values())
    betrays = lambda made: made.lower() in reals or not words.isdisjoint(_words(made))
    for entity_type, kind, real in entries:
        if entity_type in never:
            raise VaultError("a type that is never pseudonymised")
        if not real.strip():
            raise VaultError("a blank value")
        if (entity_type, real) in out:
            continue
        made = ""
        for k in range(SALTS):
            made = surrogate(real, kind, Rng(seed_of(f"{salt}{k or ''}\0{conversation}\0{entity_type}\0{real}")))
            if made not in used and not betrays(made):
                break
        else:
            base, k = made, 2
            while f"{base} {k}" in used:
                k += 1
            made = f"{base} {k}"
        out[entity_type, real] = made
        used.add(made)
    return out


def mint_all(values: DataFrame, salt: str = "") -> DataFrame:
    """values (conv_id, turn, start, entity_type, kind, real) to (conv_id, entity_type, real, surrogate).

    Serial within a conversation, by (turn, start); values are made distinct before they are grouped, so a group holds
    a conversation's different values only."""
    first = values.groupBy("conv_id", "entity_type", "kind", "real").agg(F.min(F.struct("turn", "start")).alias("at"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(k=[(a["turn"], a["start"]) for a in frame["at"]]).sort_values(["k", "entity_type", "real"])
        got = mint(str(frame["conv_id"].iat[0]), list(frame[["entity_type", "kind", "real"]].itertuples(index=False, name=None)), salt)
        return pd.DataFrame([(frame["conv_id"].iat[0], t, r, s) for (t, r), s in got.items()], columns=["conv_id", "entity_type", "real", "surrogate"])

    return first.groupBy("conv_id").applyInPandas(run, "conv_id long, entity_type string, real string, surrogate string")


# ---------------------------------------------------------------- back again


def pattern_of(surrogates) -> re.Pattern | None:
    """Longest first; digits around a surrogate make it another one."""
    names = sorted(surrogates, key=lambda s: (-len(s), s))
    return re.compile("|".join(rf"(?<![0-9]){re.escape(s)}(?![0-9])" for s in names)) if names else None


def rehydrate(text: str, back: dict[str, str]) -> str:
    p = pattern_of(back)
    return p.sub(lambda m: back[m.group()], text) if p else text


class Rehydrator:
    """The same over a stream of chunks: holds back no more than the longest surrogate, and one character before."""

    def __init__(self, back: dict[str, str], carry: str = "", pending: str = ""):
        self.back, self.pattern, self.longest = back, pattern_of(back), max((len(s) for s in back), default=0)
        self.carry, self.pending = carry, pending

    def push(self, chunk: str) -> str:
        self.pending += chunk
        return self._emit(False)

    def finish(self) -> str:
        return self._emit(True)

    def _emit(self, last: bool) -> str:
        if not self.pattern:
            out, self.pending = self.pending, ""
            return out
        text, out, at = self.carry + self.pending, [], len(self.carry)
        # a match that ends before the last character cannot grow or be spoilt by what follows
        safe = len(text) if last else max(at, len(text) - self.longest)
        while True:
            m = self.pattern.search(text, at)
            if not m or (m.start() >= safe if not last else False) or (not last and m.end() >= len(text)):
                break
            out += [text[at : m.start()], self.back[m.group()]]
            at = m.end()
            safe = max(safe, at)
        end = safe
        if m and not last:
            end = min(safe, m.start())
        out.append(text[at:end])
        self.carry, self.pending = text[max(0, end - 1) : end], text[end:]
        return "".join(out)


def rehydrate_rows(replies: DataFrame, vault: DataFrame) -> DataFrame:
    """replies (conv_id, turn, text) with the real values back. vault (conv_id, real, surrogate) is gathered by
    conversation; replies stay one row each."""
    back = vault.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("surrogate", "real"))).alias("back"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["text"] = [rehydrate(t or "", dict(b or {})) for t, b in zip(f["text"], f["back"], strict=True)]
            yield f[["conv_id", "turn", "text"]]

    return replies.select("conv_id", "turn", "text").join(back, "conv_id", "left").mapInPandas(run, "conv_id long, turn long, text string")
