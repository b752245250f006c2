"""Token ids of the word-level BPE vocabulary, with a per-worker cache of words.

``word_bpe_49k.json`` drops white space and never merges over it, so the ids of a text are those of its
white-space words one after another, and the ids of a word come from the library's own BPE model. Texts with anything
for which this could differ from the library's full pipeline (special strings, characters that normalisation may
change, separators on which Python and the library disagree) go through the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re

import regex

VOCABULARY = "word_bpe_49k.json"

# The word pattern of the vocabulary file's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters outside these are left to the library: all inside are stable under NFC and lower-cased alike.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧‰-⁞€]|<\\|")

#: Words kept per worker; beyond it the cache starts anew. Longer words are not kept.
CACHE_WORDS, CACHE_CHARS = 250_000, 48


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """Digest of the vocabulary file: the tokenizer version that cached counts belong to."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class WordTokens:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(keep)]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def word(self, w: str) -> bytes:
        ids = []
        for part in self.split(w):
            ids += [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        out = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(w) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[w] = out
        return out

    def ids(self, text: str) -> bytes:
        if ODD.search(text):
            got = self.whole.encode(text, add_special_tokens=False).ids
            return b"".join([i.to_bytes(4, "little") for i in got])
        words = text.lower().split()
        found = list(map(self.known.get, words))
        if None in found:
            word, known = self.word, self.known
            found = [f if f is not None else known.get(w) or word(w) for f, w in zip(found, words, strict=True)]
        return b"".join(found)


_own: dict[str, WordTokens] = {}


def tokens_for(path: str) -> WordTokens:
    """One per Python worker and vocabulary."""
    if path not in _own:
        _own.clear()
        _own[path] = WordTokens(path)
    return _own[path]
